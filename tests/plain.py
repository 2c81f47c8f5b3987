"""Independent definitions in plain Python, to compare Spark columns with.

Texts are scanned character by character; nothing here is a regular expression but the
published tokenization of the last section.
"""

from __future__ import annotations

import re
from collections import Counter
from difflib import SequenceMatcher
from itertools import groupby

ENDS, CAPITALS = set(".!?"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ASCII_LETTERS = CAPITALS | {c.lower() for c in CAPITALS}


def runs(text, belongs):
    """Longest stretches of characters that belong."""
    return ["".join(part) for inside, part in groupby(text, belongs) if inside]


def split(text):
    """A sentence ends at white space between an end mark and a capital."""
    text, out, begin, at = text.strip(), [], 0, 0
    while at < len(text):
        if not text[at].isspace():
            at += 1
            continue
        after = at
        while text[after].isspace():
            after += 1
        if text[at - 1] in ENDS and text[after] in CAPITALS:
            out.append(text[begin:at])
            begin = after
        at = after
    return out + [text[begin:]] if text else []


def first_sentence(text):
    """Up to the first end mark before white space, if it stands on the first line."""
    text = text.strip()
    for at, char in enumerate(text):
        if char == "\n":
            break
        if char in ENDS and (at + 1 == len(text) or text[at + 1].isspace()):
            return text[:at + 1]
    return text


def clean(text, collapse=True):
    words = text.split()
    text = " ".join(words) if collapse else text.strip()
    closed = text if not text or text[-1] in ENDS else f"{text}."
    return closed[:1].upper() + closed[1:]


def numbers(text):
    """Decimal digits, with one point between digits and a percent sign if they are there."""
    found, at = set(), 0
    while at < len(text):
        if not text[at].isdecimal():
            at += 1
            continue
        begin, points = at, 0
        while at < len(text) and (text[at].isdecimal() or (
                text[at] == "." and not points and text[at + 1:at + 2].isdecimal())):
            points += text[at] == "."
            at += 1
        at += text[at:at + 1] == "%"
        found.add(text[begin:at])
    return found


def terms(text, stop):
    """Words of four and more letters and inner hyphens that are not stop words."""
    words = (w.lstrip("-") for w in runs(text.lower(), lambda c: c in ASCII_LETTERS or c == "-"))
    return {w for w in words if len(w) >= 4} - set(stop)


def letters(text):
    return runs(text, ASCII_LETTERS.__contains__)


def ratio(a, b, skip_frequent=False):
    return SequenceMatcher(a=a, b=b, autojunk=skip_frequent).ratio()


def folded(text):
    return text.strip().lower()


def reason(source, candidate, gate):
    """Name of the first rule that fails; the rules in the order of the gate's definition."""
    old, new = terms(source, gate.stop_words), terms(candidate, gate.stop_words)
    share = gate.added_share * len(old)
    most_new = max(gate.min_added, share // 1 if gate.whole_added else share)
    order = {
        "blank": lambda: gate.reject_blank and candidate.isspace() | (candidate == ""),
        "same": lambda: folded(source) == folded(candidate),
        "ratio": lambda: gate.max_ratio is not None and ratio(source.lower(), candidate.lower()) >= gate.max_ratio,
        "numbers": lambda: not numbers(candidate) <= numbers(source),
        "missing": lambda: old and len(old - new) > gate.max_missing * len(old),
        "added": lambda: old and len(new - old) > most_new,
    }
    return next((name for name, fails in order.items() if fails()), "ok")


def simpler(source, candidate):
    """No longer (5 per cent allowed), and either shorter words by 0.25 or one word of nine letters less."""
    (n, total, long), (m, new_total, new_long) = [
        (len(w), sum(map(len, w)), sum(len(x) > 8 for x in w)) for w in (letters(source), letters(candidate))]
    means = [t / k if k else 0.0 for t, k in ((total, n), (new_total, m))]
    return max(m, 1) <= (max(n, 1) * 1.05) // 1 and (means[0] - 0.25 >= means[1] or long > new_long)


def copied(source, candidate, threshold=0.985):
    same = folded(candidate) in ("", folded(source))
    return same or ratio(source.lower(), candidate.lower()) >= threshold


def replace_words(text, table):
    """Longer keys first; a key counts where no word character touches it, whatever its case."""
    word = lambda c: c.isalnum() or c == "_"
    for old in sorted(table, key=len, reverse=True):
        out, at = [], 0
        while at < len(text):
            here = text[at:at + len(old)]
            if (len(here) == len(old) and all(a.casefold() == b.casefold() for a, b in zip(here, old))
                    and not (at and word(text[at - 1])) and not any(map(word, text[at + len(old):at + len(old) + 1]))):
                out.append(table[old])
                at += len(old)
            else:
                out.append(text[at])
                at += 1
        text = "".join(out)
    return text


def heuristic(sentence, table):
    """The clause before the first mark if it has six words, with words replaced and closed as a sentence."""
    text = replace_words(sentence, table)
    marks = [at for at, c in enumerate(text) if c in ",;:"]
    clause = text[:marks[0]] if marks else text
    return clean(clause if len(clause.split()) > 5 else text)


# --- a published metric and its published tokenization ------------------------------------


def grams(tokens, n):
    return Counter(" ".join(tokens[i:i + n]) for i in range(len(tokens) - n + 1))


def f1(p, r):
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def sari(source, prediction, references, tokens=lambda t: " ".join(t.lower().split()).split(" ")):
    """(keep, delete, add, mean of the three) of one pair."""
    k, parts = len(references), []
    for n in (1, 2, 3, 4):
        s, c = grams(tokens(source), n), grams(tokens(prediction), n)
        r = Counter()
        for reference in references:
            r += grams(tokens(reference), n)
        s = Counter({g: v * k for g, v in s.items()})
        c = Counter({g: v * k for g, v in c.items()})
        kept, all_kept = s & c, s & r
        good = kept & r
        precision = sum(good[g] / kept[g] for g in good) / len(kept) if kept else 1
        recall = sum(good.values()) / sum(all_kept.values()) if all_kept else 1
        gone = s - c
        bad = gone - r
        delete = sum(bad[g] / gone[g] for g in bad) / len(gone) if gone else 1
        added, wanted = set(c) - set(s), set(r) - set(s)
        hits = added & set(r)
        add = f1(len(hits) / len(added) if added else 1, len(hits) / len(wanted) if wanted else 1)
        parts.append((f1(precision, recall), delete, add))
    keep, delete, add = (sum(p[i] for p in parts) / 4 for i in range(3))
    return keep, delete, add, (keep + delete + add) / 3


def tokens_13a(text):
    text = text.lower().replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in text:
        text = text.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    text = f" {text} "
    for pattern, to in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                        (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = re.sub(pattern, to, text)
    return " ".join(text.split()).split(" ")


#: Texts that are hard to cut, clean or compare.
AWKWARD = [
    "", "   ", "\n\t ", "Dr. Smith left. He ran.", "one. two. Three! Four", "A?B. C", 'He said "Go." Then left.',
    'First.\nSecond one. "Third."', "a\nb. c", "What?! Yes.", "no end", "It cost 3.5 dollars. More.",
    "wide space here　and there. Next one.", "\x1codd\x1fseparators\x85too.\x1dAnd More",
    "1,200 and 3.5% of 2.0.1 or ٣٤%", "state-of-the-art AI was x-ray naïve café", "ßharp ß", "ǆ digraph",
    "The Rapid rapid RAPID rapidly proliferation, of artificial intelligence; technologies in a manner:  analyzed",
    "decision-making is decision-makings, not indecision-making _manner_ mannerß ſpeed proceſſed proceSSed",
    "crumbs\r\nand\rreturns. Done. Ok", "emoji \U0001f600 text. Yes \U0001f600.", "a" * 300, "ab " * 120,
    "### Response: x ### Response: y. Z", "Simple: a Simplified: b", "x ###\n\n y", "\n\nlead ### tail",
    "this this-that abc- --word x-ray th-is over-under thisthat the this1that éthisé",
]
