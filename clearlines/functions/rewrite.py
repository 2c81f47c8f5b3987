"""Rule-based rewriting: lexicon, first clause, and the built-in simplifier made of them."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.text import WS, clean_sentence, not_ws_or, strip

WORD = r"[\p{L}\p{N}_]"


def _whole_word(key: str) -> str:
    """Case-insensitive pattern for ``key`` between word boundaries (Unicode words).

    Look-arounds are spelled out because the meaning of ``\\b`` differs between Java
    versions. A key that begins or ends in punctuation needs a word beside it.
    """
    def inside(ch: str) -> bool:
        return ch.isalnum() or ch == "_"

    sign = "!" if inside(key[0]) else "="
    before = f"(?s:(?<{sign}{WORD}.{{{len(key)}}}))"  # looked at only where the key was found
    after = f"(?!{WORD})" if inside(key[-1]) else f"(?={WORD})"
    return f"(?iu){re.escape(key)}{before}{after}"


def _may_hold(text: Column, lexicon: Mapping[str, str]) -> Column | None:
    """False only for texts without any key; None if that cannot be told cheaply.

    Upper and then lower case maps every letter that matches an ASCII letter regardless of
    case to that letter, but for the dotted capital I.
    """
    if not lexicon or not all(key.isascii() for key in lexicon):
        return None

    def holds(folded: Column) -> Column:
        tests = [F.contains(folded, F.lit(key.lower())) for key in lexicon]
        return reduce(lambda a, b: a | b, tests)

    # an array of one value names that value: the text is folded once for all keys, inside arrays too
    return F.contains(text, F.lit("\u0130")) | F.exists(F.array(F.lower(F.upper(text))), holds)


def lexicon_replace(text: Column, lexicon: Mapping[str, str] = fixed.LEXICON) -> Column:
    """Replace whole words, longest key first, each key over the result of the former.

    Most texts hold no key at all; a plain search for all keys spares them the patterns.
    """
    original, found = text, _may_hold(text, lexicon)
    for old in sorted(lexicon, key=len, reverse=True):
        new = lexicon[old].replace("\\", "\\\\").replace("$", "\\$")
        text = F.regexp_replace(text, _whole_word(old), new)
    return text if found is None else F.when(found, text).otherwise(original)


def first_clause(text: Column, min_words: int = fixed.MIN_CLAUSE_WORDS) -> Column:
    """Text before the first ``,;:`` when that holds enough words, else the text."""
    mark = fixed.CLAUSE_MARKS
    part = not_ws_or(mark[1:-1])
    enough = f"{WS}*(?:{part}+{WS}+){{{min_words - 1}}}{part}[^{mark[1:-1]}]*"
    return strip(F.regexp_replace(text, rf"\A({enough}){mark}(?s:.*)\z", "$1"))


def heuristic_simplify(text: Column, lexicon: Mapping[str, str] = fixed.LEXICON) -> Column:
    """Deterministic simplifier: lexicon, first clause, cleaned sentence."""
    return clean_sentence(first_clause(lexicon_replace(text, lexicon)))


def strip_the(prediction: Column, is_copy: Column) -> Column:
    """Drop every ``the `` from predictions that are copies (an option, off by default)."""
    return F.when(is_copy, strip(F.replace(prediction, F.lit("the "), F.lit("")))).otherwise(prediction)
