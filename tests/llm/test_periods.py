"""Runs of repeated word sequences against all periods tried one by one."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest

from clearlines.llm import periods, queries


def plain_runs(w):
    n, found = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q):
                part = w[i:i + length]
                if not any(all(part[k] == part[k + p] for k in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def best(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def texts():
    rng = random.Random(8)
    out = ["a " * n for n in (1, 2, 5, 6, 7, 33, 200)] + ["a b " * 50 + "c " * 9 + "a b " * 3]
    for _ in range(150):
        w = []
        while len(w) < rng.randint(5, 250):
            base = [rng.choice("abc") for _ in range(rng.choice([1, 2, 3, 5, 8, 17, 40]))]
            times = rng.choice([1, 2, 3.5, 4, 4.2, 6, 9])
            w += [base[i % len(base)] for i in range(int(len(base) * times))]
        out.append(" ".join(w))
    word = [str(i) for i in range(300)]
    return out + [" ".join(word * 5 + ["x"] + word[:7] * 30), " ".join(word * 4 + word[:150]), "x " * 3 + "é\n\té \x85 ü\x1c " * 9]


@pytest.mark.parametrize("span", [8, periods.SPAN])
def test_against_every_period(spark, make, span):
    """Also with spans of tiles so small that most runs are stitched from many."""
    every = texts()
    rows = periods.periodic_runs(make(list(enumerate(every))), span=span).collect()
    assert len(rows) == len(every)
    for r in rows:
        w = plain_words(every[r.doc_id])
        wanted = plain_runs(w)
        assert [tuple(x) for x in r.runs] == wanted and r.n_words == len(w)
        assert (tuple(r.best) if r.best else None) == best(wanted)
        assert r.collapsed == collapsed(w, wanted)


def test_awkward_rows(make, awkward):
    rows = periods.periodic_runs(make(awkward)).collect()
    assert len(rows) == len(awkward)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.n_words, r.runs, r.best, r.collapsed) for r in by[1] + by[2] + by[3]] == [(0, [], None, "")] * 3
    assert len(by[4]) == len(by[5]) == len(by[None]) == 2 and by[6][0].n_words == 60_000
    same = [(9, "b " * 8), (9, "b " * 8), (9, "b c " * 8), (None, "b " * 8)]
    assert sorted((r.doc_id or 0, r.collapsed) for r in periods.periodic_runs(make(same)).collect()) == [(0, "b"), (9, "b"), (9, "b"), (9, "b c")]
    assert periods.periodic_runs(make([])).count() == 0


def test_long_texts(make):
    """Time of n log n, and the one run found, in a million equal words and in a period of 100,000."""
    block = " ".join(map(str, range(50_000)))
    rows = {r.doc_id: r for r in periods.periodic_runs(make([(1, "a " * 300_000), (2, " ".join([block] * 5))])).collect()}
    assert [tuple(x) for x in rows[1].runs] == [(0, 300_000, 1)] and rows[1].collapsed == "a"
    assert [tuple(x) for x in rows[2].runs] == [(0, 250_000, 50_000)] and rows[2].collapsed == block


def planted(key, w):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def test_query(spark, folder):
    """Texts of up to 600 words against brute force, and digests of all."""
    docs = {r.doc_id: planted(r.doc_id, plain_words(r.text)) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_periodic_runs"](spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    some = 0
    for r in rows:
        w = docs[r.doc_id]
        if len(w) > 600:
            continue
        wanted = plain_runs(w)
        some += bool(wanted)
        top = best(wanted)
        assert (r.n_runs, (r.start, r.length, r.period) if top else None) == (len(wanted), top)
        assert r.exponent_milli == (top and 1000 * top[1] // top[2])
        assert r.runs_sha256 == digest("".join(f"{s},{n},{q}\n" for s, n, q in wanted))
        assert r.collapsed_sha256 == digest(collapsed(w, wanted))
    assert some > 10
