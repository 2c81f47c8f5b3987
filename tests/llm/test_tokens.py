"""BPE automaton and packing against the tokenizers library and plain dynamic programming."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clearlines.llm import bpe, packing, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("aab "), st.text("the ing'sl\n\t"), st.text("=-_.!# \xa0\x85\u3000é²ªⅧ漢")))
def test_codec_is_the_library(codec, library, text):
    wanted = library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == wanted
    assert codec.decode(wanted) == library.decode(wanted, skip_special_tokens=False)


def test_merge_gadgets_of_a_small_vocabulary():
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"ab", b"ab")]
    words = {w: i for i, w in enumerate([b"a", b"b", *[x + y for x, y in merges]])}
    words |= {bytes([c]): 100 + c for c in range(256) if bytes([c]) not in words}
    machine = bpe.Automaton(words, merges)
    names = {i: w for w, i in words.items()}

    def merged(word):
        parts = [bytes([c]) for c in word]
        for pair in merges:
            at = 0
            while at < len(parts) - 1:
                if tuple(parts[at:at + 2]) == pair:
                    parts[at:at + 2] = [pair[0] + pair[1]]
                at += 1
        return parts

    rng = random.Random(3)
    for _ in range(3000):
        word = bytes(rng.choices(b"ab", k=rng.randint(1, 12)))
        assert [names[t] for t in machine.path(word)] == merged(word), word


def test_long_words_take_linear_time(codec, library):
    for text in ("a" * 200_000, "qzjx" * 20_000, "=" * 50_000, "\n" * 50_000):
        assert codec.decode(codec.encode(text)) == text


def test_encode_query(spark, folder, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op6_bpe_automaton"](spark, folder).collect()
    assert len(rows) == len(docs)
    for row in rows:
        ids = library.encode(docs[row.doc_id], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_awkward(make, awkward, library):
    rows = bpe.encode_decode(make(awkward), PATH).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.ids, r.decoded) for r in rows)) == sorted(
        (k is None, k or 0, library.encode(t or "", add_special_tokens=False).ids, t or "") for k, t in awkward)
    assert bpe.encode_decode(make([]), PATH).collect() == []


def least_cost(cost, size):
    """Plain dynamic programming: sequences of size/2 to size tokens, then the rest."""
    n, far = len(cost) - 1, 10 ** 9
    f = [0] + [far] * n
    for j in range(1, n + 1):
        f[j] = min([f[i] + (0 if (j - i) & (j - i - 1) == 0 else size - (j - i)) + int(cost[j])
                    for i in range(max(0, j - size), j - size // 2 + 1)] or [far])
    return min(f[i] + packing.rest_cost(n - i, size)[0] for i in range(max(0, n - size), n + 1))


def cost_of(cost, size, ends):
    n, bounds, totals = len(cost) - 1, [0, *ends], []
    for t in range(len(bounds)):
        head = list(zip(bounds[:t], bounds[1:t + 1]))
        left, tail = packing.rest_cost(n - bounds[t], size) if n - bounds[t] <= size else (0, None)
        if tail is not None and all(b - a >= size // 2 for a, b in head) and (
                bounds[t + 1:] == [bounds[t] + s for s in np.cumsum(tail)]):
            totals.append(left + sum((0 if (b - a) & (b - a - 1) == 0 else size - (b - a)) + int(cost[b]) for a, b in head))
    return min(totals)


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        size, n = rng.choice([8, 16, 32]), rng.randint(1, 150)
        cost = np.array([rng.choice([0, 1, 8, 8, 8]) for _ in range(n + 1)])
        ends = packing.cuts(cost, size)
        assert ends[-1] == n and max(np.diff([0, *ends])) <= size
        assert cost_of(cost, size, ends) == least_cost(cost, size)


def check_pieces(pieces, wanted, size):
    """Every id in exactly one piece, sequences without gaps; the share of padding."""
    by, full = {}, {}
    for p in pieces:
        by.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        full.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sorted(by, key=str) == sorted({(k, len(ids)) for k, ids in wanted}, key=str)
    for key, ids in wanted:
        found = sorted(by[key, len(ids)], key=lambda p: p.start)
        copies = sum((key, ids) == w for w in wanted)
        covered = sum(p.length for p in found)
        assert covered == len(ids) * sum(w[0] == key and len(w[1]) == len(ids) for w in wanted)
        if copies == 1 and covered == len(ids):
            assert b"".join(bytes(p.ids) for p in found) == np.array(ids, "<u4").tobytes()
    padding = total = 0
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding / max(1, total)


def test_pack_awkward(make, awkward, library):
    wanted = [(k, library.encode(t or "", add_special_tokens=False).ids + [0]) for k, t in awkward]
    for run in (packing.RUN, 4096):
        check_pieces(packing.pack(make(awkward), PATH, run=run).collect(), wanted, 1024)
    assert packing.pack(make([]), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(make([]), PATH, size=1000)


def test_pack_query(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    wanted = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [0]) for r in docs]
    pieces = packing.pack(spark.read.parquet(f"{folder}/documents.parquet"), PATH).collect()
    assert check_pieces(pieces, wanted, 1024) < 0.01
    ids = dict(wanted)
    for row in queries.QUERIES["op1_packing"](spark, folder).collect():
        part = np.array(ids[row.doc_id][row.start:row.start + row.length], "<u4").tobytes()
        assert row.ids_crc32 == zlib.crc32(part) and row.doc_tokens == len(ids[row.doc_id])
