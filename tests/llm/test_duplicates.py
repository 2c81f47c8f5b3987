"""Near-duplicates of texts and vectors, and components, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearlines.llm import embeddings, neardup, queries
from clearlines.llm.components import connected_components


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = random.Random(4)
    chains = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(60)] + [(i, i) for i in range(300, 310)]
    some = [(rng.randint(400, 700), rng.randint(400, 700)) for _ in range(150)]
    edges = chains + some + some[:20] + [(900, None), (None, None)]
    rng.shuffle(edges)
    found = connected_components(spark.createDataFrame(edges, "left long, right long")).collect()
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    wanted = classes({x for e in real for x in e}, real)
    assert {r.node: r.component for r in found} == wanted and len(found) == len(wanted)
    assert connected_components(spark.createDataFrame([], "left long, right long")).count() == 0


def noisy(rng, words, share):
    return [w if rng.random() > share else "w%d" % rng.randint(0, 10 ** 6) for w in words]


def corpus(rng):
    """Lone texts, families of near copies, exact copies, and a line that many share."""
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    rows, line = [], [word() for _ in range(12)]
    for _ in range(60):
        rows.append([word() for _ in range(rng.randint(30, 300))])
    for _ in range(15):
        base = [word() for _ in range(rng.randint(80, 300))]
        rows += [base, base] + [noisy(rng, base, rng.choice([0.002, 0.01, 0.05, 0.2])) for _ in range(5)]
    base = [word() for _ in range(120)]
    rows += [noisy(rng, base, 0.02) for _ in range(120)]
    rows = [line + r if rng.random() < 0.5 else r for r in rows]
    return [" ".join(r) for r in rows]


def weighted(texts, frequencies):
    shingler, out = neardup.Shingler(), []
    for text in texts:
        hashes, counts = shingler.of(text)
        out.append(dict(zip(hashes.tolist(), (counts * frequencies[neardup.cells_of(hashes)].astype(np.float64)).tolist())))
    return out


def similarity(a, b):
    low = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a and b else 0.0


def test_near_duplicates_against_brute_force(spark, make):
    texts = corpus(random.Random(11))
    docs = make(list(enumerate(texts)))
    frequencies = neardup.inverse_frequencies(docs)
    weights = weighted(texts, frequencies)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(weights[i], weights[j]) >= 0.8]
    wanted = classes(range(len(texts)), links)
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert len(found) == len(texts)
    # no link that is not there
    assert all(wanted[i] == wanted[r.class_id] for i, r in found.items())
    linked = [(i, j) for i, j in links if found[i].class_id == found[j].class_id]
    assert len(linked) >= 0.98 * len(links)
    close = [(i, j) for i, j in links if similarity(weights[i], weights[j]) >= 0.9]
    assert all(found[i].class_id == found[j].class_id for i, j in close)
    assert all(r.kept == (r.class_id == i) for i, r in found.items())


def test_every_pair_of_a_large_bucket_counts(spark, make):
    """A group of over 1,000 with sub-variants, against all pairs that share a band."""
    rng = random.Random(8)
    base, texts = ["b%d" % i for i in range(150)], []
    for v in range(12):
        variant = noisy(rng, base, 0.02)
        texts += [" ".join(noisy(rng, variant, 0.012)) for _ in range(130)]
    texts = sorted(set(texts))
    assert len(texts) > 1000
    docs = make(list(enumerate(texts)))
    frequencies = neardup.inverse_frequencies(docs)
    signed = neardup.signatures(docs.select(F.col("doc_id").cast("string").cast("binary").alias("node"), "text"), frequencies)
    bands = np.array([b for _, b in sorted((int(r.node), r.bands) for r in signed.collect())])
    weights = weighted(texts, frequencies)
    shingles = {k: n for n, k in enumerate({k for w in weights for k in w})}
    held = np.zeros((len(texts), len(shingles)))  # the words differ, so each shingle occurs once
    for i, w in enumerate(weights):
        held[i, [shingles[k] for k in w]] = list(w.values())
    sums, low = held.sum(axis=1), held @ (held > 0).T
    near = low >= 0.8 * (sums[:, None] + sums[None, :] - low) - 1e-9
    links = [(i, int(j)) for i in range(len(texts)) for j in np.flatnonzero(near[i, :i] & (bands[:i] == bands[i]).any(axis=1))]
    wanted, counts = classes(range(len(texts)), links), np.bincount(np.array(links).ravel(), minlength=len(texts))
    found = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in found.items()} == wanted
    assert {i: r.n_links for i, r in found.items()} == dict(enumerate(counts.tolist()))


def test_samples_agree_as_often_as_texts_are_similar():
    rng, sampler = random.Random(3), neardup.Sampler(600)
    shingler = neardup.Shingler()
    base = ["v%d" % rng.randint(0, 500) for _ in range(400)]
    for share in (0.01, 0.05, 0.2):
        texts = [" ".join(base), " ".join(noisy(rng, base, share))]
        flat = np.full(neardup.CELLS, 1.5, np.float32)
        a, b = weighted(texts, flat)
        drawn = []
        for text in texts:
            hashes, counts = shingler.of(text)
            drawn.append(sampler.draw(hashes, counts * flat[neardup.cells_of(hashes)]))
        assert abs((drawn[0] == drawn[1]).mean() - similarity(a, b)) < 0.09


def test_shingles():
    shingler = neardup.Shingler()
    one = shingler.of("The cat, sat ON the mat")
    assert len(one[0]) == 2 and (one[0] == shingler.of("the CAT sat on the-mat")[0]).all()
    assert len(shingler.of("three words only")[0]) == 1 and len(shingler.of(" .,; ")[0]) == 0
    assert shingler.of("a b c d e a b c d e")[1].tolist().count(2) == 1


def test_near_duplicates_awkward(make, awkward):
    rows = neardup.near_duplicates(make(awkward + [(30, ""), (31, "SAME text, twice")])).collect()
    assert len(rows) == len(awkward) + 2
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.class_id, r.kept))
    assert by[1] == [(1, True)] and by[4] == [(4, True)] * 2 and by[31] == [(4, False)]
    assert by[2] == [(2, True)] and by[30] == [(2, False)] and by[None] == [(None, True)] * 2
    assert neardup.near_duplicates(make([])).count() == 0
    assert neardup.near_duplicates(make([(1, None), (2, "")])).count() == 2


def plain_vectors(rows, threshold=0.9):
    def usable(v):
        return v is not None and len(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    units = {k: np.array(v, float) / np.linalg.norm(np.array(v, float)) for k, v in rows if k is not None and usable(v)}
    links = [(a, b) for a in units for b in units
             if a < b and len(units[a]) == len(units[b]) and units[a] @ units[b] >= threshold]
    counts = {k: sum(k in p for p in links) for k, _ in rows}
    return counts, classes({k for k, _ in rows if k is not None}, links)


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, node string, cell int")


@pytest.mark.parametrize("margin", [embeddings.MARGIN, embeddings.EXACT])
def test_vectors_against_brute_force(spark, margin):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 16))
    near = [b + rng.normal(size=16) * s for b in base[:20] for s in (0.05, 0.1, 0.12, 0.3)]
    hot = [base[0] + rng.normal(size=16) * 0.1 for _ in range(150)]
    every = [v.astype(np.float32).tolist() for v in [*base, *near, *hot, *[base[1]] * 30]]
    rows = list(enumerate(every)) + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [float("inf")] + [1.0] * 15),
                                     (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [-0.0, 1.0]),
                                     (1009, [0.0, 1.0])]
    found = {r.vec_id: r for r in embeddings.near_duplicates(vectors(spark, rows), margin=margin, per_cell=32).collect()}
    counts, groups = plain_vectors(rows)
    assert len(found) == len(rows)
    assert {k: r.n_links for k, r in found.items()} == counts
    assert {k: r.component_id for k, r in found.items()} == groups
    assert all(r.kept == (r.component_id == k) for k, r in found.items())


@pytest.mark.parametrize("cosine", [0.92, 0.94, 0.96])
def test_links_between_dense_clusters(spark, monkeypatch, cosine):
    """Two clusters that each own a centre, all of whose members link across the border."""
    rng = np.random.default_rng(3)
    one, other = np.eye(16)[0], cosine * np.eye(16)[0] + math.sqrt(1 - cosine ** 2) * np.eye(16)[1]
    rows = list(enumerate((c + rng.normal(size=16) * 0.005).astype(np.float32).tolist() for c in [one, other] * 60))
    counts, groups = plain_vectors(rows)
    assert set(counts.values()) == {119}
    for values in (getattr(embeddings, "BLOCK_VALUES", 0), 16 * 25):  # cells in one block, and dealt over several
        monkeypatch.setattr(embeddings, "BLOCK_VALUES", values, raising=False)
        found = embeddings.near_duplicates(vectors(spark, rows), per_cell=60).collect()
        assert {r.vec_id: r.n_links for r in found} == counts and {r.component_id for r in found} == {0}


def test_vector_query_and_empty(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    counts, groups = plain_vectors(rows)
    found = {r.vec_id: r for r in queries.QUERIES["op7_embedding_near_dedup"](spark, folder).collect()}
    assert {k: (r.n_links, r.component_id) for k, r in found.items()} == {k: (counts[k], groups[k]) for k in groups}
    assert embeddings.near_duplicates(vectors(spark, [])).count() == 0
    odd = embeddings.near_duplicates(vectors(spark, [(None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])])).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.kept) for r in odd) == [(0, 0, False), (1, 0, True)]
