"""Largest inner products against all pairs, and the bounds of the trees."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearlines.llm import covertree, queries


def plain(rows, asks, k=5):
    """Whole-number products of all pairs; rows are distinct pairs of key and vector."""
    good = {(key, tuple(v)) for key, v in rows if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(key, [math.floor(256 * x) for x in v]) for key, v in good]
    out = []
    for key, q in whole:
        if asks(key):
            scored = sorted((-sum(a * b for a, b in zip(q, d)), other) for other, d in whole if other != key and len(d) == len(q))
            out += [(key, rank + 1, other, -score) for rank, (score, other) in enumerate(scored[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1, 2.0) for k, v in rows], "vec_id long, embedding array<double>, node string, tag int, low double")


def found(spark, rows, step, **bounds):
    out = covertree.top_inner_products(table(spark, rows), F.col("vec_id") % step == 0, **bounds).collect()
    return sorted((r.query, r.rank, r.vec_id, r.score) for r in out)


def clustered(rng, n, dim):
    centres = rng.normal(size=(12, dim)) * 3
    return [(centres[i % 12] + rng.normal(size=dim) * 0.1 * (1 + i % 5)).tolist() for i in range(n)]


@pytest.mark.parametrize("bounds", [{}, {"query_rows": 20, "data_rows": 60}])
def test_against_all_pairs(spark, bounds):
    """Clusters, noise, ties, a vector of a third of all rows; with one block and with many."""
    rng = np.random.default_rng(5)
    rows = list(enumerate(clustered(rng, 400, 8) + rng.normal(size=(150, 8)).tolist() + [[0.5] * 8] * 250))
    rows += [(k, [float(x) for x in rng.integers(-2, 3, size=8)]) for k in range(1000, 1100)]
    assert found(spark, rows, 5, **bounds) == plain(rows, lambda k: k % 5 == 0)


def test_awkward_rows(spark):
    one, nan, far = [1.0, 2.0], float("nan"), float("inf")
    rows = [(0, one), (0, one), (0, [3.0, 1.0]), (1, one), (2, [-0.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [far, 1.0]),
            (6, [None, 1.0]), (None, one), (7, []), (8, []), (9, [1.0]), (10, [2.0]), (12, [1.0, 2.0, 3.0])]
    assert [r for r in found(spark, rows, 1) if r[0] != 2] == [r for r in plain(rows, lambda k: True) if r[0] != 2]
    for none in ([], [(3, None)], [(1, one)], [(51, one), (52, one)]):
        assert found(spark, none, 50) == []
    assert found(spark, [(0, one), (1, one)], 50) == [(0, 1, 1, 256 * 256 * 5)]


def test_huge_components(spark):
    """Products beyond double precision are exact, and what a long cannot hold is its end."""
    rows = [(i, [float(2 ** 21 + i), float(2 ** 21 - i), 1.0]) for i in range(12)]
    assert found(spark, rows, 3) == plain(rows, lambda k: k % 3 == 0)
    rows = [(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 1.0])]
    assert found(spark, rows, 3) == [(0, 1, 1, 2 ** 63 - 1), (0, 2, 2, -2 ** 63)]


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(6)
    values = np.floor(256 * np.array(clustered(rng, 3000, 8)))
    tree = covertree.cover_tree(values, leaf=20)
    seen, nodes, open_ = [], [], [tree]
    while open_:
        node = open_.pop()
        nodes.append(node)
        assert np.sqrt(((values[node.rows] - node.centre) ** 2).sum(axis=1)).max() <= node.radius + 1e-6
        seen += [] if node.children else node.rows.tolist()
        open_ += node.children
    assert sorted(seen) == list(range(3000))
    for a, b in rng.integers(0, len(nodes), size=(300, 2)):
        assert (values[nodes[a].rows] @ values[nodes[b].rows].T).max() <= covertree.bound(nodes[a], nodes[b])


def test_distant_nodes_are_left_out(spark, monkeypatch):
    """Rows go only to blocks that their node's worst score cannot rule out."""
    rng = np.random.default_rng(7)
    rows = list(enumerate(clustered(rng, 1200, 8)))
    sent = []
    real = covertree.searched

    def counted(met, k):
        sent.append(met.count())
        return real(met, k)

    monkeypatch.setattr(covertree, "searched", counted)
    assert found(spark, rows, 10, query_rows=10, data_rows=100) == plain(rows, lambda k: k % 10 == 0)
    assert sent[1] < 12 * (1200 + 120) / 2


def test_query(spark, folder):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    out = queries.QUERIES["op11_exact_top_k"](spark, folder)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == plain(rows, lambda k: k % 50 == 0)
