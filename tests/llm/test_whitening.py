"""Whitened vectors against the eigenvectors of the whole covariance matrix."""

import math

import numpy as np
import pytest

from clearlines.llm import queries, whitening


def vectors(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, n string, component int")


def plain(rows):
    """Deviations, whitened rows and shares from an exact covariance."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    exact = [[n * a - s for a, s in zip(v, sums)] for v in x]
    centred = np.array([[a / n for a in v] for v in exact])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    values, found = values[::-1], found[:, ::-1]
    return [sum(a * a for a in v) for v in exact], centred, values, found


def check(spark, rows, count=32):
    found = whitening.whitened(vectors(spark, list(enumerate(rows))), count=count).collect()
    deviations, centred, values, axes = plain(rows)
    wanted = int((values[:count] > 1e-9 * values[0]).sum())
    assert len(found) == len(rows) * wanted
    by = np.zeros((len(rows), wanted))
    for r in found:
        by[r.vec_id, r.component - 1] = r.whitened
        assert r.deviation == (deviations[r.vec_id] if deviations[r.vec_id] < 1 << 63 else None) and r.n == len(rows)
        assert abs(r.explained * values.sum() / values[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
    assert np.abs(by.T @ by / len(rows) - np.eye(wanted)).max() < 1e-8
    for j in range(wanted):  # each eigenvalue of these tables stands alone
        one = centred @ axes[:, j] / math.sqrt(values[j])
        assert min(np.abs(by[:, j] - one).max(), np.abs(by[:, j] + one).max()) < 1e-7


def test_filter_against_whole_matrix(spark):
    """80 dimensions: unwanted directions beyond the block, a nearly flat spectrum."""
    rng = np.random.default_rng(1)
    check(spark, rng.normal(size=(700, 80)).tolist())


def test_wide_spectrum(spark):
    """Eigenvalues over twelve orders of magnitude, some of them in the block's guards."""
    rng = np.random.default_rng(2)
    turn = np.linalg.qr(rng.normal(size=(70, 70)))[0]
    rows = rng.normal(size=(400, 70)) * np.logspace(6, 0, 70) @ turn
    check(spark, rows.tolist())


def test_small_rank_and_few_dimensions(spark):
    rng = np.random.default_rng(3)
    check(spark, (rng.integers(-40, 40, size=(300, 5)) / 64).tolist())
    low = rng.integers(-9, 9, size=(200, 3)) @ rng.integers(-9, 9, size=(3, 60))
    check(spark, (low / 64).tolist())
    check(spark, rng.normal(size=(50, 60)).tolist(), count=4)


def test_awkward_rows(spark):
    one = [[0.5, 1.0], [0.25, -1.0], [0.0, 0.75]]
    odd = [(5, None), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [1.0, float("-inf")]), (9, [])]
    rows = [(0, one[0]), (1, one[1]), (2, one[2]), (2, one[2]), (None, one[0])] + odd
    found = whitening.whitened(vectors(spark, rows)).collect()
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.component, r.n) for r in found) == sorted(
        (k, c, 5) for k in (-1, 0, 1, 2, 2) for c in (1, 2))
    other = whitening.whitened(vectors(spark, rows + [(20, [1.0]), (21, [2.0]), (22, [2.0])])).collect()
    assert sorted({(r.n, r.component) for r in other}) == [(3, 1), (5, 1), (5, 2)]
    huge = whitening.whitened(vectors(spark, [(0, [1e300, 1.0]), (1, [-1e300, 2.0]), (2, [0.0, 5.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id < 2} == {None} and all(math.isfinite(r.whitened) for r in huge)
    for none in ([], odd, [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        assert whitening.whitened(vectors(spark, none)).count() == 0


@pytest.mark.parametrize("top, least, low, high", [(10.0, 2.0, 0.5, 1.0), (1e12, 1.1, 0.0, 1.0), (1.0, 1.0, 0.0, 1.0)])
def test_degree_bounds_growth(top, least, low, high):
    m = whitening.degree(top, least, low, high)
    grown = lambda v: math.acosh(max(1.0, (v - (high + low) / 2) / ((high - low) / 2)))
    assert 2 <= m <= whitening.DEGREE and (m == 2 or m * (grown(top) - grown(least)) <= math.log(whitening.GROWTH) + 1e-9)


def test_query(spark, folder):
    rows = [r.embedding for r in spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()]
    ids = [r.vec_id for r in spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id").orderBy("vec_id").collect()]
    deviations, centred, values, axes = plain(rows)
    found = queries.QUERIES["op13_embedding_whitening"](spark, folder).collect()
    assert len(found) == 32 * len(rows)
    by = {(r.vec_id, r.component): r for r in found}
    for j in range(32):
        one = centred @ axes[:, j] / math.sqrt(values[j])
        mine = np.array([by[k, j + 1].whitened for k in ids])
        assert min(np.abs(mine - one).max(), np.abs(mine + one).max()) < 1e-8
    assert [by[k, 1].deviation for k in ids] == deviations
