"""Whitening of vectors: Chebyshev-filtered subspace iteration over distributed passes.

Entries become integers ``x``, so that counts and sums are exact. With ``V`` the covariance of the ``n`` vectors, a *pass*
gives ``V Q`` for a narrow block ``Q``: every task takes its rows' ``Xc^T (Xc Q)``, with ``Xc`` centred first, and the
partial products are added by their row. Neither ``V`` nor a vector reaches the driver; only blocks of ``dimension`` times
``components + GUARDS`` values do.

* **Filter.** With the unwanted eigenvalues between ``low`` and ``high``, a Chebyshev polynomial of ``V``, which is bounded
  there and grows fast above, is applied to the block by its three-term recurrence, a pass for each degree. ``high`` is the
  block's least Ritz value; ``low`` comes from Lanczos steps that ride in the first filter's passes as one more column.
* **Rayleigh-Ritz.** After a QR decomposition one pass gives the projected matrix; its eigenvectors turn the block, and
  the turned pass is the first step of the next filter.
* **Locking.** Vectors whose residual is certified are set aside, the largest first, and projected out of later filters.
  The degree is bounded so that the largest eigenvalue left does not drown the smallest wanted one.
* **Certificate.** It ends when all wanted residuals are below ``TOLERANCE`` times the largest eigenvalue in a pass over
  all locked vectors together, whose product is also the covariance of the whitened vectors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Columns of the block beside the wanted ones.
GUARDS = 16
#: Residual, against the largest eigenvalue, at which a vector is certified; what is accepted if it falls no further.
TOLERANCE = 2e-14
ACCEPTED = 1e-10
#: Degrees of one filter, Lanczos steps, and the largest growth of one filter between wanted vectors.
DEGREE = 12
STEPS = 10
GROWTH = 1e5
MOST_PASSES = 2000
#: Entries beyond count as this.
_MOST = float(1 << 52)


def clean(vector: str = "vector"):
    """Whether a vector is there and holds no NULL and no non-finite entry."""
    column = F.col(vector)
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole_rows(column):
    """Entries of an Arrow list column, whose lists have one length, as integers ``floor(64 c)``."""
    import numpy as np

    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * rows), -_MOST, _MOST).astype(np.int64)


def sums(vectors: DataFrame, size: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sums of each dimension (without the offset)."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, n = [0] * size, 0
        for batch in batches:
            if batch.num_rows:
                x = whole_rows(batch.column(0))
                n += len(x)
                # 512 rows of at most 2 ** 52 stay below 2 ** 62
                for at in range(0, len(x), 512):
                    total = [a + b for a, b in zip(total, x[at:at + 512].sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size), pa.int32()), pa.array(list(map(str, [n, *total])))], ["i", "part"])

    found = arrow_map(vectors.select("vector"), run, "i int, part string").groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s"))
    by = {r["i"]: int(r["s"]) for r in found.collect()}  # one row per dimension
    return by.get(-1, 0), [by.get(i, 0) for i in range(size)]


class Covariance:
    """Passes over all vectors: ``V Q`` for blocks ``Q``, with ``V`` their centred covariance."""

    def __init__(self, vectors: DataFrame, size: int):
        import numpy as np

        self.vectors, self.size, self.passes = vectors, size, 0
        self.n, totals = sums(vectors, size)
        self.totals = totals
        #: The mean is ``base + rest / n``, with ``base`` whole, so that centred entries keep all their digits.
        self.base = [s // self.n for s in totals]
        self.rest = [s % self.n for s in totals]
        self.fine = np.array([r / self.n for r in self.rest])
        self.trace = None

    def times(self, block):
        """``V block``; the first pass takes the trace as well."""
        import numpy as np
        import pyarrow as pa

        size, width, first, centred = self.size, block.shape[1], self.trace is None, _centring(self.base, self.fine)
        names = [f"z{j}" for j in range(width)]

        def run(batches):
            total, squares, some = np.zeros((size, width)), 0.0, False
            for batch in batches:
                if batch.num_rows:
                    x = centred(whole_rows(batch.column(0)))
                    total += x.T @ (x @ block)
                    some = True
                    if first:
                        squares += float((x * x).sum())
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(np.full(size, squares)),
                                                  *(pa.array(c) for c in total.T)], ["i", "squares", *names])

        found = arrow_map(self.vectors.select("vector"), run, "i int, squares double, " + ", ".join(f"{c} double" for c in names))
        added = found.groupBy("i").agg(F.sum("squares").alias("squares"), *[F.sum(c).alias(c) for c in names])
        out = np.zeros((size, width))
        for row in added.collect():  # one row per dimension
            out[row["i"]] = row[2:]
            if first:
                self.trace = row["squares"] / self.n
        self.passes += 1
        return out / self.n


def _centring(base, fine):
    import numpy as np

    whole = np.array(base, np.int64)
    return lambda x: (x - whole).astype(np.float64) - fine


class Lanczos:
    """A lower bound of the spectrum from a Krylov space, grown by a vector a pass."""

    def __init__(self, start):
        import numpy as np

        self.vectors, self.alphas, self.betas = [start / np.linalg.norm(start)], [], []
        self.done = False

    def step(self, product) -> None:
        """Take ``V`` times the newest vector."""
        import numpy as np

        if self.done:
            return
        self.alphas.append(float(self.vectors[-1] @ product))
        known = np.array(self.vectors).T
        rest = product - known @ (known.T @ product)
        rest -= known @ (known.T @ rest)
        beta = float(np.linalg.norm(rest))
        self.betas.append(beta)
        self.done = len(self.alphas) >= STEPS or beta <= 1e-12 * max(map(abs, self.alphas)) or beta == 0
        if not self.done:
            self.vectors.append(rest / beta)

    def low(self) -> float:
        """What nearly no eigenvalue is below; 0 at least."""
        import numpy as np

        if not self.alphas:
            return 0.0
        inner = self.betas[:len(self.alphas) - 1]
        values = np.linalg.eigvalsh(np.diag(self.alphas) + np.diag(inner, 1) + np.diag(inner, -1))
        return max(0.0, float(values[0] - self.betas[-1]))


def degree(top: float, least: float, low: float, high: float) -> int:
    """The largest degree whose filter grows the largest eigenvalue left at most ``GROWTH`` times more than the least."""
    half, middle = (high - low) / 2, (high + low) / 2
    apart = math.acosh(max(1.0, (top - middle) / half)) - math.acosh(max(1.0, (least - middle) / half))
    return DEGREE if apart * DEGREE <= math.log(GROWTH) else max(2, int(math.log(GROWTH) / apart))


def components(cov: Covariance, wanted: int, guards: int = GUARDS):
    """``values, vectors, product``: certified leading eigenpairs of ``V``, and ``V vectors`` as the last pass gave it.

    Fewer than ``wanted`` where ``V`` has a smaller rank.
    """
    import numpy as np

    size = cov.size
    wanted = min(wanted, size)
    width = min(size, wanted + guards)
    rng = np.random.default_rng(13)
    block = np.linalg.qr(rng.normal(size=(size, width)))[0]
    lanczos = Lanczos(rng.normal(size=size)) if width < size else None
    locked = np.zeros((size, 0))
    best, stale, scale = math.inf, 0, 0.0

    def apart(y):
        return y - locked @ (locked.T @ y)

    def ritz(q, z):
        values, turn = np.linalg.eigh((q.T @ z + z.T @ q) / 2)
        turn = turn[:, ::-1]
        return values[::-1], q @ turn, z @ turn

    product = cov.times(block)
    while True:
        values, block, product = ritz(block, product)
        scale = max(scale, float(values[0]))
        if scale <= 0:
            return values[:0], block[:, :0], product[:, :0]
        rest = np.linalg.norm(apart(product) - block * values, axis=0)
        need = wanted - locked.shape[1]
        worst = float(rest[:need].max())
        stale = 0 if worst < best / 2 else stale + 1
        best = min(best, worst)
        accepted = ACCEPTED if stale >= 3 else TOLERANCE
        sure = rest[:need] <= accepted * scale
        ready = need if sure.all() else int(np.argmin(sure))
        if ready == need or width == size:
            vectors = np.linalg.qr(np.hstack([locked, block[:, :need]]))[0]
            values, vectors, product = ritz(vectors, cov.times(vectors))
            rest = np.linalg.norm(product - vectors * values, axis=0)
            if rest.max() > ACCEPTED * scale:
                raise RuntimeError(f"components not certified: residual {rest.max() / scale:.1e}")
            full = values > max(cov.n, size) * np.finfo(float).eps * scale
            return values[full], vectors[:, full], product[:, full]
        if cov.passes >= MOST_PASSES or stale > 20:
            raise RuntimeError(f"components not certified after {cov.passes} passes: residual {worst / scale:.1e}")
        locked = np.hstack([locked, block[:, :ready]])
        best = math.inf if ready else best
        block, product, values = block[:, ready:], apart(product[:, ready:]), values[ready:]
        need -= ready
        high = float(values[-1])
        low = lanczos.low() if lanczos.done else 0.0
        low = min(low, high * (1 - 1e-6)) if high > 0 else low
        half, middle = max((high - low) / 2, 1e-300 + 1e-12 * scale), (high + low) / 2
        times = degree(float(values[0]), float(values[need - 1]), middle - half, middle + half)
        # scaled so that the largest eigenvalue left keeps its size
        sigma = first = half / max(float(values[0]) - middle, half)
        before, now = block, (product - middle * block) * (first / half)
        for _ in range(times - 1):
            extra = [] if lanczos.done else [lanczos.vectors[-1][:, None]]
            passed = cov.times(np.hstack([now, *extra]))
            if extra:
                lanczos.step(passed[:, -1])
            after = 1 / (2 / first - sigma)
            step = apart(passed[:, :now.shape[1]]) - middle * now
            before, now, sigma = now, step * (2 * after / half) - before * (sigma * after), after
        now = apart(apart(now))
        size_of = np.linalg.norm(now, axis=0)
        block = np.linalg.qr(np.hstack([locked, now / np.where(size_of > 0, size_of, 1)]))[0][:, locked.shape[1]:]
        product = cov.times(block)
        product = apart(product)


def whitened(table: DataFrame, key: str = "vec_id", vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error``, for each vector and component up to ``count``.

    Entries ``c`` become ``floor(64 c) + 1000000`` (entries beyond 2**46 count as that). ``deviation`` is the exact sum of
    ``(n x - S)^2`` over the dimensions (NULL where a long cannot hold it), ``whitened`` the centred vector along the component
    over the root of its eigenvalue, ``explained`` the eigenvalue over the trace, ``identity_error`` how far the
    covariance of all whitened vectors is from the identity. Components are ordered by falling eigenvalue; their
    largest entry is positive.

    Vectors that are NULL or hold NULL or non-finite entries are left out; empty ones have no component. Keys are
    carried along: NULL or repeated keys and repeated rows count and give rows of their own. Vectors of another length
    are a population of their own, with its own ``n``. Directions in which nothing varies have no component, so equal vectors,
    or one alone, give no rows; an empty table gives an empty one. Other columns are not read.
    """
    kind = table.schema[key].dataType.simpleString()
    good = table.select(F.col(key).alias("key"), F.col(vector).alias("vector")).where(clean() & (F.size("vector") > 0))
    out = None
    for (size,) in good.select(F.size("vector")).distinct().collect():  # one row per length of vectors
        part = _one_length(good.where(F.size("vector") == size), size, count, kind)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = table.sparkSession.createDataFrame([], f"key {kind}, {COLUMNS}")
    return out.withColumnRenamed("key", key)


COLUMNS = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _one_length(vectors: DataFrame, size: int, count: int, kind: str) -> DataFrame:
    import numpy as np

    cov = Covariance(vectors, size)
    values, found, product = components(cov, count)
    if not len(values):
        return vectors.sparkSession.createDataFrame([], f"key {kind}, {COLUMNS}")
    sign = np.sign(found[np.abs(found).argmax(axis=0), np.arange(len(values))])
    roots = np.sqrt(values)
    error = float(np.abs((found.T @ product) / np.outer(roots, roots) - np.eye(len(values))).max())
    onto, n, base, rest, centred = found * sign / roots, cov.n, cov.base, cov.rest, _centring(cov.base, cov.fine)

    def run(batches):
        import pyarrow as pa

        whole, over = np.array(base, np.int64), np.array(rest, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_rows(batch.column(1))
            far = int(np.abs(x - whole).max()) * n + max(rest)
            if far * far * size < 1 << 62:
                y = n * (x - whole) - over
                deviation = pa.array((y * y).sum(axis=1), pa.int64())
            else:
                y = n * (x - whole).astype(object) - over.astype(object)
                exact = [int(v) for v in (y * y).sum(axis=1)]
                deviation = pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())
            along = centred(x) @ onto
            ends = np.arange(0, along.size + 1, along.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), deviation, pa.ListArray.from_arrays(pa.array(ends), pa.array(along.ravel()))],
                                             ["key", "deviation", "along"])

    rows = arrow_map(vectors, run, f"key {kind}, deviation long, along array<double>")
    rows = rows.select("key", "deviation", F.posexplode("along").alias("at", "whitened"))
    shares = F.array(*[F.lit(float(v)) for v in values / cov.trace])
    return rows.select("key", (F.col("at") + 1).alias("component"), F.lit(cov.n).cast("long").alias("n"), "deviation", "whitened",
                       F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
