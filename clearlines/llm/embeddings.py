"""Embedding near-duplicates: spherical k-means cells, packed in blocks, exact cosine products of block pairs.

Equal vectors are one row with a count. The centres are learned from a bounded sample; every vector belongs to the
cell of its nearest centre. Whole cells that are near each other are packed in blocks, and a cell of more rows than
a block is dealt over blocks of its own. Each pair of blocks is one task. A vector is sent to a pair only if the other
block holds a cell that can hold a partner, by two bounds that lose no pair of the threshold t:

* two unit vectors with cosine t are sqrt(2 - 2t) apart, and neither can be farther than that from the border
  between their cells;
* a partner is within acos(t) of the vector, and within its cell's radius of that cell's centre, so the vector's
  angle to the centre is at most their sum.

Where vectors have no structure the bounds keep nearly all pairs of blocks, and the products grow with the square of
the rows. Products are taken in single precision; those too close to the threshold to tell are taken again in
double. Links leave a task as counts and as a forest, never as pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map, staged
from clearlines.llm.components import connected_components

THRESHOLD = 0.9
#: Vectors per centre, the most centres (they travel to every task), and sampled vectors per centre.
PER_CELL = 1024
MOST_CELLS = 1024
SAMPLE_PER_CELL = 32
#: Vector components of a block: bounds what a task holds, whatever the length of the vectors.
BLOCK_VALUES = 1 << 20
#: Distance from a cell's border beyond which no vector has a partner of ``THRESHOLD`` there.
EXACT = math.sqrt(2 - 2 * THRESHOLD)
MARGIN = EXACT


def usable(vector: str = "vector"):
    """Whether a vector has a direction: no NULL or non-finite component, not empty and not zero."""
    column = F.col(vector)
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def unit_rows(column):
    """Unit rows (double) of an Arrow list column whose lists have one length."""
    import numpy as np

    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def learn_centres(vectors: DataFrame, cells: int, rounds: int = 8):
    """Spherical k-means over a bounded sample, those with the smallest hashes: unit centres."""
    import numpy as np

    size = cells * SAMPLE_PER_CELL
    rows = vectors.select("vector", F.xxhash64("vector").alias("order")).orderBy("order", "vector").limit(size)
    found = rows.select("vector").toArrow().column("vector").combine_chunks()  # at most MOST_CELLS * SAMPLE_PER_CELL
    points = unit_rows(found)
    centres = points[:: max(1, len(points) // cells)][:cells].copy()
    for _ in range(rounds):
        near = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        length = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    return centres


def assign(vectors: DataFrame, centres) -> DataFrame:
    """``cell, rows, angle``: of each cell that has rows, their number and the largest angle to its centre."""
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                near = unit_rows(batch.column(0)) @ centres.T
                home = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(home)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(angle)], ["cell", "angle"])

    found = arrow_map(vectors.select("vector"), run, "cell int, angle double")
    return found.groupBy("cell").agg(F.count("*").alias("rows"), F.max("angle").alias("angle"))


def packed(centres, rows, block: int):
    """First block and number of blocks of each cell: cells in a chain of near centres fill blocks of ``block`` rows."""
    import numpy as np

    left, at = np.ones(len(centres), bool), 0
    first, number = np.zeros(len(centres), np.int64), np.ones(len(centres), np.int64)
    held, current = 0, 0
    for _ in range(len(centres)):
        left[at] = False
        if held and held + rows[at] > block:
            current, held = current + 1, 0
        first[at], number[at] = current, max(1, -(-int(rows[at]) // block))
        if number[at] > 1:
            current, held = current + int(number[at]), 0
        else:
            held += int(rows[at])
        at = int(np.where(left, centres @ centres[at], -2).argmax())
    return first, number


def block_pairs(vectors: DataFrame, centres, cells: list, threshold: float, margin: float, block: int) -> DataFrame:
    """``a, b, own, node, copies, vector``: each vector in its block's pairs with itself (``a = b``) and with the blocks
    that can hold a partner; ``own`` marks the rows of block ``a``. ``cells`` has ``cell, rows, angle``."""
    import numpy as np

    rows, radius = np.zeros(len(centres), np.int64), np.full(len(centres), -np.inf)
    for cell in cells:
        rows[cell["cell"]], radius[cell["cell"]] = cell["rows"], cell["angle"]
    first, number = packed(centres, rows, block)
    count = int((first + number).max())
    # least cosine to a centre that a vector with a partner in its cell can have (2: an empty cell has none)
    least = np.cos(np.clip(radius + math.acos(max(-1.0, min(1.0, threshold))), 0, math.pi)) - 1e-9
    least = np.where(rows > 0, least, 2.0)

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        # which blocks hold a cell
        holds = np.zeros((len(centres), count), np.float32)
        for cell in range(len(centres)):
            holds[cell, first[cell]:first[cell] + number[cell]] = 1
        for batch in batches:
            if not batch.num_rows:
                continue
            near = unit_rows(batch.column(2)) @ centres.T
            home, every = near.argmax(axis=1), np.arange(len(near))
            best = near[every, home]
            shown = (best[:, None] - near <= margin * apart[home] + 1e-9) & (near >= least)
            shown[every, home] = True
            spread = batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            mine = first[home] + (spread % number[home].astype(np.uint64)).astype(np.int64)
            row, other = np.nonzero(shown.astype(np.float32) @ holds)
            a, b = np.minimum(mine[row], other), np.maximum(mine[row], other)
            for at in range(0, len(row), 4096):
                part = slice(at, at + 4096)
                out = batch.take(pa.array(row[part]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[part].astype(np.int32)), pa.array(b[part].astype(np.int32)), pa.array(mine[row[part]] == a[part]),
                     *out.columns], ["a", "b", "own", "node", "copies", "vector"])

    return arrow_map(vectors.select("node", "copies", "vector"), run, "a int, b int, own boolean, node long, copies long, "
                     f"vector {vectors.schema['vector'].dataType.simpleString()}")


def link_blocks(paired: DataFrame, threshold: float) -> DataFrame:
    """``node, root, links`` per pair of blocks: links counted for the rows of both, and rays of a forest of links."""
    def run(keys, table):
        import numpy as np
        import pyarrow as pa

        same = keys[0].as_py() == keys[1].as_py()
        own = table.column("own").to_numpy()
        ids, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        rows = unit_rows(table.column("vector").combine_chunks())
        single = rows.astype(np.float32)
        left = np.flatnonzero(own)
        right = left if same else np.flatnonzero(~own)
        # more than the rounding of a product in single precision
        slack = np.float32((rows.shape[1] + 8) * 2.0 ** -22)
        links, label = np.zeros(len(ids), np.int64), np.arange(len(ids))
        across = np.ascontiguousarray(single[right].T)
        for at in range(0, len(left), 256):
            some = left[at:at + 256]
            near = single[some] @ across
            i, j = np.nonzero(near >= np.float32(threshold) - slack)
            unsure = np.flatnonzero(near[i, j] <= np.float32(threshold) + slack)
            sure = np.ones(len(i), bool)
            for k in range(0, len(unsure), 4096):
                part = unsure[k:k + 4096]
                sure[part] = np.einsum("ij,ij->i", rows[some[i[part]]], rows[right[j[part]]]) >= threshold
            i, j = some[i], right[j]
            sure &= i != j
            i, j = i[sure], j[sure]
            links += np.bincount(i, copies[j], len(ids)).astype(np.int64)
            if not same:
                links += np.bincount(j, copies[i], len(ids)).astype(np.int64)
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for one, others in zip(i[starts], np.split(j, starts[1:])):
                found = np.unique(np.append(label[others], label[one]))
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
        linked = np.flatnonzero(links)
        return pa.table({"node": pa.array(ids[linked], pa.int64()), "root": pa.array(ids[label[linked]], pa.int64()),
                         "links": pa.array(links[linked], pa.int64())})

    return paired.groupBy("a", "b").applyInArrow(run, "node long, root long, links long")


def near_duplicates(table: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
                    margin: float | None = None, per_cell: int = PER_CELL) -> DataFrame:
    """``key, n_links, component_id, kept``, a row for each distinct key and vector: linked rows, the smallest key that links reach, and
    whether that is the row's own.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, and vectors link
    only with those of their length. Keys must be integers; rows that repeat a key and a vector are one row; rows with
    NULL keys link with nothing (component NULL, not kept). Ties between centres go to
    the first. Cosines are those of double precision; those of equal vectors count as 1. No link is lost: ``margin``
    can be wider than the threshold's, never narrower. Other columns are not read.
    """
    margin = max(margin or 0.0, math.sqrt(max(0.0, 2 - 2 * threshold)))
    element = table.schema[vector].dataType.elementType
    # adding zero turns -0.0 into 0.0, so that equal vectors are equal in every step
    rows = table.select(F.col(key).alias("key"), F.transform(F.col(vector), lambda x: x + F.lit(0).cast(element)).alias("vector")).distinct()
    good = rows.where(F.col("key").isNotNull() & usable())
    unique = good.groupBy("vector").agg(F.min("key").alias("low"), F.count("*").alias("copies"))
    unique = staged(unique.withColumn("node", F.monotonically_increasing_id()), "vectors")
    links = None
    for (length,) in unique.select(F.size("vector")).distinct().collect():  # one row per length of vectors
        same = unique.where(F.size("vector") == length)
        cells = max(1, min(MOST_CELLS, math.ceil(same.count() / per_cell)))
        centres = learn_centres(same, cells)
        sizes = assign(same, centres).collect()  # at most MOST_CELLS rows
        paired = block_pairs(same, centres, sizes, threshold, margin, max(1, BLOCK_VALUES // length))
        found = link_blocks(paired, threshold)
        links = found if links is None else links.unionByName(found)
    if links is None:
        links = table.sparkSession.createDataFrame([], "node long, root long, links long")
    links = staged(links, "links")
    groups = connected_components(links.select(F.col("node").alias("left"), F.col("root").alias("right")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    named = unique.join(groups, "node", "left").join(counts, "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = staged(named.join(lows, "component").select(
        "vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    salt = F.pmod(F.xxhash64("key"), F.lit(16)).cast("int")
    keyed = good.select("key", "vector").withColumn("salt", salt)
    salted = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    linked = keyed.join(salted, ["vector", "salt"]).select("key", "n_links", "component_id")
    lone = rows.where(F.col("key").isNull() | ~usable()).select(
        "key", F.lit(0).cast("long").alias("n_links"), F.col("key").cast("long").alias("component_id"))
    both = linked.unionByName(lone)
    return both.select(F.col("key").alias(key), "n_links", "component_id",
                       F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
