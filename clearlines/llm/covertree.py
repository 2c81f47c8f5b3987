"""Exact largest inner products: dual-tree search over cover trees, above and inside of tasks.

Queries and data share one tree. Its upper part is a net of centres by farthest-first traversal of a bounded sample:
the first ``j`` centres are a coarser net of the same tree, so queries are grouped at one level and data at another.
Every row belongs to its nearest centre; what a node covers is measured over all its rows. Within a task a tree goes on
downwards in the same way: a node's rows go to their nearest of ``FANOUT`` centres, chosen farthest first, each with the
radius that covers its rows, down to leaves of ``LEAF`` rows.

For a node of queries (centre ``c``, radius ``r``) and one of data (``d``, ``s``) no inner product exceeds
``c.d + r |d| + s |c| + r s``. A pair of nodes is left out if that is below the worst k-th score of its queries:

* first each query meets one block of the data node nearest to it, which gives k-th scores to start with;
* then pairs of upper nodes are pruned with the worst of these, rows are sent to the blocks of the pairs that are left,
  and in each task pairs of lower nodes are pruned in order of their bounds.

Scores are exact integers. Where vectors have no structure, the bounds leave nearly all pairs, and the products grow with
queries times rows; blocks keep what a task holds bounded, and no pair of rows is ever a row of a table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map, staged

SCALE = 256
#: Vectors, and vector components, of the sample that the upper net is fitted on, and its most centres.
SAMPLE = 8192
SAMPLE_VALUES = 1 << 22
MOST_CENTRES = 1024
#: Vector components of a block of queries or data, the least rows of a block, and nodes for lengths the sample has not.
BLOCK_VALUES = 1 << 22
LEAST_ROWS = 2048
SPARE = 64
FANOUT = 16
LEAF = 256
#: Quantised components beyond count as this.
_MOST = float(1 << 62)


def usable(vector: str = "vector"):
    """Whether a vector is there and holds no NULL and no non-finite component."""
    column = F.col(vector)
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def by_length(column):
    """``rows, values`` for each length of vectors in an Arrow list column: row numbers and quantised vectors."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore"):
        flat = np.clip(np.floor(SCALE * flat), -_MOST, _MOST)
    sizes = np.diff(column.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def farthest_first(values, most: int, enough: float = 0.0):
    """Rows chosen as centres, nearest centre and distance of every row; ends at ``most`` or at radius ``enough``."""
    import numpy as np

    distance = np.full(len(values), np.inf)
    near, chosen, at = np.zeros(len(values), np.int64), [], 0
    for number in range(min(most, len(values))):
        if number:
            at = int(distance.argmax())
            if distance[at] <= enough:
                break
        chosen.append(at)
        away = np.sqrt(((values - values[at]) ** 2).sum(axis=1))
        closer = away < distance
        near[closer], distance[closer] = number, away[closer]
    return chosen, near, distance


@dataclass(eq=False)
class Node:
    """Rows that a ball around ``centre`` covers."""

    rows: object
    centre: object
    radius: float
    children: list
    worst: float = -math.inf

    @property
    def length(self) -> float:
        return math.sqrt(float(self.centre @ self.centre))


def cover_tree(values, leaf: int = LEAF) -> Node:
    """The tree over all rows of ``values``. Equal rows share a leaf, however many."""
    import numpy as np

    middle = values.mean(axis=0)
    root = Node(np.arange(len(values)), middle, float(np.sqrt(((values - middle) ** 2).sum(axis=1)).max()), [])
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        inside = values[node.rows]
        chosen, near, distance = farthest_first(inside, FANOUT)
        if len(chosen) == 1:  # all rows are equal
            node.centre, node.radius = inside[0], 0.0
            continue
        for number, at in enumerate(chosen):
            mine = near == number
            node.children.append(Node(node.rows[mine], inside[at], float(distance[mine].max()), []))
        open_ += node.children
    return root


def bound(a: Node, b: Node) -> float:
    """What no inner product of their rows exceeds, rounding included."""
    most = float(a.centre @ b.centre) + a.radius * b.length + b.radius * a.length + a.radius * b.radius
    return most + 1e-9 * (a.length + a.radius) * (b.length + b.radius) + 1e-9


def products(a, b):
    """Exact inner products of whole rows: in double precision where that is exact, else in Python integers."""
    import numpy as np

    if not len(a) or not len(b) or float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2.0 ** 53:
        return a @ b.T
    whole = lambda x: np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def below(score) -> float:
    """A double that is not above the whole number ``score``."""
    return float(score) if abs(score) <= 2 ** 53 else math.nextafter(float(score), -math.inf)


class Best:
    """The ``k`` best ``score, id`` of each query so far; a score below a query's floor cannot be among them."""

    def __init__(self, queries: int, k: int, floor):
        self.k, self.floor = k, floor
        self.held = [[] for _ in range(queries)]

    def add(self, query: int, scores, ids) -> None:
        """More ``scores`` and ``ids``, aligned."""
        held = sorted(self.held[query] + [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())])[:self.k]
        self.held[query] = held
        if len(held) == self.k:
            self.floor[query] = max(self.floor[query], below(-held[-1][0]))


def dual_search(queries, query_ids, data, data_ids, k: int, floor) -> Best:
    """Best data rows of each query; rows with the query's own id are none of its candidates."""
    import heapq

    import numpy as np

    best = Best(len(queries), k, floor)
    left, right = cover_tree(queries), cover_tree(data)
    number, heap = 0, []

    def push(a: Node, b: Node) -> None:
        nonlocal number
        heapq.heappush(heap, (-bound(a, b), number, a, b))
        number += 1

    push(left, right)
    while heap:
        most, _, a, b = heapq.heappop(heap)
        if -most < float(best.floor[a.rows].min()):
            continue
        if a.children and (not b.children or a.radius >= b.radius):
            for child in a.children:
                push(child, b)
        elif b.children:
            for child in b.children:
                push(a, child)
        else:
            for at in range(0, len(b.rows), 4096):
                some = b.rows[at:at + 4096]
                found = products(queries[a.rows], data[some])
                hit = (found >= best.floor[a.rows][:, None]).astype(bool) & (query_ids[a.rows][:, None] != data_ids[some][None, :])
                for i in np.flatnonzero(hit.any(axis=1)):
                    scores, ids = found[i][hit[i]], data_ids[some][hit[i]]
                    if len(scores) > k:  # the k best scores, with all that tie
                        enough = scores >= np.sort(scores)[-k]
                        scores, ids = scores[enough], ids[enough]
                    best.add(int(a.rows[i]), scores, ids)
    return best


class Net:
    """The upper net: centres for each length of vectors, the same for queries and data at levels of their own."""

    def __init__(self, sample: DataFrame, most: int):
        self.centres, self.first, at = {}, {}, 0
        column = sample.toArrow().column("vector").combine_chunks()  # bounded by SAMPLE and SAMPLE_VALUES
        for _, values in by_length(column) if len(column) else ():
            chosen, _, _ = farthest_first(values, most)
            size = values.shape[1]
            self.centres[size], self.first[size] = values[chosen], at
            at += len(chosen)
        self.spare = at
        self.nodes = at + SPARE

    def place(self, values, level: int):
        """Node of each row, and its distance to the centre (to the origin for lengths without centres)."""
        import numpy as np

        size = values.shape[1]
        centres = self.centres.get(size)
        if centres is None:
            return np.full(len(values), self.spare + size % SPARE), np.sqrt((values * values).sum(axis=1))
        centres = centres[:level]
        near, distance = np.empty(len(values), np.int64), np.empty(len(values))
        lengths = (centres * centres).sum(axis=1)
        for at in range(0, len(values), 1024):
            some = values[at:at + 1024]
            near[at:at + 1024] = mine = (lengths - 2 * some @ centres.T).argmin(axis=1)
            distance[at:at + 1024] = np.sqrt(((some - centres[mine]) ** 2).sum(axis=1))
        return self.first[size] + near, distance

    def node(self, number: int, radius: float) -> Node | None:
        """The node with its radius; None for lengths without centres."""
        for size, centres in self.centres.items():
            if 0 <= number - self.first[size] < len(centres):
                return Node(None, centres[number - self.first[size]], radius, [])
        return None


@dataclass
class Level:
    """How many centres a side uses, and rows, radius and blocks of its nodes."""

    level: int
    rows: dict
    radius: dict
    blocks: dict


def measured(rows: DataFrame, net: Net, level: int, most: int) -> Level:
    """Rows and covering radius of every node, over all rows."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                for _, values in by_length(batch.column(0)):
                    near, distance = net.place(values, level)
                    yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), pa.array(distance)], ["node", "distance"])

    found = arrow_map(rows.select("vector"), run, "node int, distance double")
    found = found.groupBy("node").agg(F.count("*").alias("rows"), F.max("distance").alias("radius")).collect()  # at most net.nodes
    return Level(level, {r["node"]: r["rows"] for r in found}, {r["node"]: r["radius"] for r in found},
                 {r["node"]: max(1, -(-r["rows"] // most)) for r in found})


def dealt(queries: DataFrame, data: DataFrame, net: Net, left: Level, right: Level, pairs: dict, seeds: bool) -> DataFrame:
    """Rows of both sides, once for each block pair that they meet in. ``pairs``: data nodes of each query node; with
    ``seeds`` each query node meets one block of its nearest data node only."""
    back: dict[int, list[int]] = {}
    for a, others in pairs.items():
        for b in others:
            back.setdefault(b, []).append(a)

    def run_side(query: bool):
        mine, theirs, level = (left, right, left.level) if query else (right, left, right.level)
        met = pairs if query else back

        def run(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                if not batch.num_rows:
                    continue
                column = batch.schema.get_field_index("vector")
                spread = batch.column(batch.schema.get_field_index("tag")).to_numpy().astype(np.uint64) >> np.uint64(20)
                keys: list[list[int]] = [[], [], [], [], []]
                for rows, values in by_length(batch.column(column)):
                    node, _ = net.place(values, level)
                    for row, at in zip(rows.tolist(), node.tolist()):
                        part = int(spread[row]) % mine.blocks[at]
                        if seeds and not query and part:
                            continue
                        for other in met.get(at, ()):
                            for block in range(1 if seeds and query else theirs.blocks[other]):
                                for k, v in zip(keys, (row, *((at, part, other, block) if query else (other, block, at, part)))):
                                    k.append(v)
                for at in range(0, len(keys[0]), 4096):
                    some = [k[at:at + 4096] for k in keys]
                    out = batch.take(pa.array(some[0], pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(pa.array(k, pa.int32()) for k in some[1:]), *out.columns],
                                                     ["a", "part", "b", "block", *out.schema.names])

        return run

    kind = data.schema["vector"].dataType.simpleString()
    schema = f"a int, part int, b int, block int, asks boolean, key long, tag long, low double, vector {kind}"
    return arrow_map(queries, run_side(True), schema).unionByName(arrow_map(data, run_side(False), schema))


def searched(met: DataFrame, k: int) -> DataFrame:
    """``key, tag, other, score`` of each pair of blocks: the best ``k`` of each query there, none below its floor."""
    def run(table):
        import numpy as np
        import pyarrow as pa

        column = table.column("vector").combine_chunks()
        asks, keys = table.column("asks").to_numpy(), table.column("key").to_numpy()
        tags, low = table.column("tag").to_numpy(), table.column("low").to_numpy()
        out: list[list] = [[], [], [], []]
        for rows, values in by_length(column):
            sides = []
            for side in (asks[rows], ~asks[rows]):
                at = rows[side]
                # rows that repeat an id and a vector are one row
                _, one = np.unique(np.stack([keys[at], tags[at]], axis=1), axis=0, return_index=True)
                sides.append((at[one], values[side][one]))
            (q, queries), (d, data) = sides
            if len(q) and len(d):
                best = dual_search(queries, keys[q], data, keys[d], k, low[q].copy())
                for at, held in zip(q.tolist(), best.held):
                    for score, other in held:
                        for column, v in zip(out, (keys[at], tags[at], other, max(-2 ** 63, min(2 ** 63 - 1, int(-score))))):
                            column.append(v)
        return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("key", "tag", "other", "score"), out)})

    return met.groupBy("a", "part", "b", "block").applyInArrow(run, "key long, tag long, other long, score long")


def top_inner_products(table: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5,
                       query_rows: int | None = None, data_rows: int | None = None) -> DataFrame:
    """``query, rank, key, score``: for each row of ``table`` that fulfils ``asks`` the ``k`` other rows of largest inner product.

    Components become ``floor(256 x)``. Equal scores go to the smaller key. A row is a key and a vector: rows that repeat both are
    one, a key of two vectors is two rows, and no row with the query's own key is its candidate. Vectors that are NULL or
    hold NULL or non-finite components, and rows with NULL keys, take no part; vectors meet those of their length only.
    Components that do not fit count as 2**62, scores as the end of a long. A query without other rows has no
    rows; fewer than ``k`` others are all returned; an empty table gives an empty one. Other columns are not read.
    ``query_rows`` and ``data_rows`` bound the rows of a block (by default by their components).
    """
    spark = table.sparkSession
    rows = table.select(asks.alias("asks"), F.col(key).cast("long").alias("key"), F.col(vector).alias("vector"))
    rows = rows.where(F.col("key").isNotNull() & usable()).withColumn("asks", F.coalesce("asks", F.lit(False)))
    rows = rows.withColumn("tag", F.xxhash64("key", "vector"))
    count, wide, asking = rows.agg(F.count("*"), F.max(F.size("vector")), F.sum(F.col("asks").cast("long"))).first()
    if not asking:
        return spark.createDataFrame([], "query long, rank int, key long, score long").withColumnRenamed("key", key)
    whole, tasks = max(1, BLOCK_VALUES // max(1, wide)), int(spark.conf.get("spark.sql.shuffle.partitions"))
    data_rows = data_rows or min(whole, max(LEAST_ROWS, -(-count // tasks)))
    query_rows = query_rows or whole
    sample = rows.orderBy("tag", "key").limit(max(1, min(SAMPLE, SAMPLE_VALUES // max(1, wide)))).select("vector")
    level = lambda n, most: max(1, min(MOST_CENTRES, -(-n // most)))
    net = Net(sample, level(count, min(data_rows, query_rows)))
    queries, data = rows.where("asks").withColumn("low", F.lit(-math.inf)), rows.withColumn("asks", F.lit(False)).withColumn("low", F.lit(-math.inf))
    columns = ["asks", "key", "tag", "low", "vector"]
    left = measured(queries, net, level(asking, query_rows), query_rows)
    right = measured(data, net, level(count, data_rows), data_rows)
    nearest = {a: [_nearest(net, a, right)] for a in left.rows}
    first = searched(dealt(queries.select(columns), data.select(columns), net, left, right, nearest, True), k)
    first = first.groupBy("key", "tag").agg(F.count("*").alias("found"), F.min("score").alias("kth"))
    # a double that is not above the k-th score; none where that may lie beyond a long
    floor = F.col("kth").cast("double") - F.abs(F.col("kth").cast("double")) * F.lit(2.0 ** -52)
    floors = first.where((F.col("found") >= k) & (F.col("kth") > -(2 ** 62))).select("key", "tag", floor.alias("floor"))
    queries = queries.join(floors, ["key", "tag"], "left").withColumn("low", F.coalesce("floor", "low")).drop("floor")
    queries = staged(queries.select(columns), "queries")
    worst = _worst(queries, net, left)
    pairs = {a: [b for b in right.rows if _may_hold(net, left, right, a, b, worst[a])] for a in left.rows}
    found = searched(dealt(queries, data.select(columns), net, left, right, pairs, False), k)
    order = Window.partitionBy("key", "tag").orderBy(F.col("score").desc(), "other")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("key").alias("query"), "rank", F.col("other").alias(key), "score")


def _nearest(net: Net, a: int, right: Level) -> int:
    """The data node that is nearest to the centre of query node ``a``."""
    mine = net.node(a, 0.0)
    if mine is None:
        return a
    others = [(float(((n.centre - mine.centre) ** 2).sum()), b) for b in right.rows
              if (n := net.node(b, 0.0)) and len(n.centre) == len(mine.centre)]
    return min(others)[1]


def _worst(queries: DataFrame, net: Net, left: Level) -> dict:
    """The worst k-th score so far of each query node."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                low = batch.column(1).to_numpy()
                for rows, values in by_length(batch.column(0)):
                    node, _ = net.place(values, left.level)
                    yield pa.RecordBatch.from_arrays([pa.array(node.astype(np.int32)), pa.array(low[rows])], ["node", "low"])

    found = arrow_map(queries.select("vector", "low"), run, "node int, low double").groupBy("node").agg(F.min("low").alias("low"))
    return {r["node"]: r["low"] for r in found.collect()}  # at most net.nodes


def _may_hold(net: Net, left: Level, right: Level, a: int, b: int, worst: float) -> bool:
    """Whether data node ``b`` can hold a row as good as the worst k-th score of query node ``a``."""
    mine, other = net.node(a, left.radius[a]), net.node(b, right.radius[b])
    if mine is None or other is None:
        return mine is other and a == b
    return len(mine.centre) == len(other.centre) and bound(mine, other) >= worst
