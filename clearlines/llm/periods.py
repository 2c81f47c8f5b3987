"""Runs of repeated word sequences: tiles of every scale, solved apart, stitched by document and period.

A *run* is a stretch of words with smallest period ``q`` (words ``q`` apart are equal) and at least
``max(least, times * q)`` words, that no neighbouring word extends. For a period, the *matches* of a document are the
words that equal the one ``q`` further on; a run is a maximal interval of at least ``3 q`` matches.

* **Octaves.** Periods from ``s`` to ``2 s - 1`` (``s`` a power of two) are looked for around every word ``c`` whose
  number is a multiple of ``2 s``: the tile of ``c`` is the words from ``c - 2 s`` to ``c + 5 s``. Tiles overlap, so that
  each interval of matches is the union of what the tiles find on both sides of their ``c``.
* **Gate.** Only tiles are solved where the ``s + 1`` words from ``c`` on recur between ``s`` and ``2 s`` words later. A run's
  first ``c`` always does; a last ``c`` that does not is covered by the tile before, which sees ``3 s`` matches on.
  Window hashes of a whole octave tell this in one pass; equal words have equal hashes, so no run is lost.
* **Solving.** Tiles that pass are rows of their own, dealt out over all tasks. Two Z-functions at ``c``, one to the
  right and one to the left, give the matches next to ``c`` of all periods. A period whose stretch also has a smaller
  one is left out: the whole run has it then.
* **Stitching.** Intervals of one document and period that touch are one. Of stretches with the same ends the smallest
  period counts.

Time is ``n log n`` in the words of a text, and memory a small multiple of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_map, staged

LEAST = 6
TIMES = 4
#: Words that one row of tiles has, but for a single larger tile.
SPAN = 1 << 14
#: Words in tiles that a task holds before it hands them on, but for those of one text.
HELD = 1 << 20
RUN = "struct<start:bigint,length:bigint,period:bigint>"
_BASE = 0x9E3779B97F4A7C15 | 1


def z_function(s: list) -> list[int]:
    """For each place of ``s`` how many items from there on equal those from its start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def tile_matches(ids: list[int], c: int, step: int) -> list[tuple[int, int, int]]:
    """``period, first, last + 1`` of the matches next to ``c``, for the primitive periods of the octave of ``step``."""
    left, right = ids[max(0, c - 2 * step):c], ids[c:c + 5 * step]
    near = right[:2 * step]
    after = z_function(right)
    before = z_function(left[::-1] + [-1] + (left + near)[::-1])
    at = len(left) + 1 + len(near)
    strong = [(p, before[at - p], after[p] if p < len(right) else 0) for p in range(1, min(2 * step - 1, len(near)) + 1)]
    strong = [x for x in strong if x[1] + x[2] >= 3 * step]
    found = []
    while strong:
        p, back, on = strong[0]
        if p >= step:
            found.append((p, c - back, c + on))
        strong = [x for x in strong[1:] if x[1] > back or x[2] + x[0] > on + p]
    return found


class Gate:
    """Finds the tiles that can hold a part of a run."""

    def __init__(self):
        import numpy as np

        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        import numpy as np

        if len(self.powers) < n:
            for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
                factors = np.full(2 * n, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def tiles(self, words: list[bytes], times: int) -> Iterator[tuple[int, list[int]]]:
        """``step, places`` for every octave that has tiles to solve."""
        import numpy as np

        n = len(words)
        self._grow(n + 1)
        hashed = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed * self.powers[:n], dtype=np.uint64)])
        step = 1
        while times * step <= n:
            window = (total[step + 1:] - total[:-step - 1]) * self.inverse[:n - step]
            rows = np.zeros(-(-len(window) // (2 * step)) * 2 * step, np.uint64)
            rows[:len(window)] = window
            rows = rows.reshape(-1, 2 * step)
            some = (rows[:, step:] == rows[:, :1]).any(axis=1)
            if some.any():
                yield step, (np.flatnonzero(some) * 2 * step).tolist()
            step *= 2


def spans(places: list[int], step: int, n: int, most: int = SPAN) -> Iterator[tuple[int, int, list[int]]]:
    """Tiles that overlap as one stretch of words, of at most ``most`` words or one tile: ``first, end, places``."""
    held: list[int] = []
    for c in places:
        if held and (c - held[-1] > 5 * step or c + 7 * step - held[0] > most):
            yield max(0, held[0] - 2 * step), min(n, held[-1] + 5 * step), held
            held = []
        held.append(c)
    if held:
        yield max(0, held[0] - 2 * step), min(n, held[-1] + 5 * step), held


def _cut(kind: str, digest: bool, times: int, most: int):
    """Documents to rows with their tiles; those without tiles are done."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        gate, number = Gate(), TaskContext.get().partitionId() << 40
        part = pa.struct([("step", pa.int32()), ("first", pa.int64()), ("places", pa.list_(pa.int32())), ("ids", pa.list_(pa.int32()))])
        names = ["row", "key", "n", "words", "collapsed", "tiles"]
        kinds = [pa.int64(), None, pa.int64(), pa.string(), pa.string(), pa.list_(part)]
        for batch in batches:
            rows, held = [], 0
            for at, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").encode().split()
                parts = []
                found = list(gate.tiles(words, times))
                if found:
                    known: dict[bytes, int] = {}
                    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))
                    parts = [{"step": step, "first": first, "places": [c - first for c in places], "ids": ids[first:end]}
                             for step, every in found for first, end, places in spans(every, step, len(words), most)]
                joined = b" ".join(words)
                done = hashlib.sha256(joined).hexdigest() if digest else joined.decode()
                rows.append((number, at, len(words), joined.decode() if parts else None, None if parts else done, parts))
                number += 1
                held += sum(len(x["ids"]) for x in parts)
                if held > HELD or at + 1 == batch.num_rows:
                    columns = list(zip(*rows))
                    arrays = [pa.array(c, k) if k else batch.column(0).take(pa.array(c)) for c, k in zip(columns, kinds)]
                    yield pa.RecordBatch.from_arrays(arrays, names)
                    rows, held = [], 0

    return run, f"row long, key {kind}, n long, words string, collapsed string, tiles array<struct<step int, first long, places array<int>, ids array<int>>>"


def _solve(batches):
    """Tiles to intervals of matches; those of one row that touch are joined at once."""
    import pyarrow as pa

    for batch in batches:
        out: list[tuple] = []
        for row, step, first, places, ids in zip(*(c.to_pylist() for c in batch.columns)):
            last: dict[int, list] = {}
            for c in places:
                for period, start, end in tile_matches(ids, c, step):
                    held = last.get(period)
                    if held and start + first <= held[3]:
                        held[3] = max(held[3], end + first)
                    else:
                        last[period] = held = [row, period, start + first, end + first]
                        out.append(held)
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "period", "start", "end"])


def stitched(matches: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``row, start, length, period``: the runs whose intervals of matches are ``row, period, start, end``, in parts."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    cut = matches.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    numbered = cut.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("row", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    length = (F.col("end") - F.col("start") + F.col("period")).alias("length")
    whole = whole.select("row", "start", length, "period")
    long = whole.where((F.col("length") >= least) & (F.col("length") >= times * F.col("period")))
    return long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _finish(kind: str, digest: bool):
    """Words without those that a run repeats, and the run of the largest exponent."""
    def run(batches):
        import hashlib
        from fractions import Fraction

        import pyarrow as pa

        for batch in batches:
            texts, best = [], []
            for words, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = words.split(" ")
                edges = [0] * (len(words) + 1)
                for r in runs:
                    edges[r["start"] + r["period"]] += 1
                    edges[r["start"] + r["length"]] -= 1
                text = " ".join(word for word, inside in zip(words, accumulate(edges)) if not inside)
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digest else text)
                best.append(min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None))
            one = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(best, one), pa.array(texts, pa.string())],
                                             ["key", "n_words", "runs", "best", "collapsed"])

    return run, f"key {kind}, n_words long, runs array<{RUN}>, best {RUN}, collapsed string"


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, digest: bool = False,
                  span: int = SPAN) -> DataFrame:
    """``key, n_words, runs, best, collapsed``, a row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs`` holds ``start, length, period`` of every run of at least
    ``least`` words and four periods, by start and period; ``best`` is the run of the largest exact ``length / period``
    (ties: smallest start, then period; NULL without runs). ``collapsed`` is the words joined by one space without
    those that some run holds after its first period; with ``digest`` its SHA-256 in hex instead.

    NULL and blank texts have no words, no runs and an empty ``collapsed``. Keys are carried along: NULL or repeated
    keys and repeated rows give a row each. Other columns are not read. Texts of any length are read whole. An empty
    table gives an empty one. Only texts with a tile that passes the gate move, once, beside those tiles.
    """
    kind = docs.schema[key].dataType.simpleString()
    run, schema = _cut(kind, digest, TIMES, span)
    cut = staged(arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, schema), "tiles")
    tiles = cut.where(F.size("tiles") > 0).select("row", F.explode("tiles").alias("tile"))
    tiles = tiles.select("row", "tile.step", "tile.first", "tile.places", "tile.ids")
    dealt = tiles.repartition(F.col("row"), F.col("step"), F.col("first"))
    matches = arrow_map(dealt, _solve, "row long, period long, start long, end long")
    each = F.struct("start", "length", "period")
    found = stitched(matches, least).groupBy("row").agg(F.array_sort(F.collect_list(each)).alias("runs"))
    run, schema = _finish(kind, digest)
    runs = F.coalesce("runs", F.array().cast(f"array<{RUN}>")).alias("runs")
    open_ = cut.where(F.col("words").isNotNull()).select("row", "key", "n", "words").join(found, "row", "left")
    run, schema = _finish(kind, digest)
    finished = arrow_map(open_.select("key", "n", "words", runs), run, schema)
    done = cut.where(F.col("words").isNull()).select(
        "key", F.col("n").alias("n_words"), F.array().cast(f"array<{RUN}>").alias("runs"), F.lit(None).cast(RUN).alias("best"), "collapsed")
    return finished.unionByName(done).withColumnRenamed("key", key)
