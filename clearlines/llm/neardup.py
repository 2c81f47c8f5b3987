"""Near-duplicate texts: consistent weighted sampling over TF-IDF shingles, banded, verified.

A text is its word shingles (five words; a shorter text is one shingle), weighted by count times inverse
document frequency. Frequencies of all documents come from a sketch of ``CELLS`` hashed counters, so they
need the same memory at any size; a counter's expected share of other shingles is taken off.

* Equal texts collapse to one *node* (the MD5 of the text).
* Improved consistent weighted sampling draws ``BANDS * ROWS`` samples per text; two texts agree in
  a sample with the probability of their weighted Jaccard similarity. ``ROWS`` samples are a band.
* Texts that agree in a band share a bucket, and all pairs of a bucket are compared, whatever its size: its members
  are dealt out in blocks, and a pair of blocks is a task. Buckets of the same members are compared once; a pair in
  several buckets is counted in one.
* Every pair is verified by the weighted Jaccard similarity of the whole texts. Repeated shingles are elements of
  their own, so the shared weights of two blocks are one product of matrices. Links leave a task as counts and as
  a forest, never as pairs.
* Verified links form components; a class is named by its smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import WORD_BYTES, arrow_map, staged
from clearlines.llm.components import connected_components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Members of a bucket, and bytes of their texts, in a block: bounds what a task holds.
BLOCK = 1024
BLOCK_BYTES = 1 << 22
#: Elements whose shared weights are summed at a time.
ELEMENTS = 2048
CELLS = 1 << 18
SLOTS = 1 << 20
#: How much more the rarest shingle weighs than the most common one. A near copy's edits are rare and what it shares
#: with many copies is not: a full IDF would put copies that agree in 0.88 of their shingles below 0.8.
RARE = 0.25
#: Shingles sampled at a time: bounds memory for long texts.
PART = 1024
#: Bytes of a text hashed at a time.
LONG = 1 << 20
_SEED = 20_011


class Shingler:
    """Hashed shingles of a text and their counts, worked out on arrays of bytes."""

    def __init__(self, width: int = WIDTH):
        import numpy as np

        random = np.random.default_rng(_SEED)
        self.width = width
        self.bytes = random.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.bytes[32] = 0  # spaces add nothing
        self.places = random.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def words(self, raw: bytes):
        """A hash for each word of lower-cased bytes: of its bytes and their places in the word."""
        import numpy as np

        text = np.frombuffer(raw, np.uint8)
        inside = text != 32
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(starts):
            return np.zeros(0, np.uint64)
        first = starts[0]
        place = np.arange(first, len(text)) - np.repeat(starts, np.diff(np.append(starts, len(text))))
        codes = np.add.reduceat(self.bytes[text[first:]] * self.places[place & 1023], starts - first)
        codes ^= codes >> np.uint64(32)
        codes *= np.uint64(0xD6E8FEB86659FD93)
        return codes ^ codes >> np.uint64(29)

    def parts(self, raw: bytes):
        """The bytes in parts that end at a space: bounds memory for long texts."""
        at = 0
        while at < len(raw):
            end = raw.find(b" ", at + LONG) if len(raw) - at > LONG else -1
            end = len(raw) if end < 0 else end
            yield raw[at:end]
            at = end

    def of(self, text: str):
        """Sorted distinct hashes and counts; none for a text without words."""
        import numpy as np

        found = [self.words(part) for part in self.parts(text.encode().translate(WORD_BYTES))]
        codes = np.concatenate(found) if found else np.zeros(0, np.uint64)
        mixed = np.zeros(max(1, len(codes) - self.width + 1) if len(codes) else 0, np.uint64)
        for i in range(min(self.width, len(codes))):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + len(mixed)]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        return np.unique(mixed, return_counts=True)


def cells_of(hashes):
    """Counters of hashed shingles."""
    import numpy as np

    return (hashes >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def inverse_frequencies(texts: DataFrame, width: int = WIDTH):
    """Weight of a shingle by its counter (NumPy array of ``CELLS``), from all rows of ``texts``.

    ``1 + RARE * ln((N + 1) / (df + 1)) / ln(N + 1)``: from 1 for a shingle of all documents up to ``1 + RARE``
    for one of no other document.
    """
    import numpy as np

    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        shingler, counts, documents, total = Shingler(width), np.zeros(CELLS, np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                hashes, _ = shingler.of(text)
                np.add.at(counts, cells_of(hashes), 1)
                documents += 1
                total += len(hashes)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(used, [-1, -2]), pa.int64()), pa.array(np.append(counts[used], [documents, total]), pa.int64())],
            ["cell", "count"])

    found = arrow_map(texts.select("text"), run, "cell long, count long").groupBy("cell").agg(F.sum("count").alias("n"))
    table = found.toArrow()  # at most CELLS + 2 rows
    cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy()
    counts = np.zeros(CELLS)
    counts[cell[cell >= 0]] = n[cell >= 0]
    documents, total = int(n[cell == -1].sum()), int(n[cell == -2].sum())
    alone = np.clip(counts - (total - counts) / (CELLS - 1), 1, max(1, documents))
    return (1 + RARE * np.log((documents + 1) / (alone + 1)) / np.log(documents + 2)).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling with variates from tables, picked by the shingle's hash."""

    def __init__(self, samples: int = BANDS * ROWS):
        import numpy as np

        random = np.random.default_rng(_SEED)
        size = 1 << 16
        rate = random.gamma(2.0, 1.0, size)
        columns = (rate, 1 / rate, random.random(size), np.log(random.gamma(2.0, 1.0, size)))
        self.rate, self.inverse, self.shift, self.log_c = [c.astype(np.float32) for c in columns]
        self.turns = random.integers(1, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def draw(self, hashes, weights):
        """One 64-bit value per sample: the drawn shingle and its level. Ties go to the smallest hash."""
        import numpy as np

        best = np.full(len(self.turns), np.inf, np.float32)
        drawn = np.zeros(len(self.turns), np.uint64)
        logs, each = np.log(weights).astype(np.float32), np.arange(len(self.turns))
        for at in range(0, len(hashes), PART):
            part = hashes[at:at + PART]
            place = ((part[None, :] * self.turns[:, None]) >> np.uint64(48)).astype(np.intp)
            shift = self.shift.take(place)
            level = np.floor(logs[at:at + PART] * self.inverse.take(place) + shift)
            value = self.log_c.take(place) - self.rate.take(place) * (level - shift + 1)
            low = value.argmin(axis=1)
            least = value[each, low]
            better = least < best
            code = part[low] * np.uint64(0xD6E8FEB86659FD93) + level[each, low].astype(np.int64).view(np.uint64)
            best, drawn = np.where(better, least, best), np.where(better, code, drawn)
        return drawn


def signatures(texts: DataFrame, frequencies, width: int = WIDTH) -> DataFrame:
    """``node, bands array<long>, bytes`` of the texts that have words."""
    def run(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        shingler, sampler = Shingler(width), Sampler()
        spread = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            nodes, bands, sizes = [], [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes, counts = shingler.of(text)
                if not len(hashes):
                    continue
                drawn = sampler.draw(hashes, counts * frequencies[cells_of(hashes)]).reshape(BANDS, ROWS)
                band = np.zeros(BANDS, np.uint64)
                for i in range(ROWS):
                    band = (band ^ drawn[:, i]) * spread
                    band ^= band >> np.uint64(31)
                nodes.append(node)
                bands.append(band.view(np.int64).tolist())
                sizes.append(len(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                                              pa.array(sizes, pa.int64())], ["node", "bands", "bytes"])

    return arrow_map(texts.select("node", "text"), run, "node binary, bands array<long>, bytes long")


def _md5(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def bucket_members(signed: DataFrame) -> DataFrame:
    """``bucket, node, bytes, blocks, block``: the members of each bucket of two texts or more, dealt out in blocks.

    Of buckets that hold the same members, one stays.
    """
    buckets = F.array(*[F.xxhash64(F.lit(b), F.col("bands")[b]) for b in range(BANDS)])
    rows = signed.select("node", "bytes", F.explode(buckets).alias("bucket"))
    sets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"),
                                      *[F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"set{i}") for i in range(2)])
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("total") / BLOCK_BYTES)).cast("int")
    one = sets.where("n > 1").groupBy("n", "total", "set0", "set1").agg(F.min("bucket").alias("bucket"))
    one = staged(one.select("bucket", blocks.alias("blocks")), "buckets")
    # both sides are tables, so a bucket with very many members is split by the skewed join
    return rows.join(one, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), "blocks").cast("int"))


def shared_weights(keys: list, weights: list, left, right):
    """For each of the rows ``left`` and each of ``right``, the summed weights of the keys that both hold.

    ``keys`` has an array of distinct keys for each row; a key has one weight."""
    import numpy as np

    total = np.zeros((len(left), len(right)))
    flat, weight = np.concatenate(keys), np.concatenate(weights)
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    both = count > 1  # a key of one row is shared with none
    keep = np.flatnonzero(both[code])
    number = (np.cumsum(both) - 1)[code[keep]]
    keep = keep[np.argsort(number, kind="stable")]
    number = np.sort(number)
    for low in range(0, int(both.sum()), ELEMENTS):
        part = slice(*np.searchsorted(number, [low, low + ELEMENTS]))
        held = np.zeros((len(keys), min(ELEMENTS, int(both.sum()) - low)))
        values = np.zeros(held.shape[1])
        held[owner[keep[part]], number[part] - low] = 1
        values[number[part] - low] = weight[keep[part]]
        total += (held[left] * values) @ held[right].T
    return total


def linked(members: DataFrame, texts: DataFrame, frequencies, similarity: float = SIMILARITY, width: int = WIDTH) -> DataFrame:
    """``node, root, links`` per task: for its texts with a link, a member of their group, and their links counted here.

    A link is a pair of a bucket whose whole texts have at least the weighted Jaccard similarity.
    """
    few = members.where("blocks = 1").agg(F.count("*"), F.sum("bytes")).first()
    slots = max(1, -(-few[0] // BLOCK), -(-(few[1] or 0) // BLOCK_BYTES))
    # at most BANDS buckets a text
    places = members.groupBy("node").agg(F.collect_list("bucket").alias("buckets"))
    rows = members.join(places, "node").join(texts, "node")
    # buckets of one block share tasks
    alone, zero = F.col("blocks") == 1, F.lit(0)
    rows = rows.withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
    rows = rows.select(
        F.when(alone, F.pmod(F.xxhash64("bucket"), F.lit(slots))).otherwise(F.col("bucket")).alias("task"),
        F.when(alone, -1).otherwise(F.least("block", "other")).alias("a"),
        F.when(alone, -1).otherwise(F.greatest("block", "other")).alias("b"),
        (F.col("block") <= F.col("other")).alias("own"), "bucket", "buckets", "node", "text")

    def run(keys, table):
        import numpy as np
        import pyarrow as pa

        shingler, nodes = Shingler(width), {}
        own, bucket = table.column("own").to_numpy(), table.column("bucket").to_numpy()
        place = np.array([nodes.setdefault(n, len(nodes)) for n in table.column("node").to_pylist()])
        held = [np.array(x, np.int64) for x in table.column("buckets").to_pylist()]
        first = np.unique(place, return_index=True)[1]
        elements, weights, sums = [], [], np.zeros(len(nodes))
        for i, row in enumerate(first):
            hashes, counts = shingler.of(table.column("text")[int(row)].as_py())
            weight = frequencies[cells_of(hashes)].astype(np.float64)
            sums[i] = (counts * weight).sum()
            # the n-th occurrence of a shingle is an element
            turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            elements.append(np.repeat(hashes, counts) + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            weights.append(np.repeat(weight, counts))
        links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        small, same = keys[1].as_py() < 0, keys[1].as_py() == keys[2].as_py()
        order = np.argsort(bucket, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            left = np.arange(len(rows)) if small else np.flatnonzero(own[rows])
            right = left if same else np.flatnonzero(~own[rows])
            at = place[rows]
            if not len(left) or not len(right):
                continue
            low = shared_weights([elements[i] for i in at], [weights[i] for i in at], left, right)
            whole = sums[at[left]][:, None] + sums[at[right]][None, :] - low
            i, j = np.nonzero(low >= similarity * whole - 1e-9)
            i, j = i[at[left[i]] != at[right[j]]], j[at[left[i]] != at[right[j]]]
            if not len(i):
                continue
            # a pair that shares a bucket of a smaller number is counted there
            before = [held[r][held[r] < bucket[rows[0]]] for r in rows]
            there = shared_weights(before, [np.ones(len(x)) for x in before], left, right)[i, j] > 0
            one, two = at[left[i]], at[right[j]]
            links += np.bincount(one[~there], minlength=len(nodes))
            if not same:
                links += np.bincount(two[~there], minlength=len(nodes))
            starts = np.flatnonzero(np.diff(i, prepend=-1))
            for x, others in zip(one[starts], np.split(two, starts[1:])):
                found = np.unique(np.append(label[others], label[x]))
                if len(found) > 1:
                    label[np.isin(label, found)] = found[0]
        names = list(nodes)
        out = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.table({"node": pa.array([names[i] for i in out], pa.binary()),
                         "root": pa.array([names[label[i]] for i in out], pa.binary()), "links": pa.array(links[out], pa.int64())})

    return rows.groupBy("task", "a", "b").applyInArrow(run, "node binary, root binary, links long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                    width: int = WIDTH) -> DataFrame:
    """``key, class_id, n_links, kept, text_md5`` of every row: the smallest key of the row's class, the verified
    links of its text to different texts with which it shares a band, whether the row is the one that stays, and the MD5 of its text.

    Equal texts are one class, whether they have words or not; a NULL text, and a row with a NULL key, is a class
    of its own (class NULL for a NULL key). Texts without words link with no different text. A repeated key
    with another text is judged by its text; of rows that share the class's smallest key, all stay. Case and
    punctuation (ASCII) do not matter to shingles. Other columns are not read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.where(F.col("key").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("key", "text", _md5(F.col("text")).alias("node"))
    frequencies = inverse_frequencies(rows, width)
    signed = signatures(rows, frequencies, width).groupBy("node").agg(F.first("bands").alias("bands"),
                                                                          F.first("bytes").alias("bytes"))
    signed = staged(signed, "signatures")
    members = staged(bucket_members(signed), "members")
    nodes = members.select("node").distinct()
    # the text of a node is read from its smallest key, so copies are not moved
    lowest = rows.select("key", "node").groupBy("node").agg(F.min("key").alias("key"))
    wanted = staged(lowest.join(nodes, "node"), "wanted")
    # at most SLOTS numbers go to every task; they keep most texts without a partner from being moved
    slot = F.pmod(F.xxhash64("node"), F.lit(SLOTS)).alias("slot")
    maybe = rows.withColumn("slot", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
    # repeated rows meet in the partitions of the join, so they are dropped without another shuffle
    texts = maybe.join(wanted, ["key", "node"]).select("key", "node", "text").dropDuplicates(["key", "node"])
    texts = staged(texts.select("node", "text"), "texts")
    links = staged(linked(members, texts, frequencies, similarity, width), "links")
    groups = staged(connected_components(links, "node", "root"), "groups")
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    lows = lowest.withColumnRenamed("key", "low").join(groups, "node", "left").join(counts, "node", "left")
    lows = staged(lows.select("node", "low", F.coalesce("component", "node").alias("component"), "n_links"), "lows")
    named = staged(lows.groupBy("component").agg(F.min("low").alias("class_id")), "classes")
    salt = F.pmod(F.xxhash64("key"), F.lit(16)).cast("int").alias("salt")
    classes = lows.join(named, "component").select("node", "class_id", "n_links")
    classes = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    judged = rows.select("key", "node", salt).join(classes, ["node", "salt"]).select("key", "class_id", "n_links", "node")
    alone = docs.where(F.col(key).isNull() | F.col(text).isNull()).select(
        F.col(key).alias("key"), F.col(key).alias("class_id"), F.lit(0).cast("long").alias("n_links"),
        _md5(F.col(text)).alias("node"))
    every = judged.unionByName(alone)
    kept = F.col("class_id").isNull() | (F.col("key") == F.col("class_id"))
    return every.select(F.col("key").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                        kept.alias("kept"), F.col("node").alias("text_md5"))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY,
                   width: int = WIDTH) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one document of each class, that with the smallest key."""
    dropped = near_duplicates(docs, key, text, similarity, width).where(~F.col("kept"))
    dropped = dropped.select(F.col(key).alias("_dropped"), "text_md5").distinct()
    gone = (F.col(key) == F.col("_dropped")) & (_md5(F.col(text)) == F.col("text_md5"))
    return docs.join(dropped, gone, "left_anti")
