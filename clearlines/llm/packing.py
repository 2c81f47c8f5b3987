"""Packing documents into token sequences, in order, by dynamic programming over cuts.

The documents of an input partition, each followed by an end id, form a stream that is cut into
*runs* of ``RUN`` tokens. Within a run every token position is a possible cut. With ``f[j]`` the least
cost of all sequences up to position ``j``::

    f[j] = cut[j] + min over i in [j - size, j - size/2] of f[i] + padding(j - i)

``cut[j]`` is 0 at the end of a document, ``SENTENCE`` at the end of a sentence and ``INSIDE``
elsewhere (a truncation), counted in padding tokens; ``padding(n)`` is ``size - n``, and 0 if ``n`` is a
power of two. As ``f[i] + i`` does not depend on ``j``, the minimum is that of a sliding window, whose
monotone queue is kept as two running minima: a window of ``size/2`` starts spans two blocks of that
length, so it is the suffix of one and the prefix of the next, and one step serves ``size/2`` positions.
The rest of a run is one padded sequence, or is split into powers of two where that is cheaper.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.llm.bpe import byte_alphabet
from clearlines.llm.common import arrow_map, per_worker

SENTENCE = 1
INSIDE = 8

#: Tokens of a run: what a task holds at a time, whatever the length of its documents.
RUN = 1 << 20
_FAR = 1 << 30
#: White space of the word pattern, a thousand characters and more.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


def rest_cost(tokens: int, size: int, split: int = 16) -> tuple[int, list[int]]:
    """Cost and lengths of the sequences that hold a run's last ``tokens`` (at most ``size``)."""
    if not tokens:
        return 0, []
    powers = [1 << b for b in range(tokens.bit_length() - 1, -1, -1) if tokens >> b & 1]
    return min((size - tokens, [tokens]), (split * (len(powers) - 1), powers))


def cuts(cost, size: int = 1024) -> list[int]:
    """The cheapest ends of sequences; ``cost[j]`` is that of a cut before token ``j`` (0 .. n)."""
    import numpy as np

    n, half = len(cost) - 1, size // 2
    blocks = -(-n // half)
    # f and g = f + i, shifted by 2 * half so that starts before the run are far away
    f = np.full((blocks + 2) * half + 1, _FAR, np.int64)
    g = f.copy()
    f[size] = g[size] = 0
    full = np.zeros(blocks * half + 1, np.int64)
    full[:n + 1] = cost
    steps = np.arange(1, half + 1)
    for b in range(blocks):
        at = b * half  # position of the block before, in shifted arrays: starts at - .. at + half
        early = np.minimum.accumulate(g[at:at + half + 1][::-1])[::-1][1:]  # least from each start to the seam
        late = np.minimum.accumulate(g[at + half:at + size + 1])[1:]  # least from the seam to each start
        best = np.minimum(early, late) + size - (at + steps)
        best = np.minimum(best, f[at + half + 1:at + size + 1])  # sequences of exactly size / 2
        best += full[at + 1:at + half + 1]
        f[at + size + 1:at + size + half + 1] = best
        g[at + size + 1:at + size + half + 1] = best + at + steps
    first = max(0, n - size)
    ends, (_, lengths), j = [], *min(((f[i + size] + rest_cost(n - i, size)[0], rest_cost(n - i, size)[1]), i)
                                     for i in range(n, first - 1, -1))
    at = j
    for length in lengths:
        at += length
        ends.append(at)
    back = []
    while j:
        back.append(j)
        if f[j + half] == f[j + size] - cost[j]:
            j -= half
        else:
            j += int(g[j:j + half + 1].argmin()) - size
    return back[::-1] + ends


class Encoder:
    """Token ids of whole texts, as the tokenizers library gives them for a byte-level vocabulary file."""

    def __init__(self, path: str):
        import json

        import numpy as np
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        alphabet, special = byte_alphabet(), {t["content"]: t["id"] for t in parts.get("added_tokens") or []}
        words = {bytes(alphabet[c] for c in t): i for t, i in parts["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=words, special_tokens=special)
        self.special = list(special)
        self.closes = np.zeros(max([*words.values(), *special.values()]) + 1, bool)  # ids that end a sentence
        for word, i in words.items():
            self.closes[i] = word.rstrip(b"\"')")[-1:] in (b".", b"!", b"?") or b"\n" in word

    def encode(self, text: str) -> list[int]:
        """Ids of the whole text. Long blank runs are cut out first, where the word pattern would cut them: it backs up over
        each of their characters and gives up on a million."""
        ids, at = [], 0
        for run in LONG_BLANK.finditer(text):
            end = run.end()
            # a blank before a word goes with the word; before a special token or the end the run is whole
            whole = end == len(text) or any(text.startswith(t, end) for t in self.special)
            ids += self.encoding.encode(text[at:run.start()], allowed_special="all")
            at = end if whole else end - 1
            ids += self.encoding._encode_single_piece(text[run.start():at])
        return ids + self.encoding.encode(text[at:] if at else text, allowed_special="all")


class Packer:
    """Packs the documents of one task; ``add`` and ``close`` give the finished pieces."""

    def __init__(self, closes, first: int, size: int, run: int):
        self.closes, self.next, self.size, self.run = closes, first, size, run
        self.parts, self.filled = [], 0

    def add(self, key, ids) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            piece = ids[start:start + self.run - self.filled]
            self.parts.append((key, start, piece, len(ids)))
            start += len(piece)
            self.filled += len(piece)
            if self.filled == self.run:
                yield from self.close()

    def close(self) -> Iterator[tuple]:
        """Rows (key, start, length, document's tokens, sequence, offset, ids) of what has gathered."""
        import numpy as np

        if not self.filled:
            return
        ids = np.concatenate([p[2] for p in self.parts])
        cost = np.where(np.concatenate([[True], self.closes[ids]]), SENTENCE, INSIDE)
        begins = np.cumsum([0] + [len(p[2]) for p in self.parts])
        cost[begins] = 0
        k, begin = 0, 0
        for end in cuts(cost, self.size):
            at = begin
            while at < end:
                key, start, piece, total = self.parts[k]
                stop = min(end, int(begins[k + 1]))
                yield (key, start + at - int(begins[k]), stop - at, total, self.next, at - begin,
                       ids[at:stop].astype("<u4").tobytes())
                at = stop
                k += stop == begins[k + 1]
            begin = end
            self.next += 1
        self.parts, self.filled = [], 0


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text",
         run: int = RUN) -> DataFrame:
    """Pack all documents; a row per piece: ``key``, ``start``, ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and ``ids`` (unsigned little-endian 32-bit numbers).

    ``size`` must be a power of two and divide ``run``. Documents keep their order within an input
    partition, which is packed by one task with ``run`` tokens in memory; a longer document goes on in
    the next run. NULL and empty texts are one ``end_id``. Keys are carried along: NULL keys, repeated
    keys and repeated rows are documents of their own. No other column is read. An empty table gives
    no pieces. Sequence ids hold the partition's number, so they are unique, and the same when a task
    is repeated.
    """
    kind = docs.schema[key].dataType.simpleString()
    if size & (size - 1) or run % size:
        raise ValueError("size must be a power of two that divides run")

    def work(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = per_worker(("encoder", path), lambda: Encoder(path))
        packer = Packer(encoder.closes, TaskContext.get().partitionId() << 36, size, run)
        names = ["key", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]

        def table(rows, kind):
            columns = list(zip(*rows))
            types = [kind, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encoder.encode(t or "")
                ids.append(end_id)
                for row in packer.add(k, np.array(ids, np.uint32)):
                    done.append(row)
            if done:
                yield table(done, kind)
        if done := list(packer.close()):
            yield table(done, kind)

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return arrow_map(columns, work, schema).withColumnRenamed("key", key)
