"""Language by compression: the language whose dictionary makes a text smallest.

A dictionary is plain text of a language, taken from a bounded sample of labelled documents and given to
zstandard as raw content. Every whole text, in lower case, is compressed in blocks with each dictionary; blocks keep
the dictionary in reach however long the text is. The margin between the two smallest totals is the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.llm.common import arrow_filter, arrow_map

#: Per language: documents in the sample, and slices of each and their characters (bounds of the dictionaries alone).
SAMPLE_DOCS = 64
SLICES = 8
SLICE_CHARS = 256
BLOCK = 2048
LEVEL = 6
#: Scores below this are too close to call.
MARGIN = 0.005
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def learn(docs: DataFrame, trained: Column, key: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language, from the rows where ``trained`` holds.

    A language's sample is the document with the smallest hash in each of ``SAMPLE_DOCS`` slots of
    keys. Of each, slices from hashed places all over the whole text are taken; lines in slices of more than one document
    (headers that many share) are left out. Rows with a NULL key, text or language, or no letter in the text, are left out.
    """
    import hashlib

    rows = docs.where(trained & F.col(key).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    rows = rows.select(F.xxhash64(F.col(key).cast("string")).alias("order"), F.col(lang).alias("lang"),
                       F.array(*[_slice(F.col(text), F.col(key), i) for i in range(SLICES)]).alias("slices"))
    best = rows.groupBy("lang", F.pmod(F.col("order"), F.lit(SAMPLE_DOCS)).alias("slot")).agg(
        F.min(F.struct("order", "slices")).alias("at"))
    # at most SAMPLE_DOCS short texts per language
    found = best.select("lang", "slot", "at.slices").collect()
    whole = lambda lines: lines[1:-1] if len(lines) > 2 else lines  # noqa: E731  without those that the slice cuts
    lines = {(row.lang, row.slot): {line: None for part in row.slices for line in whole(part.split("\n"))} for row in found}
    shared = {line for line, n in Counter(line for own in lines.values() for line in own).items() if n > 1}
    by: dict[str, list[str]] = {}
    for (name, _), own in lines.items():
        by.setdefault(name, []).append("\n".join(line for line in own if line not in shared))
    in_order = lambda texts: sorted(texts, key=lambda t: hashlib.md5(t.encode()).digest())
    return {name: "\n".join(in_order(texts)).lower().encode() for name, texts in by.items()}


def _slice(text: Column, key: Column, number: int) -> Column:
    """A slice of the text from a place drawn by hash over its whole length."""
    places = F.greatest(F.length(text) - (SLICE_CHARS - 1), F.lit(1))
    return F.substring(text, F.pmod(F.xxhash64(key.cast("string"), F.lit(number)), places) + 1, F.lit(SLICE_CHARS))


class Sizes:
    """Compressed sizes of a text with each dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.names = sorted(dictionaries)
        self.calls = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.calls.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_checksum=False).compress)

    def judge(self, text: str | None) -> tuple[str, float]:
        """The language and its margin; ties go to the name that sorts first, with margin 0."""
        if not text or not self.names or not _LETTER.search(text):
            return UNKNOWN, 0.0
        raw = text.lower().encode()
        blocks = [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted((sum(len(call(b)) for b in blocks), name) for call, name in zip(self.calls, self.names))
        return sizes[0][1], (1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0)


def keep_clear(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, text: str = "text") -> DataFrame:
    """The rows, all columns, whose language is clear: those that :func:`identify` does not reject."""
    def make():
        judge = Sizes(dictionaries).judge
        return lambda texts: [name != UNKNOWN and found >= margin for name, found in map(judge, texts)]

    return arrow_filter(docs, text, make)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, key: str = "doc_id",
             text: str = "text") -> DataFrame:
    """``key, lang_pred, score, rejected`` of every row's whole text.

    ``lang_pred`` is ``und``, with score 0 and rejected, for NULL and empty texts and those without a letter;
    also if nothing was learned. ``rejected`` marks margins below ``margin``. NULL and repeated keys and
    rows give a row each. No other column is read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        sizes = Sizes(dictionaries)
        for batch in batches:
            found = [sizes.judge(t) for t in batch.column(1).to_pylist()]
            names = pa.array([n for n, _ in found], pa.string())
            scores = pa.array([s for _, s in found], pa.float64())
            far = pa.array([s < margin or n == UNKNOWN for n, s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), names, scores, far], ["key", "lang_pred", "score", "rejected"])

    columns = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {kind}, lang_pred string, score double, rejected boolean"
    return arrow_map(columns, run, schema).withColumnRenamed("key", key)
