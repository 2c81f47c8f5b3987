"""Replacing words by a table of entries: broadcast while its measured size allows that, joined beyond."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.functions.lexicon import TOKEN, Lexicon, fold, grams
from clearlines.plans.staging import Staging

BROADCAST_BYTES = 32 << 20
ENTRY_BYTES = 400  # of an entry in the trie, beside its letters
ROWS = 128  # that are Python objects at a time: the texts of a whole batch, with the entries of each, would fill a worker


def _piecewise(step: Callable[..., list], batches: Iterator[tuple[pa.Array, ...]], kind: str) -> Iterator[pa.Array]:
    """``step`` over lists of at most ``ROWS`` values of each column, as one array a batch."""
    import pyarrow as pa

    made = pa.string() if kind == "string" else pa.list_(pa.string())
    for batch in batches:
        parts = [pa.array(step(*[column.slice(at, ROWS).to_pylist() for column in batch]), made) for at in range(0, len(batch[0]), ROWS)]
        yield pa.concat_arrays(parts or [pa.array([], made)])


def _folded(keys: pd.Series) -> pd.DataFrame:
    rows = [fold(key) for key in keys]
    return pd.DataFrame({"gram": pd.Series(rows, dtype=object),
                         "tokens": pd.Series([len(TOKEN.findall(row)) for row in rows], dtype="int32")})


def _entries(lexicon: DataFrame) -> DataFrame:
    """``gram, tokens, key, replacement``, one row for all keys that differ by case only."""
    whole = lexicon.where((F.col("key") != "") & F.col("replacement").isNotNull())
    folded = F.pandas_udf(_folded, "struct<gram string, tokens int>")
    keyed = whole.select(folded(F.col("key")).alias("f"), F.struct("key", "replacement").alias("entry"))
    best = keyed.groupBy("f.gram", "f.tokens").agg(F.min("entry").alias("entry"))
    return best.select("gram", "tokens", "entry.key", "entry.replacement")


def _by_broadcast(df: DataFrame, text: str, into: str, entries: DataFrame) -> DataFrame:
    rows = [(row.key, row.replacement) for row in entries.select("key", "replacement").orderBy("key").collect()]
    shared = df.sparkSession.sparkContext.broadcast(rows)

    def replaced(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(shared.value)
        yield from _piecewise(lambda texts: [None if t is None else lexicon.replace(t) for t in texts],
                              ((batch,) for batch in batches), "string")

    return df.withColumn(into, F.arrow_udf(replaced, "string")(F.col(text)))


def _by_join(df: DataFrame, text: str, into: str, entries: DataFrame, key: str) -> DataFrame:
    """Each row meets the entries it holds: its distinct runs of words are joined with the table."""
    lengths = [row.tokens for row in entries.select("tokens").distinct().collect()]

    def held(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _piecewise(lambda texts: [None if t is None else grams(t, lengths) for t in texts],
                              ((batch,) for batch in batches), "array")

    runs = df.select(F.col(key).alias("_row"), F.explode(F.arrow_udf(held, "array<string>")(F.col(text))).alias("gram"))
    own = runs.join(entries.hint("shuffle_merge"), "gram").groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("key", "replacement"))).alias("_own"))

    def replaced(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _piecewise(lambda *columns: [t if k is None else Lexicon(zip(k, n)).replace(t) for t, k, n in zip(*columns)],
                              batches, "string")

    joined = df.join(own, df[key] == own["_row"], "left")
    made = F.arrow_udf(replaced, "string")(F.col(text), F.col("_own.key"), F.col("_own.replacement"))
    return joined.withColumn(into, made).drop("_row", "_own")


def replace_terms(df: DataFrame, text: str, lexicon: DataFrame, into: str, key: str,
                  broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``into``: ``text`` with the keys of ``lexicon`` (columns ``key``, ``replacement``) replaced, in one pass.

    Keys match whole words whatever their case; of matches that overlap, the longest key, the smaller key, the first
    place. What was put in is not replaced again: unlike the successive patterns of ``lexicon_replace``, replacements
    do not chain. A NULL text stays NULL; entries that are NULL or whose key is empty are left out; of keys that differ
    by case only, the smallest counts; an empty table changes nothing. ``key`` names rows (unique, not NULL).

    The entries are written once and measured. Up to ``broadcast_bytes`` they travel to the tasks. Beyond, only the
    entries that a row holds come to it, by a join on runs of words; a very frequent run is left to AQE's skewed join.
    """
    entries = Staging(df.sparkSession).write(_entries(lexicon), "lexicon")
    size = entries.agg(F.count("*").alias("n"),
                       F.coalesce(F.sum(F.octet_length("key") + F.octet_length("replacement")), F.lit(0)).alias("b")).first()
    if size.n * ENTRY_BYTES + size.b <= broadcast_bytes:
        return _by_broadcast(df, text, into, entries)
    return _by_join(df, text, into, entries, key)
