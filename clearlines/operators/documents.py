"""From documents to sentences and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.functions.text import BREAK, split_sentences, strip


def explode_sentences(df: DataFrame, text: str) -> DataFrame:
    """One row (…, pos, sentence) per sentence; documents without any give no row."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(split_sentences(F.col(text))).alias("pos", "sentence"))


def of_one(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """``step`` with one argument: a second, optional one would be given the position."""
    return lambda sentence: step(sentence)


def map_sentences(text: Column, steps: Sequence[Callable[[Column], Column]]) -> Column:
    """Split, rewrite each sentence step by step and join, all inside the row.

    Text without a sentence stays as it is.
    """
    sentences = F.split(strip(text), BREAK, -1)
    for step in steps:
        sentences = F.transform(sentences, of_one(step))
    return F.when(strip(text) == "", text).otherwise(F.array_join(sentences, " "))


def join_sentences(parts: DataFrame, keys: list[str], text: str, pos: str = "pos", into: str = "simplified",
                   *more: Column) -> DataFrame:
    """Per document its sentences in order, joined by one space.

    A group holds the sentences of one row of the document table, never more than that.
    ``more`` are further aggregates over the sentences. A key that two rows share is an error.
    """
    whole = F.count(F.lit(1)) == F.max(pos) + 1
    in_order = F.sort_array(F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"))))
    joined = F.array_join(F.transform(in_order, lambda s: s["text"]), " ")
    checked = F.when(whole, joined).otherwise(F.raise_error(F.lit("two documents have one key")))
    return parts.groupBy(*keys).agg(checked.alias(into), *more)
