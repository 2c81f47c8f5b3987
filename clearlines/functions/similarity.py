"""Sequence similarity: the ratio of characters in common blocks, decided in the JVM wherever that is exact.

The ratio itself has no Spark counterpart and runs as an Arrow UDF (:mod:`clearlines.functions.blocks`), in time that
grows little faster than the texts. Two facts keep
most rows away from Python, without changing any result:

* ``ratio <= 2 * min(la, lb) / (la + lb)``, so a test against a threshold above that
  bound is already lost;
* where one text contains the other the longest match is the whole of the shorter text, so
  the ratio *is* that bound (if frequent characters are skipped, only below 200 characters).

Rows that are decided here reach Python as NULLs: they are not compared, but still counted
through the Arrow exchange.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.functions.blocks import block_ratio, block_ratio_reaches, infrequent_ratio, infrequent_ratio_reaches

# From this length on the second text's frequent characters are skipped.
FREQUENT_FROM = 200


def length_bound(a: Column, b: Column) -> Column:
    """Upper bound of the ratio from the lengths, 1.0 for two empty texts."""
    la, lb = F.length(a), F.length(b)
    bound = F.try_divide(2.0 * F.least(la, lb), (la + lb).cast("double"))
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(bound)


def closed_ratio(a: Column, b: Column, skip_frequent: bool = False) -> Column:
    """The exact ratio where it follows from lengths alone, else NULL."""
    contained = a.contains(b) | b.contains(a)
    if skip_frequent:
        contained = contained & (F.length(b) < FREQUENT_FROM)
    return F.when(contained, length_bound(a, b))


def _asked_only(answer: Callable[[str, str], object], kind: str):
    """Arrow UDF of two texts. Rows where one is NULL give NULL: they pass as a whole batch, without a Python object for each."""
    def answers(left: pa.Array, right: pa.Array) -> pa.Array:
        import pyarrow as pa
        import pyarrow.compute as pc

        made = pa.bool_() if kind == "boolean" else pa.float64()
        asked = pc.and_(left.is_valid(), right.is_valid())
        texts = zip(left.filter(asked).to_pylist(), right.filter(asked).to_pylist())
        return pc.replace_with_mask(pa.nulls(len(left), made), asked, pa.array([answer(a, b) for a, b in texts], made))

    return F.arrow_udf(answers, kind)


def _ratio_udf(skip_frequent: bool):
    return _asked_only(infrequent_ratio if skip_frequent else block_ratio, "double")


def _decision(threshold: float, above: bool, skip_frequent: bool) -> Callable[[str, str], bool]:
    decide = infrequent_ratio_reaches if skip_frequent else block_ratio_reaches
    return lambda a, b: decide(a, b, threshold, above)


def _reaches_udf(threshold: float, above: bool, skip_frequent: bool):
    return _asked_only(_decision(threshold, above, skip_frequent), "boolean")


def _reaches_each_udf(threshold: float, above: bool, skip_frequent: bool):
    """The same for two columns of arrays, element by element."""
    decide = _decision(threshold, above, skip_frequent)

    def reaches(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import pandas as pd

        for left, right in batches:
            yield pd.Series([[None if a is None or b is None else decide(a, b) for a, b in zip(x, y)] for x, y in zip(left, right)],
                            dtype="object")

    return F.pandas_udf(reaches, "array<boolean>")


def similarity_ratio(a: Column, b: Column, skip_frequent: bool = False) -> Column:
    """Ratio of two texts by their common blocks, equal to ``difflib``'s; case as given; not symmetric.

    With ``skip_frequent=True`` the frequent characters of texts of 200 characters and more do not
    count, ``difflib``'s own rule, with which long near copies may score low.
    """
    known = closed_ratio(a, b, skip_frequent)
    open_ = known.isNull()
    return F.coalesce(known, _ratio_udf(skip_frequent)(F.when(open_, a), F.when(open_, b)))


def _cheap_answer(a: Column, b: Column, threshold: float, above: bool, skip_frequent: bool) -> Column:
    """Whether the ratio reaches the threshold, where lengths and containment tell; else NULL."""
    def enough(ratio: Column) -> Column:
        return ratio > threshold if above else ratio >= threshold

    return F.coalesce(enough(closed_ratio(a, b, skip_frequent)), F.when(~enough(length_bound(a, b)), F.lit(False)))


def with_reaches_each(df: DataFrame, a: str, b: str, threshold: float, into: str, above: bool = False,
                      skip_frequent: bool = False) -> DataFrame:
    """Add the answers of :func:`reaches` for two columns of arrays, element by element; NULL where one is NULL."""
    cheap, left, right = f"{into}_cheap", f"{into}_left", f"{into}_right"
    df = df.withColumn(cheap, F.zip_with(a, b, lambda x, y: _cheap_answer(x, y, threshold, above, skip_frequent)))
    df = df.withColumns({left: F.zip_with(a, cheap, lambda x, known: F.when(known.isNull(), x)),
                         right: F.zip_with(b, cheap, lambda y, known: F.when(known.isNull(), y))})
    df = df.withColumn(into, _reaches_each_udf(threshold, above, skip_frequent)(F.col(left), F.col(right)))
    return df.withColumn(into, F.zip_with(cheap, into, lambda known, asked: F.coalesce(known, asked))).drop(cheap, left, right)


def reaches(a: Column, b: Column, threshold: float, above: bool = False,
            where: Column | None = None, skip_frequent: bool = False) -> Column:
    """Whether the ratio is at least (``above``: more than) the threshold.

    ``where`` names the rows that need the answer; the others get NULL or a cheap answer.
    """
    cheap = _cheap_answer(a, b, threshold, above, skip_frequent)
    open_ = cheap.isNull() if where is None else cheap.isNull() & where
    return F.coalesce(cheap, _reaches_udf(threshold, above, skip_frequent)(F.when(open_, a), F.when(open_, b)))


def with_reaches(df: DataFrame, a: Column, b: Column, threshold: float, into: str, above: bool = False,
                 where: Column | None = None, skip_frequent: bool = False) -> DataFrame:
    """Add the answers of :func:`reaches`, NULL outside of ``where``. Texts and cheap answers are columns, so each is made once, and no
    text that is only compared passes the exchange with Python beside the rows.
    """
    cheap, left, right = f"{into}_cheap", f"{into}_left", f"{into}_right"
    df = df.withColumns({left: a if where is None else F.when(where, a), right: b})
    df = df.withColumn(cheap, _cheap_answer(F.col(left), F.col(right), threshold, above, skip_frequent))
    open_ = F.col(cheap).isNull()
    df = df.withColumns({left: F.when(open_, F.col(left)), right: F.when(open_, F.col(right))})
    asked = _reaches_udf(threshold, above, skip_frequent)(F.col(left), F.col(right))
    return df.withColumn(into, F.coalesce(F.col(cheap), asked)).drop(cheap, left, right)


def is_copy(source: Column, prediction: Column, threshold: float = 0.95, skip_frequent: bool = False) -> Column:
    """Prediction and source are nearly the same text (case as given)."""
    return reaches(source, prediction, threshold, above=True, skip_frequent=skip_frequent)
