"""Waiting-time estimates from the trailing timings of a session.

The trailing mean is a row window. Spark gives each window group to one task, which a hot
session would overload, so all rows are cut into consecutive chunks by a range partitioning;
each chunk borrows the few rows before it from its predecessors. One plan serves all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.text import word_count
from clearlines.plans.staging import Staging


def _windowed(df: DataFrame, groups: list[str], order: list[str], values: list[str], rows: int) -> DataFrame:
    before = Window.partitionBy(*groups).orderBy(*order).rowsBetween(-rows, -1)
    for value in values:
        df = df.withColumn(f"{value}_mean", F.avg(value).over(before))
    return df.withColumn("history", F.count(F.lit(1)).over(before))


def trailing_mean(df: DataFrame, keys: list[str], order: list[str], values: list[str], rows: int = fixed.HISTORY,
                  chunks: int | None = None, staging: Staging | None = None) -> DataFrame:
    """Add ``<value>_mean`` and ``history`` over the ``rows`` rows before each row of its group.

    ``order`` must be unique within a group. All rows are cut into ``chunks`` consecutive ranges of
    (keys, order), by default as many as there are shuffle partitions; a large group spans several.
    """
    spark = df.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(chunks, *keys, *order).withColumn("_chunk", F.spark_partition_id())
    ranged = (staging or Staging(spark)).part("trailing").write(ranged, "chunks")  # the sampled bounds must stay what they are
    latest_first = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(c).desc() for c in order])
    tails = (ranged.withColumn("_rank", F.row_number().over(latest_first)).where(F.col("_rank") <= rows)
             .groupBy(*keys, "_chunk").agg(F.collect_list(F.struct(*order, *values)).alias("_tail")))
    # each chunk of a key holds a row at least, so `rows` chunks back hold all rows needed; a key has
    # no more rows here than there are chunks
    back = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(-rows, -1)
    borrowed = (tails.withColumn("_before", F.flatten(F.collect_list("_tail").over(back)))
                .select(*keys, "_chunk", F.explode("_before").alias("_row"))
                .select(*keys, "_chunk", *[F.col("_row")[c].alias(c) for c in order + values], F.lit(True).alias("_lent")))
    both = ranged.withColumn("_lent", F.lit(False)).unionByName(borrowed, allowMissingColumns=True)
    return _windowed(both, [*keys, "_chunk"], order, values, rows).where(~F.col("_lent")).drop("_lent", "_chunk")


def fallback(words: Column, stage: str) -> Column:
    """Estimate by length alone."""
    cap, start, per_word = fixed.ETA_FALLBACK[stage]
    return F.least(F.lit(cap), F.lit(start) + F.lit(per_word) * words)


def estimate(mean: Column, guess: Column) -> Column:
    """Trailing mean, but no less than a share of the guess; the guess without history."""
    return F.when(mean.isNull(), guess).otherwise(F.greatest(mean, F.lit(fixed.ETA_FLOOR) * guess))


def bounds(eta: Column, history: Column) -> tuple[Column, Column]:
    """Low and high estimate: the longer the history, the closer."""
    *steps, (_, low_last, high_last) = fixed.ETA_BOUNDS
    low, high = None, None
    for below, lo, hi in steps:
        test = history < below
        low = F.when(test, lo) if low is None else low.when(test, lo)
        high = F.when(test, hi) if high is None else high.when(test, hi)
    return eta * low.otherwise(low_last), eta * high.otherwise(high_last)


def eta(df: DataFrame, stage: str, words: str, mean: str, history: str = "history") -> DataFrame:
    """Add eta, eta_low and eta_high to rows that hold a stage name (simplify, else translate)."""
    guess = F.when(F.col(stage) == "simplify", fallback(F.col(words), "simplify")).otherwise(
        fallback(F.col(words), "translate"))
    df = df.withColumn("eta", estimate(F.col(mean), guess))
    low, high = bounds(F.col("eta"), F.col(history))
    return df.withColumn("eta_low", low).withColumn("eta_high", high)


def request_eta(df: DataFrame, words: str, simplify_mean: str, translate_mean: str, history: str = "history") -> DataFrame:
    """Both stages of a request and their sum: eta, low and high each."""
    for name, mean in (("simplify", simplify_mean), ("translate", translate_mean)):
        df = df.withColumn(f"{name}_eta", estimate(F.col(mean), fallback(F.col(words), name)))
        low, high = bounds(F.col(f"{name}_eta"), F.col(history))
        df = df.withColumn(f"{name}_low", low).withColumn(f"{name}_high", high)
    return (df.withColumn("total_low", F.col("simplify_low") + F.col("translate_low"))
            .withColumn("total_high", F.col("simplify_high") + F.col("translate_high")))


def request_words(text: Column) -> Column:
    """Words of a request, 0 without text."""
    return F.coalesce(word_count(text), F.lit(0))


def _tenths(value: Column) -> Column:
    """``value`` in tenths, rounded to the nearest, exact ties to even.

    Twenty times the value is compared with the odd number between two tenths. The
    product is kept as a sum of two parts, so that 0.35 (a little less than 7/20 as a double)
    does not pass for a tie.
    """
    a, b = value * 16.0, value * 4.0
    high = a + b
    shadow = high - a
    low = (a - (high - shadow)) + (b - shadow)
    down = F.floor(high / 2)
    middle = (down * 2 + 1).cast("double")
    above = (high > middle) | ((high == middle) & (low > 0))
    tie = (high == middle) & (low == 0)
    # an even product whose second part is negative lies below that tenth, never below the middle
    return F.when(above | (tie & (down % 2 == 1)), down + 1).otherwise(down)


def seconds_text(seconds: Column) -> Column:
    """``12.3s``, or minutes from 60 seconds on (``2.5m``)."""
    tenths = _tenths(F.when(seconds < 60, seconds).otherwise(seconds / 60))
    digits = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.concat(digits, F.when(seconds < 60, "s").otherwise("m"))


def range_text(low: Column, high: Column) -> Column:
    """``12.3s-2.5m``."""
    return F.concat(seconds_text(low), F.lit("-"), seconds_text(high))
