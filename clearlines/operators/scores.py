"""Corpus scores: per-pair columns, then one small aggregation per system.

Every pair is one row with source, prediction and reference, so all scores come from one
pass over the pairs; only the group sums are shuffled, whatever the size of a system.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.readability import fkgl, fre, text_counts
from clearlines.functions.sari import with_sari
from clearlines.functions.similarity import is_copy, with_reaches
from clearlines.functions.rewrite import strip_the as without_the
from clearlines.functions.text import empty_fallback, word_count

METRICS = ("samples", "copy_count", "copy_rate", "length_ratio", "source_fkgl", "predicted_fkgl",
           "source_fre", "predicted_fre", "sari")
F1_METRICS = ("f1_reference", "f1_source")


def align(pairs: DataFrame, predictions: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pairs with the predictions of every system, matched by key."""
    return pairs.join(predictions, key)


def length_ratio(source: Column, prediction: Column) -> Column:
    """Words of the prediction per word of the source (at least one)."""
    return word_count(prediction).cast("double") / F.greatest(word_count(source), F.lit(1))


def with_copy(df: DataFrame, source: str = "normal", prediction: str = "predicted", into: str = "copied",
              lower: bool = True, skip_frequent: bool = False) -> DataFrame:
    """Add whether the prediction is nearly the source; both sides are lower-cased unless told not to."""
    def text(name: str) -> Column:
        return F.lower(F.col(name)) if lower else F.col(name)

    return with_reaches(df, text(source), text(prediction), fixed.COPY_RATIO, into, above=True, skip_frequent=skip_frequent)


def with_scores(df: DataFrame, source: str = "normal", prediction: str = "predicted", reference: str = "simple",
                tokenizer: str = "13a", skip_frequent: bool = False, tokens: tuple[str, str, str] | None = None,
                counts: tuple[str, str] | None = None) -> DataFrame:
    """Add every per-pair score. ``counts`` names columns of :func:`text_counts` of source and prediction."""
    of = [F.col(name) for name in counts] if counts else [text_counts(F.col(source)), text_counts(F.col(prediction))]
    df = df.withColumns({"_source": of[0], "_predicted": of[1]})
    df = df.withColumns({
        "length_ratio": F.col("_predicted")["found"] / F.col("_source")["words"],
        "source_fkgl": fkgl(F.col("_source")), "predicted_fkgl": fkgl(F.col("_predicted")),
        "source_fre": fre(F.col("_source")), "predicted_fre": fre(F.col("_predicted")),
    }).drop("_source", "_predicted", *(counts or ()))
    df = with_copy(df, source, prediction, skip_frequent=skip_frequent)
    return with_sari(df, source, prediction, reference, "sari", tokenizer, tokens=tokens)


def score_systems(df: DataFrame, system: str = "system", source: str = "normal", prediction: str = "predicted",
                  reference: str = "simple", tokenizer: str = "13a", skip_frequent: bool = False,
                  empty_to_source: bool = False, strip_the: bool = False, f1: DataFrame | None = None,
                  tokens: tuple[str, str, str] | None = None, counts: tuple[str, str] | None = None) -> DataFrame:
    """One row per system with all scores; pairs with a missing text are left out and counted.

    ``empty_to_source`` takes the source for a blank prediction. ``strip_the`` then drops each
    "the " from predictions that are nearly their source. ``f1`` is a table (system, f1_reference,
    f1_source), whose columns join the scores; systems without vectors have NULLs. ``tokens`` names
    columns of ready SARI tokens of source, prediction and reference, ``counts`` of ready counts of source and prediction.
    """
    if (tokens or counts) and (empty_to_source or strip_the):
        raise ValueError("predictions that change have no ready tokens")
    if empty_to_source:
        df = df.withColumn(prediction, empty_fallback(F.col(prediction), F.col(source)))
    if strip_the:
        near = is_copy(F.lower(F.col(source)), F.lower(F.col(prediction)), fixed.COPY_RATIO, skip_frequent)
        df = df.withColumn(prediction, without_the(F.col(prediction), F.coalesce(near, F.lit(False))))
    df = df.withColumn("_complete", F.col(source).isNotNull() & F.col(prediction).isNotNull() & F.col(reference).isNotNull())
    whole = F.col("_complete")
    scored = with_scores(df.select(system, source, prediction, reference, "_complete", *(tokens or ()), *(counts or ())), source, prediction,
                         reference, tokenizer, skip_frequent, tokens, counts)

    def mean(value: Column) -> Column:
        return F.avg(F.when(whole, value))

    summed = scored.groupBy(system).agg(
        F.count(F.when(whole, 1)).alias("samples"),
        F.count(F.when(~whole, 1)).alias("incomplete"),
        F.count(F.when(whole & F.col("copied"), 1)).alias("copy_count"),
        mean(F.col("copied").cast("double")).alias("copy_rate"),
        *[mean(F.col(m)).alias(m) for m in METRICS[3:-1]],
        (mean(F.col("sari")["score"]) * 100).alias("sari"),
    )
    return summed if f1 is None else summed.join(f1.select(system, *F1_METRICS), system, "left")


def metric_rows(scores: DataFrame, system: str = "system", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row (system, metric, value) per score; those with F1 columns give them too."""
    metrics = metrics + tuple(m for m in F1_METRICS if m in scores.columns and m not in metrics)
    doubles = [F.col(m).cast("double").alias(m) for m in metrics]
    return scores.select(system, *doubles).unpivot([system], list(metrics), "metric", "value")


def compare_systems(rows: DataFrame, systems: list[str], system: str = "system") -> DataFrame:
    """Metrics as rows, systems as columns."""
    return rows.groupBy("metric").pivot(system, systems).agg(F.first("value"))


def verdict(copy_rate: Column, ratio: Column, predicted_fkgl: Column, source_fkgl: Column, f1_source: Column) -> Column:
    """FAIL, WARN or PASS with its reason, by the first rule that applies."""
    return (F.when(copy_rate > fixed.VERDICT_COPY, "FAIL: copying too much")
            .when(ratio > fixed.VERDICT_LENGTH, "WARN: not simplifying enough")
            .when(predicted_fkgl >= source_fkgl, "FAIL: not reducing complexity")
            .when(f1_source < fixed.VERDICT_MEANING, "FAIL: losing too much meaning")
            .otherwise("PASS"))
