"""Greedy token-matching F1 over user-supplied token vectors.

Input rows are (pair_id, system, side, pos, vec); ``side`` is ``predicted``, ``reference`` or ``source``. Each
text is cut into blocks of consecutive tokens. Blocks of the two texts meet in an equi-join on
(pair, block number of the other text); numpy multiplies the two small matrices and returns
only the best value per token. No token pair ever becomes a row, no block grows with
the data, and a long text is spread over as many join keys as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.plans.staging import Staging

BLOCK = 256


def _best_udf():
    def best(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import pandas as pd

        def unit(vectors):
            matrix = np.array([np.asarray(v, dtype="float64") for v in vectors])
            norm = np.linalg.norm(matrix, axis=1, keepdims=True)
            return matrix / np.where(norm == 0, 1.0, norm)

        for predicted, other in batches:
            left, right = [], []
            for p, o in zip(predicted, other):
                cosine = unit(p) @ unit(o).T
                left.append(cosine.max(axis=1))
                right.append(cosine.max(axis=0))
            yield pd.DataFrame({"predicted": left, "other": right})

    return F.pandas_udf(best, "predicted array<double>, other array<double>")


SIDES = ("predicted", "reference", "source")


def vector_blocks(vectors: DataFrame, block: int = BLOCK, pair: str = "pair_id", system: str | None = None,
                  staging: Staging | None = None) -> DataFrame:
    """(pair, system, side, block, vecs): consecutive tokens of a text in one row, written once.

    ``side`` is one of ``SIDES``, anything else is an error. Predictions carry the name of their system;
    the other sides serve all systems of their pair. (pair, system, side, pos) must be unique.
    """
    known = F.when(F.col("side").isin(*SIDES), F.col("side")).otherwise(
        F.raise_error(F.concat(F.lit("unknown side: "), F.coalesce("side", F.lit("NULL")))))
    named = F.lit(None).cast("string") if system is None else F.when(F.col("side") == SIDES[0], F.col(system))
    rows = vectors.select(F.col(pair).alias("pair"), named.alias("system"), known.alias("side"),
                          F.floor(F.col("pos") / block).alias("block"), F.struct("pos", "vec").alias("at"))
    blocks = rows.groupBy("pair", "system", "side", "block").agg(F.sort_array(F.collect_list("at")).alias("rows"))
    blocks = blocks.select("pair", "system", "side", "block", F.transform("rows", lambda r: r["vec"]).alias("vecs"))
    return (staging or Staging(vectors.sparkSession)).part("vectors").write(blocks, "blocks")


def embedding_f1(blocks: DataFrame, other: str = "reference", baseline: float = 0.0, pair: str = "pair_id",
                 system: str | None = None) -> DataFrame:
    """Precision, recall and F1 of the predictions against one other side, rescaled by ``(x - baseline) / (1 - baseline)``.

    ``blocks`` come from :func:`vector_blocks`. One row per prediction; one without tokens on the other
    side scores 0, and so does, where no systems are named, a pair without a prediction.
    """
    if other not in SIDES[1:]:
        raise ValueError(f"unknown side: {other}")
    predicted = blocks.where(F.col("side") == SIDES[0])
    others = blocks.where(F.col("side") == other)
    theirs = others.select("pair", F.col("block").alias("o_block"), F.col("vecs").alias("o_vecs"))
    # the blocks that a pair's other text really has: numbers only
    numbers = others.groupBy("pair").agg(F.collect_set("block").alias("numbers"))
    ours = predicted.join(numbers, "pair").select(
        "pair", "system", F.col("block").alias("p_block"), F.col("vecs").alias("p_vecs"), F.explode("numbers").alias("o_block"))
    met = ours.join(theirs, ["pair", "o_block"]).select(
        "pair", "system", "p_block", "o_block", _best_udf()(F.col("p_vecs"), F.col("o_vecs")).alias("best"))
    sides = met.select("pair", "system", F.explode(F.array(
        F.struct(F.lit(True).alias("p"), F.col("p_block").alias("block"), F.col("best.predicted").alias("values")),
        F.struct(F.lit(False).alias("p"), F.col("o_block").alias("block"), F.col("best.other").alias("values")),
    )).alias("s")).select("pair", "system", "s.p", "s.block", F.posexplode("s.values").alias("at", "value"))
    tokens = sides.groupBy("pair", "system", "p", "block", "at").agg(F.max("value").alias("value"))
    means = tokens.groupBy("pair", "system").agg(F.avg(F.when(F.col("p"), F.col("value"))).alias("precision"),
                                                 F.avg(F.when(~F.col("p"), F.col("value"))).alias("recall"))
    total = F.col("precision") + F.col("recall")
    scored = means.withColumn("f1", F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total))
    values = ("precision", "recall", "f1")
    every = (predicted if system else predicted.unionByName(others)).select("pair", "system").distinct()
    same = (every["pair"] == scored["pair"]) & every["system"].eqNullSafe(scored["system"])
    rescaled = [F.coalesce((scored[c] - baseline) / (1 - baseline), F.lit(0.0)).alias(c) for c in values]
    keys = [every["pair"].alias(pair)] + ([every["system"].alias(system)] if system else [])
    return every.join(scored, same, "left").select(*keys, *rescaled)


def mean_f1(blocks: DataFrame, system: str = "system", baseline: float = 0.0) -> DataFrame:
    """Per system the mean F1 against the reference and against the source, as ``f1_reference`` and ``f1_source``."""
    means = [embedding_f1(blocks, side, baseline, system=system).groupBy(system).agg(F.avg("f1").alias(f"f1_{side}"))
             for side in SIDES[1:]]
    return means[0].join(means[1], system)
