"""Connected components as Spark joins: large and small stars in turn, until every edge is a star's ray."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.plans.staging import shared_folder

SALTS = 256


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """``u, salt, low`` with the least ``v`` of each ``u``: one row for each salt that ``u`` occurs with, so
    that a node with very many neighbours is joined in ``SALTS`` parts."""
    parts = pairs.groupBy("u", "salt").agg(F.min("v").alias("v"))
    lows = parts.groupBy("u").agg(F.min("v").alias("low"), F.collect_set("salt").alias("salts"))
    return lows.select("u", F.explode("salts").alias("salt"), "low")


def _salted(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = _salted(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    joined = both.join(_least_neighbours(both), ["u", "salt"]).where(F.col("v") > F.col("u"))
    return joined.select(F.col("v").alias("u"), F.least("u", "low").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Needs ``u > v``."""
    rays = _salted(pairs)
    joined = rays.join(_least_neighbours(rays), ["u", "salt"])
    ends = F.explode(F.array(F.col("u"), F.col("v"))).alias("u")
    return joined.select(ends, F.col("low").alias("v")).where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, left: str = "left", right: str = "right") -> DataFrame:
    """``node, component`` (its smallest node) of every node of an edge.

    Loops and edges with a NULL end are left out; repeated edges count once; no edges give no rows.
    Each round is checkpointed in the session's shared folder. Rounds grow with the logarithm of a
    component's diameter.
    """
    spark = edges.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    a, b = F.col(left), F.col(right)
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    while True:
        ends = pairs.select("u", F.lit(1).alias("out"), F.lit(0).alias("root")).unionByName(
            pairs.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("root")))
        # done when no node has two smaller neighbours, or a smaller one and a larger one
        busy = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
        if busy.where((F.col("out") > 1) | (F.col("out") + F.col("root") > 1)).isEmpty():
            break
        pairs = _small_star(_large_star(pairs)).checkpoint()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
