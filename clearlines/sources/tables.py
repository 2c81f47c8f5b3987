"""Reading tables so that all cores have work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Shuffle by key into ``partitions`` tasks if that is asked for.

    Text work costs far more per byte than reading, and a small file (or one of a single row
    group) is one task. The splits of a large table are tasks enough: leave it as it is.
    """
    return df.repartition(partitions, key) if partitions else df


def even_tasks(df: DataFrame) -> float:
    """How many tasks of the largest one's rows a table just read comes in. Rows are counted from the files' footers."""
    parts = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    every, most = parts.agg(F.sum("rows"), F.max("rows")).first()
    return every / most if most else 0.0
