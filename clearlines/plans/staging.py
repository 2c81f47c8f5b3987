"""Written stage tables in the shared checkpoint folder.

A model's answers must not be computed twice and must survive a lost executor, so each
attempt is written as a parquet table and read back. Tables live below the folder that
``spark.checkpoint.dir`` names, or, where it is unset, below the session's warehouse.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names, else one in its warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints").rstrip("/")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs in here remove their shuffle files when they end, not when the driver next collects garbage: for stages that are written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    usual = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, usual)


class Staging:
    """Names and writes the stage tables of one run. A stage is written once: an existing one is an error."""

    def __init__(self, spark: SparkSession, run: str | None = None):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/clearlines/{run or uuid.uuid4().hex}"

    def part(self, name: str) -> Staging:
        """A folder of its own below this run, for one call of an operator."""
        return Staging(self.spark, f"{self.folder.rpartition('/clearlines/')[2]}/{name}-{uuid.uuid4().hex[:12]}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once, in folders by the columns ``by``, and return the table."""
        df.write.partitionBy(*(by or [])).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def close(self) -> None:
        """Remove this run's tables. What was made from them must have been written by then."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
