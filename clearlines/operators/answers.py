"""Answers kept by content: equal prompts are asked once, over all documents, runs and restarts.

An answer's key is a hash of the model's name, the token budget and the prompt. What a table of answers holds is not
asked again, so a job that was killed goes on after its last whole attempt, and a corpus that grew asks for what is new.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clearlines.operators.generate import Generator, generate
from clearlines.plans.staging import Staging

SCHEMA = "answer_key string, text string, error string, run string"


@dataclass(frozen=True)
class Answers:
    """A Parquet folder of answers of the model that is called ``model``. Give another model, or version, another name.

    Failed calls are kept under the run that made them: they count there, and later runs ask again. Runs at the same
    time may ask a prompt twice; readers then take the answer of the run whose name is smallest.
    """

    folder: str
    model: str
    run: str = field(default_factory=lambda: uuid.uuid4().hex)

    def read(self, spark: SparkSession) -> DataFrame:
        """``answer_key, text, error, run``: every call that was made."""
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.folder)
        return spark.read.schema(SCHEMA).parquet(self.folder)

    def key(self, prompt: Column, budget: Column) -> Column:
        """NULL for a NULL prompt, which is not asked."""
        whole = F.concat_ws("\x1f", F.lit(self.model), budget.cast("string"), prompt)
        return F.when(prompt.isNotNull(), F.sha2(whole, 256))

    def ask(self, df: DataFrame, generator: Generator, prompt: str, budget: str, into: str, error: str,
            partitions: int, staging: Staging, name: str) -> DataFrame:
        """Add the text and, where the call failed, the error to ``df``, asking only what is not known yet."""
        spark, key = df.sparkSession, "_answer_key"
        keyed = df.withColumn(key, self.key(F.col(prompt), F.col(budget)))
        # one row for a prompt, however many sentences have it: counted up before the shuffle
        wanted = keyed.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("answer_key")).agg(
            F.any_value(prompt).alias("prompt"), F.any_value(budget).alias("budget"))
        known = self.read(spark).where(F.col("error").isNull() | (F.col("run") == self.run))
        new = wanted.join(known, "answer_key", "left_anti").repartition(partitions, "answer_key")
        made = generate(new, generator, F.col("prompt"), F.col("budget"), "text", "error")
        made.select("answer_key", "text", "error", F.lit(self.run).alias("run")).write.mode("append").parquet(self.folder)
        known = self.read(spark).where(F.col("error").isNull() | (F.col("run") == self.run))
        best = F.min(F.struct(F.col("error").isNotNull().alias("failed"), "run", "text", "error"))
        found = known.join(wanted.select("answer_key"), "answer_key", "left_semi").groupBy("answer_key").agg(best.alias("best"))
        # both sides of the join are tables, so a prompt of very many rows is split by the skewed join
        found = staging.write(found.select(F.col("answer_key").alias(key), F.col("best.text").alias(into),
                                           F.col("best.error").alias(error)), name)
        return keyed.join(found, key, "left").drop(key)
