"""A corpus, from raw documents to packed token sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; ``run`` writes each as Parquet in the
session's shared folder and gives it to the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clearlines.llm import language, neardup, packing, quality, secrets
from clearlines.llm.common import staged

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out("doc_id", 4, 2))
    return quality.keep_good(docs.select(*COLUMNS), quality.fit(docs, labels))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a clear language go."""
    learned = language.learn(docs, ~quality.held_out("doc_id", 3, 1))
    return language.keep_clear(docs.select(*COLUMNS), learned)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that with the smallest id."""
    return neardup.without_copies(docs.select(*COLUMNS))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets; ``n_chars`` follows the text."""
    return secrets.redacted(docs.select(*COLUMNS), "text", "n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of all documents that are left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("language id", language_stage), ("minhash near-dedup", dedup_stage),
          ("secret scans", secrets_stage), ("packing", packing_stage)]

#: No stage but the first's inputs can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
