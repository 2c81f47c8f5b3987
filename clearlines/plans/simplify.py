"""Documents in, simplified (and translated) documents out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clearlines.operators.answers import Answers
from clearlines.operators.documents import explode_sentences, join_sentences, map_sentences
from clearlines.operators.generate import HEURISTIC, Generator, Rule
from clearlines.operators.ladder import TWO, Ladder, run_ladder
from clearlines.operators.translate import in_languages, translate
from clearlines.plans.staging import Staging


def simplify_by_rule(df: DataFrame, text: str = "text", rule: Rule = HEURISTIC, into: str = "simplified") -> DataFrame:
    """Rewrite every sentence with a rule, without attempts or gate: no shuffle at all.

    Works on streams as it does on tables.
    """
    return df.withColumn(into, map_sentences(F.col(text), rule.steps))


def simplify(df: DataFrame, key: str = "doc_id", text: str = "text", generator: Generator | Rule = HEURISTIC,
             ladder: Ladder = TWO, staging: Staging | None = None, partitions: int | None = None,
             answers: Answers | None = None) -> DataFrame:
    """Add ``simplified``, ``sentences`` and ``failed_calls`` to a table of documents.

    ``key`` must be unique: a NULL key or one of two different texts with sentences raises an error. Documents without a sentence keep their text. Sentences, not
    documents, are the unit of work, so one long document does not hold up a task. ``answers`` keeps what models say by content.
    """
    sentences = explode_sentences(df.select(key, text, F.xxhash64(text).alias("_mark")), text)
    answered = run_ladder(sentences, [key, "pos"], generator, ladder, staging, partitions, answers)
    joined = join_sentences(answered, [key], "simplified", "pos", "simplified",
                            F.count(F.lit(1)).alias("sentences"), F.sum("failed_calls").alias("failed_calls"),
                            F.first("_mark").alias("_mark"))
    zero = F.lit(0).cast("bigint")
    unnamed = F.raise_error(F.lit("a document's key is NULL"))
    own = (F.col("_mark").isNull() | (F.col("_mark") == F.xxhash64(text)))
    return (df.join(joined, key, "left")
            .withColumn("simplified", F.when(F.col(key).isNull(), unnamed).when(own, F.coalesce(F.col("simplified"), F.col(text)))
                        .otherwise(F.raise_error(F.lit("two documents have one key")))).drop("_mark")
            .withColumn("sentences", F.coalesce(F.col("sentences"), zero))
            .withColumn("failed_calls", F.coalesce(F.col("failed_calls"), zero)))


def simplify_and_translate(df: DataFrame, translator: Callable, languages: list[str], key: str = "doc_id",
                           text: str = "text", generator: Generator | Rule = HEURISTIC, ladder: Ladder = TWO,
                           staging: Staging | None = None, partitions: int | None = None) -> DataFrame:
    """Both stages: one row per document and language."""
    staging = (staging or Staging(df.sparkSession)).part("two_stages")
    simple = simplify(df, key, text, generator, ladder, staging, partitions)
    if isinstance(generator, Generator):
        simple = staging.write(simple, "simplified")
    return translate(in_languages(simple, languages), "simplified", "language", translator,
                     keys=[key, "language"], partitions=partitions, staging=staging)
