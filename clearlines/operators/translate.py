"""Translation by a user-supplied batch callable, one row per document and language.

The factory builds a callable that takes tagged texts and one target tag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines.functions.languages import clean_translation, ensure_lang_tags, language_tag
from clearlines.functions.text import strip
from clearlines.operators.generate import batch_udf
from clearlines.plans.staging import Staging

TranslateCall = Callable[[list[str], str], list[str]]


def _per_tag(factory: Callable[[], TranslateCall]):
    """A generator-style factory that calls the translator once per tag in a batch."""

    def build():
        translate = factory()

        def call(texts, tags):
            out = [None] * len(texts)
            for tag in sorted(set(tags)):
                at = [i for i, t in enumerate(tags) if t == tag]
                answers = list(translate([texts[i] for i in at], tag))
                if len(answers) != len(at):
                    raise ValueError(f"{len(answers)} translations of {len(at)} texts")
                for i, answer in zip(at, answers):
                    out[i] = answer
            return out

        return call

    return build


def in_languages(df: DataFrame, languages: list[str], into: str = "language") -> DataFrame:
    """One copy of each row per language, made in the row rather than by a join."""
    return df.withColumn(into, F.explode(F.array(*[F.lit(name) for name in languages])))


def translate(df: DataFrame, text: str, language: str | Column, factory: Callable[[], TranslateCall],
              into: str = "translated", keys: list[str] | None = None, partitions: int | None = None,
              staging: Staging | None = None) -> DataFrame:
    """Add the cleaned translation and ``translate_error``; the text itself stays where there is no answer.

    Unknown language names mean the default tag. Blank texts are not sent. With ``keys``
    the rows are spread evenly over ``partitions`` model tasks first. The answers are written, so
    each text is sent once however often the result is read.
    """
    if partitions:
        df = df.repartition(partitions, *(keys or df.columns))
    name = F.col(language) if isinstance(language, str) else language
    df = df.withColumn("_tag", language_tag(name))
    wanted = F.when(strip(F.col(text)) != "", ensure_lang_tags(F.col(text), F.col("_tag")))
    df = df.withColumn("_answer", batch_udf(_per_tag(factory))(wanted, F.col("_tag")))
    df = (staging or Staging(df.sparkSession)).part("translate").write(df, "answers")
    return (df.withColumn(into, F.coalesce(clean_translation(F.col("_answer.text")), F.col(text)))
            .withColumn("translate_error", F.col("_answer.error")).drop("_answer", "_tag"))
