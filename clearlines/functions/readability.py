"""Reading grade and reading ease (published formulas, vowel-group syllables)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.text import NOT_WS, not_ws_or, sentence_count, word_count

def syllable_count(text: Column) -> Column:
    """Vowel groups, and one for each word that has none, found in one pass."""
    lone = f"(?<!{NOT_WS}){not_ws_or(fixed.VOWELS[1:-2])}++(?!{NOT_WS})"
    return F.regexp_count(F.lower(text), F.lit(f"{fixed.VOWELS}|{lone}"))


def text_counts(text: Column) -> Column:
    """Struct of words, sentences and syllables, words and sentences at least 1, and ``found``: words that may be 0."""
    found = word_count(text)
    return F.struct(
        found.cast("double").alias("found"),
        F.greatest(found, F.lit(1)).cast("double").alias("words"),
        F.greatest(sentence_count(text), F.lit(1)).cast("double").alias("sentences"),
        syllable_count(text).cast("double").alias("syllables"),
    )


def fkgl(counts: Column) -> Column:
    """Reading grade from :func:`text_counts`."""
    a, b, c = fixed.FKGL
    return (F.lit(a) * counts["words"] / counts["sentences"]
            + F.lit(b) * counts["syllables"] / counts["words"] - F.lit(c))


def fre(counts: Column) -> Column:
    """Reading ease from :func:`text_counts`."""
    a, b, c = fixed.FRE
    return (F.lit(a) - F.lit(b) * counts["words"] / counts["sentences"]
            - F.lit(c) * counts["syllables"] / counts["words"])
