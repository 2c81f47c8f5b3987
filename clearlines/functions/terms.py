"""Numbers, key terms and surface counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed


def extract_numbers(text: Column) -> Column:
    """Distinct numbers, with decimals and percent sign, as an array of text."""
    return F.array_distinct(numbers_in(text))


def numbers_in(text: Column) -> Column:
    """The same as they stand, with repeats."""
    return F.regexp_extract_all(text, F.lit(fixed.NUMBER), F.lit(0))


def key_terms(text: Column, stop_words: tuple[str, ...] = fixed.STOP_WORDS) -> Column:
    """Distinct lower-case words of four letters or more that are not stop words."""
    return F.array_distinct(no_stop_words(term_words(F.lower(text)), stop_words))


def term_words(lower: Column) -> Column:
    """Words of four letters or more of a lower-case text as they stand, with repeats and stop words."""
    return F.regexp_extract_all(lower, F.lit(fixed.KEY_TERM), F.lit(0))


def no_stop_words(words: Column, stop_words: tuple[str, ...] = fixed.STOP_WORDS) -> Column:
    # array_except would build its set of stop words anew for each text
    return F.filter(words, lambda word: ~word.isin(*stop_words))


def token_count(text: Column) -> Column:
    """Runs of ASCII letters."""
    return F.regexp_count(text, F.lit(fixed.LETTERS))


def avg_word_len(text: Column) -> Column:
    """Mean length of the letter runs, 0.0 without any."""
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))
    return F.coalesce(F.try_divide(letters.cast("double"), token_count(text).cast("double")),
                      F.when(text.isNotNull(), F.lit(0.0)))


def long_word_count(text: Column, at_least: int = fixed.LONG_WORD) -> Column:
    """Letter runs of at least the given length."""
    return F.regexp_count(text, F.lit(f"[A-Za-z]{{{at_least},}}"))
