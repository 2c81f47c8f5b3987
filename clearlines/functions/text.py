"""Cutting and cleaning text (one pass of built-in functions each, no Python).

Most functions mention their input once, so that nesting them never repeats work:
alternatives are put into the regular expression instead of into ``when``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed

# The whitespace class in Java's own terms, several times faster there than the spelled-out list.
WS = r"(?U:[\s\x1c-\x1f])"
NOT_WS = r"(?U:[^\s\x1c-\x1f])"
BREAK = f"(?<={fixed.SENTENCE_END}){WS}+(?={fixed.SENTENCE_START})"


def not_ws_or(chars: str) -> str:
    """Class of what is neither whitespace nor one of ``chars``."""
    return rf"(?U:[^\s\x1c-\x1f{chars}])"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(fixed.WS_CHARS))


def collapse_ws(text: Column) -> Column:
    """One space between words, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words."""
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def words(text: Column) -> Column:
    """The whitespace-separated words as an array."""
    return F.regexp_extract_all(text, F.lit(f"{NOT_WS}+"), F.lit(0))


def split_sentences(text: Column) -> Column:
    """Array of sentences: cut after ``.!?`` and whitespace before an ASCII capital.

    The pieces need no further trimming: the text is stripped first and each cut
    swallows the whitespace around it. Abbreviations (``Dr. Smith``) are cut too.
    """
    body = strip(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, BREAK, -1))


def sentence_count(text: Column) -> Column:
    """Size of :func:`split_sentences` without building the array or stripping the text: no cut stands at an end."""
    cuts = F.regexp_count(text, F.lit(f"{fixed.SENTENCE_END}{WS}+(?={fixed.SENTENCE_START})"))
    return F.when(~text.rlike(NOT_WS), F.lit(0)).otherwise(cuts + 1)


def first_sentence(text: Column) -> Column:
    """Shortest start that ends in ``.!?`` before whitespace or the end, else the whole.

    A first sentence never spans a line feed, as ``.`` does not match one.
    """
    pattern = rf"(?d)\A(.*?{fixed.SENTENCE_END})(?:{WS}(?s:.*)|\z)"
    return F.regexp_replace(strip(text), pattern, "$1")


def close_sentence(text: Column, collapse: bool = True) -> Column:
    """Tidy spaces and closing punctuation; blank text becomes empty."""
    body = collapse_ws(text) if collapse else strip(text)
    return F.regexp_replace(body, r"([^.!?])\z", "$1.")


def capitalise(text: Column) -> Column:
    """Capital first letter, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def clean_sentence(text: Column, collapse: bool = True) -> Column:
    """Capital first letter and closing punctuation; blank text becomes empty."""
    return capitalise(close_sentence(text, collapse))


def extract_response(text: Column, markers: tuple[str, ...] = fixed.RESPONSE_MARKERS) -> Column:
    """Text after the last occurrence of the first marker that occurs at all."""
    options = "|".join(f".*{re.escape(m)}" for m in markers)
    return strip(F.regexp_replace(text, rf"(?s)\A(?:{options})", ""))


def cut_at_stop(text: Column, stops: tuple[str, ...] = fixed.STOP_MARKERS) -> Column:
    """Text before the first stop marker, taken marker by marker."""
    for stop in stops:
        text = strip(F.substring_index(text, stop, 1))
    return text


def decode_output(text: Column) -> Column:
    """Raw model output to one candidate sentence (marker, stops, first sentence, spaces)."""
    return collapse_ws(first_sentence(cut_at_stop(extract_response(strip(text)))))


def decode_quantised(text: Column) -> Column:
    """Like :func:`decode_output` for a model that stops by itself and echoes no prompt.

    Stops act on the raw output: one that opens with a blank line is empty.
    """
    for stop in fixed.QUANTISED_STOPS:
        text = F.substring_index(text, stop, 1)
    return first_sentence(text)


def decode_merged(text: Column) -> Column:
    """Only the response marker and the first sentence."""
    return first_sentence(extract_response(text, fixed.MERGED_MARKERS))


def empty_fallback(text: Column, source: Column) -> Column:
    """The source wherever the text is NULL or blank."""
    return F.when(strip(text) != "", text).otherwise(source)


def normalise(text: Column) -> Column:
    """Lower case, no outer whitespace: the form in which texts are scored."""
    return strip(F.lower(text))
