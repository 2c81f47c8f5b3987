"""Language names, tags, and spacing of translated text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.text import WS, strip


def language_tag(name: Column, languages: Mapping[str, str] = fixed.LANGUAGES) -> Column:
    """Tag of a language name, the default tag for unknown names.

    The table has eleven rows, so it is a literal in the plan: no join at all.
    """
    pairs = [F.lit(x) for item in languages.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[name], F.lit(fixed.DEFAULT_TAG))


def ensure_lang_tags(text: Column, tag: Column, languages: Mapping[str, str] = fixed.LANGUAGES) -> Column:
    """Put source and target tag before the text unless it starts with known tags."""
    known = "|".join(languages.values())
    tagged = text.rlike(rf"\A{fixed.SOURCE_TAG} (?:{known}) ")
    return F.when(tagged, text).otherwise(F.concat(F.lit(fixed.SOURCE_TAG + " "), tag, F.lit(" "), text))


def clean_translation(text: Column) -> Column:
    """Spacing around punctuation, brackets and double quotes in translated text."""
    text = F.regexp_replace(text, f"{WS}+", " ")
    text = F.regexp_replace(text, f"{WS}+([।,;:!?])", "$1")
    text = F.regexp_replace(text, f'([("]){WS}+', "$1")
    text = F.regexp_replace(text, f'{WS}+([)"])', "$1")
    return strip(text)
