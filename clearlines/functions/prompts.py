"""Prompts, training texts and token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.text import words


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by the column given for it."""
    parts: list = [template]
    for name, column in values.items():
        split: list = []
        for part in parts:
            if isinstance(part, str):
                pieces = part.split("{" + name + "}")
                for i, piece in enumerate(pieces):
                    split += [column, piece] if i else [piece]
            else:
                split.append(part)
        parts = split
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def build_prompt(text: Column, template: str = fixed.STANDARD_PROMPT) -> Column:
    """The prompt for one sentence."""
    return fill(template, text=text)


def training_text(normal: Column, simple: Column, template: str = fixed.TRAINING_TEXT) -> Column:
    """One training example from an aligned pair."""
    return fill(template, normal=normal, simple=simple)


def generation_budget(tokens: Column, max_length: int = fixed.MAX_LENGTH, least: int = fixed.MIN_BUDGET,
                      most: int = fixed.MAX_BUDGET) -> Column:
    """How many tokens a model may produce for an input of ``tokens`` tokens."""
    return F.least(F.lit(max_length), F.greatest(tokens, F.lit(least)), F.lit(most))


def default_tokens(text: Column) -> Column:
    """Stand-in for a tokenizer: the words themselves."""
    return words(text)


def truncate_tokens(tokens: Column, max_tokens: int = fixed.PROMPT_TOKENS) -> Column:
    """At most the first ``max_tokens`` tokens."""
    return F.slice(tokens, 1, max_tokens)


def token_parts(tokens: Column, size: int = fixed.TRAINING_TOKENS) -> Column:
    """The tokens in parts of ``size``, the last one shorter; one empty part for no tokens."""
    last = F.floor((F.greatest(F.size(tokens), F.lit(1)) - 1) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i * size + 1, size))


def pad_tokens(tokens: Column, pad: Column, size: int = fixed.TRAINING_TOKENS, side: str = "left") -> Column:
    """Exactly ``size`` tokens, filled up on the given side. Longer arrays are cut: see :func:`token_parts`."""
    kept = truncate_tokens(tokens, size)
    filling = F.array_repeat(pad, F.greatest(F.lit(size) - F.size(tokens), F.lit(0)))
    return F.concat(filling, kept) if side == "left" else F.concat(kept, filling)
