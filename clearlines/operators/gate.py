"""Is a candidate faithful to its source, a copy of it, simpler than it?

All rules are boolean columns. The one rule that can need Python, the similarity
ratio, is asked only for rows that pass every other rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.similarity import reaches, with_reaches
from clearlines.functions.terms import (
    avg_word_len, extract_numbers, key_terms, long_word_count, no_stop_words, numbers_in, term_words, token_count,
)
from clearlines.functions.text import normalise, strip


@dataclass(frozen=True)
class GateConfig:
    """Limits of a gate.

    ``whole_added`` rounds the share of added terms down to a whole number;
    ``reject_blank`` refuses blank candidates before any other rule. ``max_ratio=None``
    leaves the similarity rule out; ``skip_frequent=True`` leaves out characters that are
    frequent in long texts, as ``difflib`` does on its own: long near copies may then pass.
    """

    max_ratio: float | None
    max_missing: float
    min_added: int
    added_share: float
    whole_added: bool
    reject_blank: bool
    stop_words: tuple[str, ...] = fixed.STOP_WORDS
    skip_frequent: bool = False


# --- fixed values: the two gates ---
STRICT = GateConfig(max_ratio=0.92, max_missing=0.55, min_added=3, added_share=0.30,
                    whole_added=False, reject_blank=False)
LOOSE = GateConfig(max_ratio=0.97, max_missing=0.60, min_added=4, added_share=0.35,
                   whole_added=True, reject_blank=True)


def source_facts(source: Column, gate: GateConfig) -> Column:
    """Key terms, numbers and plain form of a source: make them a column before sources are multiplied by candidates."""
    return F.struct(key_terms(source, gate.stop_words).alias("terms"), extract_numbers(source).alias("numbers"),
                    normalise(source).alias("plain"))


def with_facts(df: DataFrame, source: str, candidate: str, gate: GateConfig, into: str, known: str | None = None) -> DataFrame:
    """Add what the rules compare: whether both texts are the same, and the sizes of source terms, new numbers, missing and added terms.

    ``known`` names a column of :func:`source_facts`. Gates of the same stop words share the result. What no rule asks is NULL: numbers
    and terms of the same text, and missing and added terms where numbers are new or the source has no terms.
    """
    old, low, same, numbers, words = (f"{into}_{name}" for name in ("old", "low", "same", "numbers", "words"))
    df = df.withColumns({old: source_facts(F.col(source), gate) if known is None else F.col(known), low: F.lower(F.col(candidate))})
    terms, plain = F.col(old)["terms"], F.col(old)["plain"]
    # most texts need no strip to be told apart
    df = df.withColumn(same, F.when(F.col(low) == plain, F.lit(True)).when(F.octet_length(low) <= F.octet_length(plain), F.lit(False))
                       .otherwise(strip(F.col(low)) == plain))
    df = df.withColumn(numbers, F.size(F.array_except(numbers_in(F.when(~F.col(same), F.col(candidate))), F.col(old)["numbers"])))
    asked = (F.col(numbers) == 0) & (F.size(terms) > 0)
    df = df.withColumn(words, term_words(F.when(asked, F.col(low))))
    # no term of the source is a stop word, so only words that it does not have are looked up among those
    none = F.size(words) == 0
    missing = F.when(none, F.size(terms)).otherwise(F.size(F.array_except(terms, F.col(words))))
    added = F.when(none, 0).otherwise(F.size(no_stop_words(F.array_except(F.col(words), terms), gate.stop_words)))
    facts = F.struct(F.col(same).alias("same"), F.size(terms).alias("terms"), missing.alias("missing"), added.alias("added"),
                     F.col(numbers).alias("numbers"))
    return df.withColumn(into, facts).drop(old, low, same, numbers, words)


def fact_sizes(old: Column, new: Column, old_numbers: Column, new_numbers: Column) -> Column:
    """The same from the terms and numbers of both texts."""
    return F.struct(
        F.size(old).alias("terms"),
        F.size(F.array_except(old, new)).alias("missing"),
        F.size(F.array_except(new, old)).alias("added"),
        F.size(F.array_except(new_numbers, old_numbers)).alias("numbers"),
    )


def early_reason(source: Column, candidate: Column, gate: GateConfig, facts: Column | None = None) -> Column:
    same = F.when(normalise(source) == normalise(candidate) if facts is None else facts["same"], "same")
    if gate.reject_blank:
        return F.when(strip(candidate) == "", "blank").otherwise(same)
    return same


def late_reason(facts: Column, gate: GateConfig) -> Column:
    allowed = facts["terms"] * gate.added_share
    allowed = F.greatest(F.lit(float(gate.min_added)), F.floor(allowed).cast("double") if gate.whole_added else allowed)
    missing = facts["missing"] / F.greatest(facts["terms"], F.lit(1))
    return (F.when(facts["numbers"] > 0, "numbers")
            .when(facts["terms"] == 0, F.lit(None).cast("string"))
            .when(missing > gate.max_missing, "missing")
            .when(facts["added"].cast("double") > allowed, "added"))


def with_rules(df: DataFrame, source: str, candidate: str, gate: GateConfig, into: str = "rule",
               facts: str | None = None) -> DataFrame:
    """Add the first failed rule apart from similarity (NULL: none failed). ``facts`` names a column of :func:`with_facts`."""
    made = facts or f"{into}_facts"
    df = df if facts else with_facts(df, source, candidate, gate, made)
    early = early_reason(F.col(source), F.col(candidate), gate, F.col(made))
    df = df.withColumn(into, F.coalesce(early, late_reason(F.col(made), gate)))
    return df if facts else df.drop(made)


def with_verdict(df: DataFrame, source: str, candidate: str, gate: GateConfig, into: str = "passed",
                 facts: str | None = None) -> DataFrame:
    """Add whether the candidate passes the whole gate (false for NULL candidates). ``facts`` as in :func:`with_rules`."""
    rule = f"{into}_rule"
    df = with_rules(df, source, candidate, gate, rule, facts)
    df = df.withColumn(into, F.col(candidate).isNotNull() & F.col(rule).isNull()).drop(rule)
    if gate.max_ratio is None:
        return df
    close = f"{into}_close"
    df = with_reaches(df, F.lower(F.col(source)), F.lower(F.col(candidate)), gate.max_ratio, close, where=F.col(into),
                      skip_frequent=gate.skip_frequent)
    return df.withColumn(into, F.coalesce(F.col(into) & ~F.col(close), F.lit(False))).drop(close)


def with_reason(df: DataFrame, source: str, candidate: str, gate: GateConfig, into: str = "reason",
                facts: str | None = None) -> DataFrame:
    """Add the first failed rule in the order blank, same, ratio, numbers, missing, added; ``ok`` if none.

    ``facts`` as in :func:`with_rules`.
    """
    made, close, late = facts or f"{into}_facts", f"{into}_close", f"{into}_late"
    src, cand = F.col(source), F.col(candidate)
    df = df if facts else with_facts(df, source, candidate, gate, made)
    df = df.withColumns({into: early_reason(src, cand, gate, F.col(made)),
                         late: F.when(cand.isNotNull(), F.coalesce(late_reason(F.col(made), gate), F.lit("ok")))})
    if gate.max_ratio is not None:
        df = with_reaches(df, F.lower(src), F.lower(cand), gate.max_ratio, close, where=F.col(into).isNull(),
                          skip_frequent=gate.skip_frequent)
        df = df.withColumn(into, F.coalesce(F.col(into), F.when(F.col(close), "ratio"))).drop(close)
    df = df.withColumn(into, F.coalesce(F.col(into), F.col(late))).drop(late)
    return df if facts else df.drop(made)


def surface(text: Column) -> Column:
    """Words, their mean length and the long ones among them: for sources, a column made before they are multiplied by candidates."""
    return F.struct(F.greatest(token_count(text), F.lit(1)).alias("words"), avg_word_len(text).alias("average"),
                    long_word_count(text).alias("long"))


def simpler_surface(source: Column, candidate: Column, known: Column | None = None) -> Column:
    """Not longer, and with shorter words on average or fewer long ones. ``known`` is the source's :func:`surface`."""
    old, new = surface(source) if known is None else known, surface(candidate)
    shorter = new["words"] <= F.floor(old["words"] * fixed.SURFACE_WORDS)
    simpler = new["average"] <= old["average"] - fixed.SURFACE_SHORTER_BY
    fewer = new["long"] <= old["long"] - fixed.SURFACE_FEWER_LONG
    return shorter & (simpler | fewer)


def mostly_copy(source: Column, candidate: Column, where: Column | None = None, skip_frequent: bool = False) -> Column:
    """Blank, the same text in any case, or above the near-copy ratio."""
    plain = (strip(candidate) == "") | (normalise(candidate) == normalise(source))
    needed = ~plain if where is None else where & ~plain
    near = reaches(F.lower(source), F.lower(candidate), fixed.MOSTLY_COPY_RATIO, where=needed,
                   skip_frequent=skip_frequent)
    return plain | F.coalesce(near, F.lit(False))
