"""Attempt ladders: ask, decode, gate, ask again for what failed, fall back.

A ladder is data: prompts with their token budgets, a decoder, a gate and a fallback.
Every gated attempt is a written table that holds the candidates so far, and only its failed
rows go on to the next attempt: no model is asked twice, and plans stay small however many
attempts there are. A :class:`Rule` without a gate is one projection and writes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.prompts import build_prompt, default_tokens, generation_budget
from clearlines.functions.rewrite import heuristic_simplify
from clearlines.functions.text import clean_sentence, decode_merged, decode_output, decode_quantised
from clearlines.operators.answers import Answers
from clearlines.operators.gate import LOOSE, STRICT, GateConfig, mostly_copy, simpler_surface, with_verdict
from clearlines.operators.generate import Generator, Rule, generate
from clearlines.plans.staging import Staging


@dataclass(frozen=True)
class Attempt:
    """A prompt template and the token budget (fixed, or ``None`` for one by input size)."""

    template: str
    budget: int | None = None


@dataclass(frozen=True)
class Ladder:
    """``fallback`` is ``shorter`` (of all tries), ``simplest`` (usable try, else rules) or ``source``.

    An attempt without a budget of its own asks for as many tokens as its input has, within
    ``min_budget``, ``max_budget`` and ``max_length``: longer answers are cut by the model.
    """

    attempts: tuple[Attempt, ...]
    decode: Callable[[Column], Column]
    gate: GateConfig | None
    fallback: str
    collapse: bool = True
    tokens: Callable[[Column], Column] = default_tokens
    max_length: int = fixed.MAX_LENGTH
    min_budget: int = fixed.MIN_BUDGET
    max_budget: int = fixed.MAX_BUDGET


TWO = Ladder(
    attempts=(Attempt(fixed.STANDARD_PROMPT), Attempt(fixed.RETRY_PROMPT)),
    decode=decode_output, gate=STRICT, fallback="shorter", collapse=False,
)
THREE = Ladder(
    attempts=(Attempt(fixed.QUANTISED_PROMPT, fixed.QUANTISED_BUDGET),
              Attempt(fixed.QUANTISED_RETRY_PROMPT, fixed.QUANTISED_BUDGET),
              Attempt(fixed.QUANTISED_LAST_PROMPT, fixed.QUANTISED_LAST_BUDGET)),
    decode=decode_quantised, gate=LOOSE, fallback="simplest",
)
UNGATED = Ladder(
    attempts=(Attempt(fixed.MERGED_PROMPT, fixed.MERGED_BUDGET),),
    decode=decode_merged, gate=None, fallback="source",
)


def shortest(candidates: list[Column]) -> Column:
    """The shortest non-NULL candidate, the first one on ties; NULL if there is none."""
    ranked = [F.when(c.isNotNull(), F.struct(F.length(c).alias("length"), F.lit(i).alias("attempt"), c.alias("text")))
              for i, c in enumerate(candidates)]
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["text"]


def shortest_candidate(df: DataFrame, keys: list[str], attempt: str, text: str) -> DataFrame:
    """Per key the shortest text of the candidate rows, the earliest attempt on ties."""
    best = F.min_by(F.col(text), F.struct(F.length(F.col(text)), F.col(attempt)))
    return df.where(F.col(text).isNotNull()).groupBy(*keys).agg(best.alias(text))


def _with_fallback(df: DataFrame, ladder: Ladder, tries: list[str], staging: Staging) -> DataFrame:
    """Add ``_fallback``: what a sentence becomes when no attempt passed."""
    source = F.col("sentence")
    if ladder.fallback == "source":
        cleaned = clean_sentence(F.col(tries[0]), ladder.collapse)
        return df.withColumn("_fallback", F.when(cleaned != "", cleaned).otherwise(
            clean_sentence(source, ladder.collapse)))
    if ladder.fallback == "shorter":
        best = clean_sentence(shortest([F.col(t) for t in tries]), ladder.collapse)
        return df.withColumn("_fallback", F.coalesce(best, clean_sentence(source, ladder.collapse)))
    skip_frequent = ladder.gate is not None and ladder.gate.skip_frequent
    cleaned = {f"_clean_{t}": f"_worth_{t}" for t in tries}
    df = df.withColumns({f"_clean_{t}": clean_sentence(F.col(t), ladder.collapse) for t in tries})
    df = df.withColumns({worth: F.coalesce((F.col(name) != "") & simpler_surface(source, F.col(name)), F.lit(False))
                         for name, worth in cleaned.items()})
    df = staging.write(df, "candidates")
    usable = []
    for name, worth in cleaned.items():
        copy = mostly_copy(source, F.col(name), where=F.col(worth), skip_frequent=skip_frequent)
        usable.append(F.when(F.col(worth) & ~copy, F.col(name)))
    return df.withColumn("_fallback", F.coalesce(shortest(usable), heuristic_simplify(source)))


def _ask(pending: DataFrame, generator: Generator | Rule, ladder: Ladder, number: int, keys: list[str],
         partitions: int, staging: Staging, answers: Answers | None = None) -> DataFrame:
    """Add the decoded answers to one prompt and the errors of failed calls."""
    name, error, attempt = f"_try_{number}", f"_error_{number}", ladder.attempts[number - 1]
    if isinstance(generator, Rule):
        answered = pending.withColumn(name, generator(F.col("sentence"))).withColumn(error, F.lit(None).cast("string"))
    else:
        by_size = generation_budget(F.size(ladder.tokens(F.col("sentence"))), ladder.max_length, ladder.min_budget,
                                    ladder.max_budget)
        budget = by_size if attempt.budget is None else F.lit(attempt.budget)
        asked = pending.withColumn("_prompt", build_prompt(F.col("sentence"), attempt.template)).withColumn("_budget", budget)
        if answers is None:
            # model time per row dwarfs the shuffle: spread the rows that are left evenly
            answered = generate(asked.repartition(partitions, *keys), generator, F.col("_prompt"), F.col("_budget"), name, error)
        else:
            answered = answers.ask(asked, generator, "_prompt", "_budget", name, error, partitions, staging, f"answers_{number}")
        answered = answered.drop("_prompt", "_budget")
    return answered.withColumn(name, ladder.decode(F.col(name)))


def _with_errors(df: DataFrame, attempts: int) -> DataFrame:
    """Add the first error of the attempts so far, and how many failed."""
    errors = [F.col(f"_error_{i}") for i in range(1, attempts + 1)]
    failed = reduce(lambda a, b: a + b, [e.isNotNull().cast("bigint") for e in errors])
    return df.withColumn("error", F.coalesce(*errors)).withColumn("failed_calls", failed)


def run_ladder(sentences: DataFrame, keys: list[str], generator: Generator | Rule, ladder: Ladder,
               staging: Staging | None = None, partitions: int | None = None, answers: Answers | None = None) -> DataFrame:
    """Add ``simplified``, ``error`` (of the first failed call) and ``failed_calls`` to rows that hold a ``sentence``.

    ``keys`` identify a row. ``partitions`` is the number of model tasks per attempt. A failed call
    has no text: it fails the gate and never competes; without any text the cleaned sentence stays.
    With ``answers`` equal prompts are asked once, and what an earlier run was answered not at all.
    """
    spark = sentences.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                   spark.sparkContext.defaultParallelism)
    staging = (staging or Staging(spark)).part("ladder")
    out = [*sentences.columns, "simplified", "error", "failed_calls"]
    done, tries, pending = [], [], sentences
    for i in range(1, len(ladder.attempts) + 1):
        name, ok = f"_try_{i}", f"_ok_{i}"
        answered = _ask(pending, generator, ladder, i, keys, partitions, staging, answers)
        tries.append(name)
        if ladder.gate is None:
            pending = answered if isinstance(generator, Rule) else staging.write(answered, "attempt_1")
            break
        # answers and verdicts are on disk before anything reads them twice
        # and each branch reads the rows of its verdict alone
        judged = with_verdict(answered, "sentence", name, ladder.gate, into=ok)
        stage = staging.write(judged, f"attempt_{i}", [ok])
        passed = stage.where(F.col(ok))
        done.append(_with_errors(passed.withColumn("simplified", clean_sentence(F.col(name), ladder.collapse)), i).select(*out))
        pending = stage.where(~F.col(ok)).drop(ok)
    rest = _with_fallback(pending, ladder, tries, staging)
    rest = _with_errors(rest.withColumn("simplified", F.col("_fallback")), len(tries))
    return reduce(DataFrame.unionByName, [*done, rest.select(*out)])
