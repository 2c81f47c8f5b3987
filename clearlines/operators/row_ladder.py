"""The attempt ladder inside the row: a document stays one row, its sentences are arrays.

Nothing is written between attempts and nothing is shuffled, so a ladder fits into one streaming plan. Each attempt
is one Arrow call over arrays of prompts; sentences that have passed are NULL there and are not asked again. Models
are asked once for a sentence and attempt as long as the plan runs once: read a result twice from what was written.
A very long document is the work of one task; :func:`clearlines.plans.simplify.simplify` spreads its sentences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.prompts import build_prompt, generation_budget
from clearlines.functions.similarity import with_reaches_each
from clearlines.functions.terms import extract_numbers, key_terms
from clearlines.functions.text import clean_sentence, normalise, split_sentences, strip
from clearlines.operators.documents import of_one
from clearlines.operators.gate import GateConfig, early_reason, fact_sizes, late_reason, simpler_surface
from clearlines.operators.generate import HEURISTIC, Generator, row_batch_udf
from clearlines.operators.ladder import TWO, Ladder, shortest

_NAMES = ("sentence", "done", "fine", "close", "a", "b", "terms", "facts", "prompts", "budgets", "answers", "failed", "rest")
_SENTENCE, _DONE, _FINE, _CLOSE, _A, _B, _TERMS, _FACTS, _PROMPTS, _BUDGETS, _ANSWERS, _FAILED, _REST = (f"_row_{n}" for n in _NAMES)


def _each(make: Callable[..., Column], *names: str) -> Column:
    """``make`` over the elements of array columns of one length, side by side."""
    return F.transform(F.arrays_zip(*[F.col(n) for n in names]), lambda x: make(*[x[n] for n in names]))


def _ask(df: DataFrame, generator: Generator, ladder: Ladder, number: int, into: str) -> DataFrame:
    """Add the decoded answers to the sentences that are not done, and count failed calls."""
    attempt = ladder.attempts[number - 1]
    by_size = lambda s: generation_budget(F.size(ladder.tokens(s)), ladder.max_length, ladder.min_budget, ladder.max_budget)
    budget = by_size if attempt.budget is None else lambda s: F.lit(attempt.budget)
    df = df.withColumns({
        _PROMPTS: _each(lambda s, done: F.when(done.isNull(), build_prompt(s, attempt.template)), _SENTENCE, _DONE),
        _BUDGETS: _each(lambda s, done: F.when(done.isNull(), budget(s)), _SENTENCE, _DONE)})
    df = df.withColumn(_ANSWERS, row_batch_udf(generator)(F.col(_PROMPTS), F.col(_BUDGETS)))
    failed = F.size(F.filter(F.col(_ANSWERS)["errors"], lambda e: e.isNotNull())).cast("bigint")
    return df.withColumns({into: F.transform(F.col(_ANSWERS)["texts"], lambda t: ladder.decode(t)), _FAILED: F.col(_FAILED) + failed})


def _stepwise(df: DataFrame, name: str, steps: tuple[Callable[[Column], Column], ...]) -> DataFrame:
    """Apply steps to the elements of an array one by one: each may mention its input more than once."""
    made = F.col(name)
    for step in steps:
        made = F.transform(made, of_one(step))
    return df.withColumn(name, made)


def _judge(df: DataFrame, name: str, gate: GateConfig) -> DataFrame:
    """Add, per sentence, whether its new candidate passes the gate."""
    def terms(s: Column, c: Column) -> Column:
        return F.struct(key_terms(s, gate.stop_words).alias("old"), key_terms(c, gate.stop_words).alias("new"),
                        extract_numbers(s).alias("old_numbers"), extract_numbers(c).alias("new_numbers"))

    df = df.withColumn(_TERMS, _each(lambda s, c: F.when(c.isNotNull() & early_reason(s, c, gate).isNull(), terms(s, c)),
                                     _SENTENCE, name))
    df = df.withColumn(_FACTS, F.transform(_TERMS, lambda t: F.when(
        t.isNotNull(), fact_sizes(t["old"], t["new"], t["old_numbers"], t["new_numbers"]))))
    df = df.withColumn(_FINE, F.transform(_FACTS, lambda f: f.isNotNull() & late_reason(f, gate).isNull()))
    if gate.max_ratio is None:
        return df
    df = _near(df, name, _FINE, gate.max_ratio, gate.skip_frequent)
    return df.withColumn(_FINE, _each(lambda fine, close: fine & ~F.coalesce(close, F.lit(False)), _FINE, _CLOSE))


def _near(df: DataFrame, name: str, where: str, threshold: float, skip_frequent: bool) -> DataFrame:
    """Add whether candidates reach a similarity to their sentences, for those that ``where`` names."""
    df = df.withColumns({_A: _each(lambda s, w: F.when(w, F.lower(s)), _SENTENCE, where),
                         _B: _each(lambda c, w: F.when(w, F.lower(c)), name, where)})
    return with_reaches_each(df, _A, _B, threshold, _CLOSE, skip_frequent=skip_frequent)


def _fallback(df: DataFrame, ladder: Ladder, tries: list[str]) -> DataFrame:
    """Add what each sentence becomes when no attempt passed."""
    if ladder.fallback == "source":
        def rest(s, done, first, *more):
            cleaned = clean_sentence(first, ladder.collapse)
            return F.when(done.isNull(), F.when(cleaned != "", cleaned).otherwise(clean_sentence(s, ladder.collapse)))
        return df.withColumn(_REST, _each(rest, _SENTENCE, _DONE, *tries))
    if ladder.fallback == "shorter":
        def rest(s, done, *made):
            return F.when(done.isNull(), F.coalesce(clean_sentence(shortest(list(made)), ladder.collapse),
                                                    clean_sentence(s, ladder.collapse)))
        return df.withColumn(_REST, _each(rest, _SENTENCE, _DONE, *tries))
    skip_frequent = ladder.gate is not None and ladder.gate.skip_frequent
    for name in tries:
        clean, worth = f"{name}_clean", f"{name}_worth"
        df = df.withColumn(clean, _each(lambda done, c: F.when(done.isNull(), clean_sentence(c, ladder.collapse)), _DONE, name))
        df = df.withColumn(worth, _each(lambda s, c: F.coalesce(
            (strip(c) != "") & (normalise(c) != normalise(s)) & simpler_surface(s, c), F.lit(False)), _SENTENCE, clean))
        df = _near(df, clean, worth, fixed.MOSTLY_COPY_RATIO, skip_frequent)
        df = df.withColumn(clean, _each(lambda c, w, close: F.when(w & ~F.coalesce(close, F.lit(False)), c), clean, worth, _CLOSE))
    df = df.withColumn(_REST, _each(lambda *usable: shortest(list(usable)), *[f"{n}_clean" for n in tries]))
    df = df.withColumn(_A, _each(lambda s, done, rest: F.when(done.isNull() & rest.isNull(), s), _SENTENCE, _DONE, _REST))
    return _stepwise(df, _A, HEURISTIC.steps).withColumn(_REST, F.zip_with(_REST, _A, lambda rest, by_rule: F.coalesce(rest, by_rule)))


def simplify_in_row(df: DataFrame, text: str, generator: Generator, ladder: Ladder = TWO) -> DataFrame:
    """Add ``simplified``, ``sentences`` and ``failed_calls``, as :func:`clearlines.plans.simplify.simplify` does, without
    a key, a written stage or a shuffle: for streams, and for tables whose documents are short. For models only: the
    optimizer would put the attempts of a rule into one expression (a rule alone is ``simplify_by_rule``).

    A NULL text and one without a sentence stay as they are. Columns named ``_row_...`` are for use in here.
    """
    if not isinstance(generator, Generator):
        raise TypeError("a ladder inside the row asks a model; use simplify or simplify_by_rule for a rule")
    out = [F.col(c) for c in df.columns if c not in ("simplified", "sentences", "failed_calls")]
    none = F.array().cast("array<string>")
    df = df.withColumns({_SENTENCE: F.coalesce(split_sentences(F.col(text)), none), _FAILED: F.lit(0).cast("bigint")})
    df = df.withColumn(_DONE, F.transform(_SENTENCE, lambda s: F.lit(None).cast("string")))
    tries = []
    for number in range(1, len(ladder.attempts) + 1):
        tries.append(f"_row_try_{number}")
        df = _ask(df, generator, ladder, number, tries[-1])
        if ladder.gate is None:
            break
        df = _judge(df, tries[-1], ladder.gate)
        df = df.withColumn(_DONE, _each(lambda done, c, fine: F.when(fine, clean_sentence(c, ladder.collapse)).otherwise(done),
                                        _DONE, tries[-1], _FINE))
    df = _fallback(df, ladder, tries)
    joined = F.array_join(F.zip_with(_DONE, _REST, lambda done, rest: F.coalesce(done, rest)), " ")
    return df.select(*out, F.when(F.size(_SENTENCE) == 0, F.col(text)).otherwise(joined).alias("simplified"),
                     F.size(_SENTENCE).cast("bigint").alias("sentences"), F.col(_FAILED).alias("failed_calls"))
