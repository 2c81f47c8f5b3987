"""The model stage: a user-supplied batch callable, or a rule that stays in Spark.

A *factory* builds the callable on the worker (that is where models are loaded); the
callable takes a list of prompts and a list of token budgets and returns one text per
prompt. It is loaded once per Python worker and fed real batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clearlines import fixed
from clearlines.functions.rewrite import first_clause, lexicon_replace
from clearlines.functions.text import capitalise, close_sentence

BatchCall = Callable[[list[str], list[int]], list[str]]


@dataclass(frozen=True)
class Generator:
    """A batch model: ``factory()`` is called on the worker and returns the callable.

    A prompt that fails by itself is asked ``retries`` times more, after ``wait`` seconds, twice as many each time.
    """

    factory: Callable[[], BatchCall]
    retries: int = 0
    wait: float = 0.0


@dataclass(frozen=True)
class Rule:
    """A generator made of column functions, applied one after the other.

    Steps are kept apart so that, inside an array, each runs once per sentence: a step may
    mention its input more than once, and expressions are not shared there.
    """

    steps: tuple[Callable[[Column], Column], ...]

    def __call__(self, sentence: Column) -> Column:
        for step in self.steps:
            sentence = step(sentence)
        return sentence


def heuristic(lexicon: Mapping[str, str] = fixed.LEXICON) -> Rule:
    """The rule-based simplifier with a lexicon of one's own."""
    return Rule((lambda s: first_clause(lexicon_replace(s, lexicon)), close_sentence, capitalise))


HEURISTIC = heuristic()
IDENTITY = Rule(())


def safe_asker(factory: Callable, retries: int = 0, wait: float = 0.0) -> Callable[[], Callable]:
    """What a task calls to get its function (prompts, arguments) -> [(text, error)]; a worker loads a model once.

    A failing batch is halved until the bad prompts stand alone: ``k`` of them in ``n`` cost about ``2 k log2(n)`` calls, and
    only their own answers, which are NULL.
    """
    token = hashlib.sha256(cloudpickle.dumps(factory)).hexdigest()

    def make():
        import sys
        import time
        import types

        loaded = sys.modules.setdefault("_loaded_generators", types.ModuleType("_loaded_generators")).__dict__
        if token not in loaded:
            loaded[token] = factory()
        call = loaded[token]

        def ask(prompts, arguments):
            answers = list(call(prompts, arguments))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return [(a, None) for a in answers]

        def ask_safely(prompts, arguments):
            try:
                return ask(prompts, arguments)
            except Exception as problem:
                if len(prompts) > 1:
                    half = len(prompts) // 2
                    return ask_safely(prompts[:half], arguments[:half]) + ask_safely(prompts[half:], arguments[half:])
                for again in range(retries):
                    time.sleep(wait * 2 ** again)
                    try:
                        return ask(prompts, arguments)
                    except Exception as later:
                        problem = later
                return [(None, f"{type(problem).__name__}: {problem}")]

        return ask_safely

    return make


def _pieces(prompts: pa.Array, most: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and number of neighbouring prompts, at most ``most`` and (but for a single one) ``size`` bytes at a time."""
    import pyarrow.compute as pc

    start = held = 0
    for at, length in enumerate(pc.fill_null(pc.binary_length(prompts), 0).to_pylist()):
        if at > start and (at - start == most or held + length > size):
            yield start, at - start
            start, held = at, 0
        held += length
    if len(prompts) > start:
        yield start, len(prompts) - start


def batch_udf(factory: Callable, schema: str = "text string, error string", retries: int = 0, wait: float = 0.0,
              most: int = 1024, size: int = 4 << 20):
    """Arrow UDF (prompt, argument) -> (text, error) around a batch callable, that asks as :func:`safe_asker` says.

    Prompts are asked ``most`` at a time, fewer where they are long: only theirs are Python objects, not those of a whole
    Arrow batch. The package's functions travel by value: workers need not have it.
    """
    asker = safe_asker(factory, retries, wait)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import pyarrow as pa

        ask_safely = asker()
        for prompts, arguments in batches:
            for at, n in _pieces(prompts, most, size):
                asked, told = prompts.slice(at, n).to_pylist(), arguments.slice(at, n).to_pylist()
                here = [i for i, prompt in enumerate(asked) if prompt is not None]
                answers = [(None, None)] * n
                if here:
                    for i, answer in zip(here, ask_safely([asked[i] for i in here], [told[i] for i in here])):
                        answers[i] = answer
                columns = [pa.array(column, pa.string(), from_pandas=True) for column in zip(*answers)]
                yield pa.StructArray.from_arrays(columns, ["text", "error"])

    # a model call must neither be repeated nor moved by the optimizer
    return F.arrow_udf(run, schema).asNondeterministic()


def row_batch_udf(generator: Generator, most: int = 1024):
    """Arrow UDF (prompts, budgets) -> (texts, errors) on arrays: NULL prompts are not asked.

    The prompts of a batch of rows are asked together, ``most`` at a time.
    """
    asker = safe_asker(generator.factory, generator.retries, generator.wait)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        ask_safely = asker()
        for prompts, budgets in batches:
            texts, errors = [[None] * len(p) for p in prompts], [[None] * len(p) for p in prompts]
            places = [(row, i) for row, p in enumerate(prompts) for i, prompt in enumerate(p) if prompt is not None]
            for at in range(0, len(places), most):
                part = places[at:at + most]
                got = ask_safely([prompts.iloc[r][i] for r, i in part], [int(budgets.iloc[r][i]) for r, i in part])
                for (row, i), (text, error) in zip(part, got):
                    texts[row][i], errors[row][i] = text, error
            yield pd.DataFrame({"texts": texts, "errors": errors}, index=prompts.index)

    return F.pandas_udf(run, "texts array<string>, errors array<string>").asNondeterministic()


def generate(df: DataFrame, generator: Generator, prompt: Column, budget: Column,
             into: str = "raw", error: str = "error") -> DataFrame:
    """Add the model's raw text and, where the call failed, its error message.

    Only prompt and budget travel to Python; the other columns stay in the JVM.
    """
    df = df.withColumn("_answer", batch_udf(generator.factory, retries=generator.retries, wait=generator.wait)(prompt, budget))
    return df.withColumn(into, F.col("_answer.text")).withColumn(error, F.col("_answer.error")).drop("_answer")
