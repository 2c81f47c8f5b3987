"""Answers by content: calls are counted."""

import pytest

from clearlines import TWO, Generator
from clearlines.operators.answers import Answers
from clearlines.operators.ladder import run_ladder
from clearlines.queries.jobs import failing_model, shortening_model

from test_row_ladder import asked, recording

#: The first fails the gate at its first attempt, as nothing is cut; the others pass.
SENTENCES = ["Nothing is cut from these words at all.", "The committee had reached a decision, which took them very long indeed.",
             "Several departments published reports, although nobody had asked for them."]


def ladder(spark, df, model, answers):
    done = run_ladder(df, ["doc_id", "pos"], Generator(model), TWO, partitions=2, answers=answers)
    return sorted((r.doc_id, r.pos, r.simplified, r.failed_calls) for r in done.collect())


def dying(model):
    """``model``, whose process ends at a second attempt."""
    def build():
        call = model()

        def ask(prompts, budgets):
            import os

            if any("easier words" in p or "aggressively" in p for p in prompts):
                os._exit(1)
            return call(prompts, budgets)

        return ask

    return build


def test_killed_job_goes_on(spark, tmp_path):
    """Repeated sentences are asked once; after a crash in attempt 2, attempt 1 is not asked again; nor is a later run."""
    (tmp_path / "calls").mkdir()
    df = spark.createDataFrame([(d, p, s) for d in range(20) for p, s in enumerate(SENTENCES)], "doc_id long, pos int, sentence string")
    model, store = recording(str(tmp_path / "calls"), shortening_model), str(tmp_path / "answers")
    with pytest.raises(Exception):
        ladder(spark, df, dying(model), Answers(store, "m"))
    first = asked(tmp_path / "calls")
    assert len(first) == len(SENTENCES)
    got = ladder(spark, df, model, Answers(store, "m"))
    every = asked(tmp_path / "calls")
    assert len(set(every)) == len(every) == len(SENTENCES) + 1
    assert got == ladder(spark, df, model, Answers(store, "m")) == ladder(spark, df, shortening_model, None)
    assert asked(tmp_path / "calls") == every
    ladder(spark, df, model, Answers(store, "another"))
    assert len(asked(tmp_path / "calls")) == 2 * len(every)


def test_failed_calls_count_and_are_asked_again(spark, tmp_path):
    df = spark.createDataFrame([(d, 0, "x" * 11 + " yy" * 11) for d in range(5)], "doc_id long, pos int, sentence string")
    answers = Answers(str(tmp_path / "answers"), "m")
    got = ladder(spark, df, failing_model, answers)
    assert got == ladder(spark, df, failing_model, None) and all(r[3] == 2 for r in got)
    assert ladder(spark, df, failing_model, Answers(answers.folder, "m")) == got
    assert answers.read(spark).count() == 4  # two attempts in each of two runs
    assert all(r[3] < 2 for r in ladder(spark, df, shortening_model, Answers(answers.folder, "m")))
