"""The ladder inside the row: the same answers, calls and errors as the ladder of written stages."""

import glob

import pytest
from pyspark.sql import functions as F

from clearlines import HEURISTIC, THREE, TWO, UNGATED, Generator, simplify
from clearlines.operators.row_ladder import simplify_in_row
from clearlines.queries.jobs import failing_model, near_model, shortening_model
from clearlines.streaming.documents import simplify_stream


@pytest.fixture(scope="module")
def docs(spark, folder):
    some = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60)
    awkward = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n"), (-4, "One here. Two there."), (-5, "No 5 here? " * 300),
                                     (-6, "Same thing. " * 50)], "doc_id long, text string")
    return some.unionByName(awkward).cache()


def rows(df):
    return sorted((r.doc_id, r.simplified, r.sentences, r.failed_calls) for r in df.select("doc_id", "simplified", "sentences", "failed_calls").collect())


@pytest.mark.parametrize("ladder, model", [(TWO, near_model), (TWO, failing_model), (THREE, near_model), (UNGATED, failing_model)])
def test_equals_written_stages(spark, docs, ladder, model):
    got = rows(simplify_in_row(docs, "text", Generator(model), ladder))
    want = rows(simplify(docs, generator=Generator(model), ladder=ladder))
    assert [r if r[1] is not None else r[:1] for r in got] == [r if r[1] is not None else r[:1] for r in want]
    assert len(got) == 66


def recording(folder, model):
    """``model``, which leaves the prompts of each call in a file."""
    def build():
        call = model()

        def ask(prompts, budgets):
            import json
            import uuid

            answers = call(prompts, budgets)
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                json.dump(list(zip(prompts, [int(b) for b in budgets])), file)
            return answers

        return ask

    return build


def asked(folder):
    import json

    found = []
    for path in glob.glob(f"{folder}/*"):
        with open(path) as file:
            found += [tuple(x) for x in json.load(file)]
    return sorted(found)


def test_asked_once_for_each_sentence_and_attempt(spark, docs, tmp_path):
    """In a stream of three micro-batches: the calls of the batch job, no written stage, no shuffle."""
    for name in ("in", "row", "stages"):
        (tmp_path / name).mkdir()
    docs.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    row, stages = (Generator(recording(str(tmp_path / name), shortening_model)) for name in ("row", "stages"))
    query = simplify_stream(stream, str(tmp_path / "out"), str(tmp_path / "state"), row, TWO, in_row=True)
    query.awaitTermination()
    assert "Exchange" not in query._jsq.explainInternal(False)
    assert len(query.recentProgress) >= 3
    want = simplify(spark.read.parquet(str(tmp_path / "in")), generator=stages, ladder=TWO)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(want)
    assert asked(tmp_path / "row") == asked(tmp_path / "stages") != []


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("a. B", "x", 7)], "text string, simplified string, sentence int")
    with pytest.raises(TypeError):
        simplify_in_row(df, "text", HEURISTIC)
    got = simplify_in_row(df, "text", Generator(shortening_model), UNGATED)
    assert got.columns == ["text", "sentence", "simplified", "sentences", "failed_calls"]
    assert got.select(F.col("sentences")).first()[0] == 2


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simplify_in_row(df, "text", Generator(shortening_model)).count() == 0
