"""SARI, corpus scores and embedding F1 against brute force."""

import math
import random
import re

import plain
import pytest
from pyspark.sql import functions as F

from clearlines.functions import sari as sari_module
from clearlines.functions.sari import with_sari
from clearlines.operators import scores
from clearlines.operators.embedding_f1 import embedding_f1, mean_f1, vector_blocks


def random_pairs(seed=5, n=300):
    rng = random.Random(seed)
    word = ["the", "the", "of", "cat", "sat", "mat", "on", "3.5", "a.", "dog,", "x-1", "&amp;", "café"]
    text = lambda top: " ".join(rng.choice(word) for _ in range(rng.randint(0, top)))
    rows = [(i, text(25), text(25), text(25)) for i in range(n)]
    rows += [(n, "a b c d", "a b c d", "a b c d"), (n + 1, "a", "b", "c"), (n + 2, "", "", ""), (n + 3, "a a a b", "a b", "a b")]
    return rows


@pytest.mark.parametrize("few", [32, 1, 0])
@pytest.mark.parametrize("tokenizer", ["space", "13a"])
def test_sari(spark, monkeypatch, few, tokenizer):
    monkeypatch.setattr(sari_module, "FEW", few)
    df = spark.createDataFrame(random_pairs(), "id int, s string, c string, r string")
    tokens = {"tokens": plain.tokens_13a} if tokenizer == "13a" else {}
    for row in with_sari(df, "s", "c", "r", tokenizer=tokenizer).collect():
        assert tuple(row.sari) == pytest.approx(plain.sari(row.s, row.c, [row.r], **tokens)), row


def test_sari_with_several_references(spark):
    rows = random_pairs(9, 120)
    df = spark.createDataFrame([(s, c, [r, o[3]] if i % 3 else [r, o[3], c]) for (i, s, c, r), o in zip(rows, rows[1:])],
                               "s string, c string, refs array<string>")
    for row in with_sari(df, "s", "c", "refs", tokenizer="space").collect():
        assert tuple(row.sari) == pytest.approx(plain.sari(row.s, row.c, row.refs)), row


def test_perfect_prediction(spark):
    df = spark.createDataFrame([("a b c d e", "a b x", "a b x"), ("s", None, "r")], "s string, c string, r string")
    first, second = with_sari(df, "s", "c", "r").collect()
    assert tuple(first.sari) == (1.0, 1.0, 1.0, 1.0) and second.sari is None


def test_score_systems(spark):
    rows = [("A", "The big cat sat. It ran.", "The cat sat.", "A cat sat."), ("A", "One two three four", "one TWO three four", "One"),
            ("A", "left out", None, "x"), ("B", "Same here.", "same here.", "Same.")]
    df = spark.createDataFrame(rows, "system string, normal string, predicted string, simple string")
    got = {r.system: r for r in scores.score_systems(df).collect()}
    a = got["A"]
    assert (a.samples, a.incomplete, a.copy_count, a.copy_rate) == (2, 1, 1, 0.5)
    assert a.length_ratio == pytest.approx((3 / 6 + 4 / 4) / 2)
    wanted = [plain.sari(s, p, [r], plain.tokens_13a)[3] for x, s, p, r in rows[:2]]
    assert a.sari == pytest.approx(100 * sum(wanted) / 2)
    assert got["B"].copy_rate == 1.0
    table = scores.compare_systems(scores.metric_rows(scores.score_systems(df)), ["A", "B"])
    assert {r.metric: r.A for r in table.collect()}["samples"] == 2.0


@pytest.mark.parametrize("row, wanted", [
    ((0.5, 0.8, 5.0, 9.0, 0.9), "FAIL: copying"), ((0.4, 0.96, 5.0, 9.0, 0.9), "WARN"), ((0.1, 0.95, 9.0, 9.0, 0.9), "FAIL: not reducing"),
    ((0.1, 0.8, 5.0, 9.0, 0.84), "FAIL: losing"), ((0.4, 0.95, 5.0, 9.0, 0.85), "PASS"),
])
def test_verdict(spark, row, wanted):
    df = spark.createDataFrame([row], "c double, l double, p double, s double, f double")
    assert df.select(scores.verdict(*[F.col(c) for c in "clpsf"])).first()[0].startswith(wanted)


@pytest.mark.parametrize("block", [1, 3, 256])
def test_embedding_f1(spark, block):
    rng = random.Random(3)
    sizes = {0: (5, 7), 1: (1, 1), 2: (9, 4), 3: (3, 0)}
    rows = [(pair, side, pos, [rng.uniform(-1, 1) for _ in range(6)]) for pair, n in sizes.items()
            for side, k in zip(("predicted", "reference"), n) for pos in range(k)]
    df = spark.createDataFrame(rows, "pair_id long, side string, pos int, vec array<double>")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    for r in embedding_f1(vector_blocks(df, block), baseline=0.2).collect():
        p = [v for i, s, _, v in rows if i == r.pair_id and s == "predicted"]
        o = [v for i, s, _, v in rows if i == r.pair_id and s == "reference"]
        if not o:
            assert (r.precision, r.recall, r.f1) == (0, 0, 0)
            continue
        precision = sum(max(cosine(a, b) for b in o) for a in p) / len(p)
        recall = sum(max(cosine(a, b) for a in p) for b in o) / len(o)
        wanted = [(x - 0.2) / 0.8 for x in (precision, recall, 2 * precision * recall / (precision + recall))]
        assert [r.precision, r.recall, r.f1] == pytest.approx(wanted)


def test_embedding_f1_keeps_systems_and_sides_apart(spark):
    one, two = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, "A", "predicted", 0, one), (1, "B", "predicted", 0, two), (1, None, "reference", 0, one),
            (1, None, "source", 0, two), (1, None, "source", 1_000_000, one)]
    schema = "pair_id long, system string, side string, pos int, vec array<double>"
    blocks = vector_blocks(spark.createDataFrame(rows, schema), system="system")
    got = {r.system: (r.f1_reference, r.f1_source) for r in mean_f1(blocks).collect()}
    assert got == {"A": (1.0, pytest.approx(2 / 3)), "B": (0.0, pytest.approx(2 / 3))}
    with pytest.raises(Exception, match="unknown side"):
        vector_blocks(spark.createDataFrame([(1, "A", "elsewhere", 0, one)], schema))
    with pytest.raises(ValueError):
        embedding_f1(blocks, "predicted")


def test_sari_counts_a_batch_at_once(spark):
    """No lambda runs for a pair; pairs with missing texts and empty lists of references stand among the others."""
    rows = random_pairs(3, 200) * 3
    given = [(s, None if i % 17 == 0 else c, [] if i % 19 == 0 else [r, s]) for i, s, c, r in rows]
    df = with_sari(spark.createDataFrame(given, "s string, c string, refs array<string>").coalesce(1), "s", "c", "refs", tokenizer="space")
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()
    for row in df.collect():
        if row.c is None:
            assert row.sari is None
        elif row.refs:
            assert tuple(row.sari) == pytest.approx(plain.sari(row.s, row.c, row.refs)), row
        else:
            assert tuple(row.sari) == (1.0, 1.0, 1.0, 1.0)


def test_ready_counts_and_tokens_change_no_score(spark, folder):
    from clearlines.queries.data import COUNTS, TOKENS, systems_with_tokens

    made = systems_with_tokens(spark, folder).where("length(normal) < 300")
    plainly, ready = scores.score_systems(made), scores.score_systems(made, tokens=TOKENS, counts=COUNTS)
    rows = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(plainly) == rows(ready)
    # one exchange with Python: rows wait there, and where answers lag behind they wait on disk
    assert ready._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert all(kind == "string" for name, kind in made.dtypes if name in TOKENS)
    # the texts themselves are not among what waits
    plan = ready.select("sari")._jdf.queryExecution().optimizedPlan().toString()
    given = plan.split("ArrowEvalPython")[1].split("\n")[1].split("Project")[1]
    assert not re.search(r"[\[,] ?(normal|simple)#| AS predicted#", given), given


def test_texts_are_shuffled_only_where_files_hold_too_few_tasks(spark, folder, tmp_path):
    """A table of many files is read as it stands, one file or one large file among small ones is spread; the rows are the same."""
    import os

    from clearlines.queries import all_queries
    from clearlines.queries.data import documents, table

    docs, seen = table(spark, folder, "documents"), []
    for name in ("many", "uneven", "one"):
        path = f"{tmp_path}/{name}"
        if name == "many":
            docs.repartition(16).write.parquet(f"{path}/documents.parquet")
        else:
            docs.coalesce(1).write.parquet(f"{path}/documents.parquet")
        if name == "uneven":
            docs.limit(0).repartition(15, "doc_id").write.mode("append").parquet(f"{path}/documents.parquet")
            docs.limit(16).repartitionByRange(16, "doc_id").write.mode("append").parquet(f"{path}/documents.parquet")
        os.symlink(f"{folder}/embeddings.parquet", f"{path}/embeddings.parquet")
        usual = spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")
        try:
            plans = [documents(spark, path, by_key)._jdf.queryExecution().optimizedPlan().toString() for by_key in (False, True)]
            plans.append(all_queries()["metric_report"](spark, path)._jdf.queryExecution().optimizedPlan().toString())
            seen.append(["Repartition" in plan for plan in plans])
            assert documents(spark, path, False).count() == spark.read.parquet(f"{path}/documents.parquet").count()
        finally:
            spark.conf.set("spark.sql.files.openCostInBytes", usual)
    assert seen == [[False, True, False], [True, True, True], [True, True, True]]
