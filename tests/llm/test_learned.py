"""Classifier and language by held-out accuracy; their parts against plain versions."""

import random
import zlib

import numpy as np
import pytest

from clearlines.llm import language, quality, queries


def rows_of(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet").collect()


@pytest.fixture(scope="module")
def bigger():
    return "/root/testdata/sf0.01"


def test_classifier_held_out(spark, bigger):
    labels = {r.doc_id: r.quality for r in rows_of(spark, bigger, "labels")}
    rows = queries.QUERIES["op3_quality_classifier"](spark, bigger).collect()
    assert len(rows) == len(rows_of(spark, bigger, "documents"))
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.93
    good = [r.score for r in held if labels[r.doc_id]]
    bad = [r.score for r in held if not labels[r.doc_id]]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_ftrl_step_by_step():
    model = quality.Ftrl(alpha=0.1, beta=1.0, l1=0.01, l2=0.1)
    z, n = {}, {}
    rng = random.Random(1)
    for _ in range(200):
        index = sorted(rng.sample(range(50), 5))
        value, label = [rng.random() for _ in index], rng.randint(0, 1)
        w = {}
        for i in index:
            zi = z.get(i, 0.0)
            w[i] = 0.0 if abs(zi) <= 0.01 else -(zi - np.sign(zi) * 0.01) / ((1 + n.get(i, 0.0) ** 0.5) / 0.1 + 0.1)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(index, value))))
        for i, v in zip(index, value):
            g = (p - label) * v
            s = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / 0.1
            z[i] = z.get(i, 0.0) + g - s * w[i]
            n[i] = n.get(i, 0.0) + g * g
        model.learn(np.array(index), np.array(value), label)
    assert all(abs(model.z[i] - z[i]) < 1e-9 and abs(model.n[i] - n[i]) < 1e-9 for i in z)


def test_features_are_unit_length():
    features = quality.Features()
    index, value = features.of("a b a b !! !!")
    assert index[0] == 0 and len(set(index.tolist())) == len(index) and abs((value[1:] ** 2).sum() - 1) < 1e-9
    assert features.of("")[0].tolist() == [0]
    assert set(features.of("x x")[0]) & set(features.of("y y")[0]) - {0}


def test_classifier_awkward(spark, make, awkward):
    labels = spark.createDataFrame([(1, 1, "x"), (2, 0, "x"), (4, 1, "x"), (4, 1, "x"), (6, None, "x"), (None, 1, "x"), (7, 5, "x"),
                                    (999, 0, "x")], "doc_id long, quality int, text string")
    weights = quality.fit(make(awkward), labels)
    scores = quality.score(make(awkward), weights).collect()
    assert len(scores) == len(awkward) and all(0 <= r.score <= 1 for r in scores)
    by = {r.doc_id: r.score for r in scores}
    assert by[1] == by[2]
    none = quality.fit(make([]), labels)
    assert not none.any() and quality.score(make([]), none).count() == 0
    assert {r.score for r in quality.score(make(awkward), none).collect()} == {0.5}


def test_language_held_out(spark, bigger):
    docs = {r.doc_id: r for r in rows_of(spark, bigger, "documents")}
    rows = queries.QUERIES["op9_language_id"](spark, bigger).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert r.lang_pred in {"en", "de", "fr", "es"}
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.97
    assert np.mean([r.rejected for r in held]) < 0.02


def test_language_awkward(make, awkward, spark):
    rows = [(i, f"the cat and the dog number {i} sat on the mat with the hat", "en", "s") for i in range(9)]
    rows += [(50 + i, f"der Hund und die Katze {i} sitzen auf der Matte mit dem Hut", "de", "s") for i in range(9)]
    rows += [(70, "no language here", None, "s"), (71, None, "xx", "s"), (72, "12 34", "yy", "s")]
    from pyspark.sql import functions as F
    learned = language.learn(make(rows), F.lit(True))
    assert sorted(learned) == ["de", "en"]
    found = {(r.doc_id, r.lang_pred) for r in language.identify(make(rows), learned).collect()}
    assert {(1, "en"), (52, "de"), (71, "und"), (72, "und")} <= found
    some = language.identify(make(awkward), learned).collect()
    assert len(some) == len(awkward)
    for r in some:
        assert (r.lang_pred == "und") <= r.rejected and (r.doc_id not in (1, 2, 3) or r.lang_pred == "und")
    assert {r.lang_pred for r in language.identify(make(rows), {}).collect()} == {"und"}
    assert language.identify(make([]), learned).count() == 0 and language.learn(make([]), F.lit(True)) == {}
    # equal sizes: the name that sorts first, no margin
    tie = language.identify(make(rows[:1]), {"b": b"zz", "a": b"zz"}).collect()[0]
    assert (tie.lang_pred, tie.score, tie.rejected) == ("a", 0.0, True)
