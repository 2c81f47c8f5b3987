"""Every stage over its predecessor's rows, against its decisions worked out one document at a time."""

import sys

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from clearlines.llm import language, neardup, quality, secrets
from clearlines.llm.common import staged

from test_tokens import check_pieces


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    tables = [docs]
    for name, stage in pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), "test")
        tables.append(docs)
    return tables


def texts(table):
    return {r.doc_id: r.text for r in table.collect()}


def test_names():
    assert [n.split()[0] for n, _ in pipeline.STAGES] == ["quality", "language", "minhash", "secret", "packing"]


def test_stages(spark, folder, stages):
    assert all(t.columns == pipeline.COLUMNS for t in stages[:-1])
    before, after = texts(stages[0]), texts(stages[1])
    labels = spark.read.parquet(f"{folder}/labels.parquet").where(~quality.held_out("doc_id", 4, 2))
    weights, features = quality.fit(stages[0], labels), quality.Features()
    for key, text in before.items():
        index, value = features.of(text or "")
        assert (key in after) == (1 / (1 + np.exp(-(weights[index] @ value))) >= quality.GOOD)
    before, after = after, texts(stages[2])
    sizes = language.Sizes(language.learn(stages[1], ~quality.held_out("doc_id", 3, 1)))
    for key, text in before.items():
        name, margin = sizes.judge(text)
        assert (key in after) == (name != "und" and margin >= language.MARGIN)
    before, after = after, texts(stages[3])
    assert set(after) <= set(before) and len(set(after.values())) == len(after)
    assert set(after.values()) <= set(before.values())
    cleaned = texts(stages[4])
    scanner = secrets.Scanner()
    assert cleaned == {k: secrets.redact(t, scanner.spans(t)) for k, t in after.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = [(k, library.encode(t, add_special_tokens=False).ids + [0]) for k, t in cleaned.items()]
    check_pieces(stages[5].collect(), wanted, 1024)


def test_quality_keeps_clean_documents(spark, folder, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1").collect()}
    kept = set(texts(stages[1]))
    assert len(good & kept) >= 0.97 * len(good)


def test_stages_without_rows(spark, folder, make):
    for name, stage in pipeline.STAGES:
        assert stage(spark, make([]).select(*pipeline.COLUMNS), folder).count() == 0, name


def test_awkward_rows(spark, folder, make, awkward):
    docs = make(awkward)
    for name, stage in pipeline.STAGES[:-1]:
        found = stage(spark, docs, folder)
        assert found.columns == pipeline.COLUMNS and found.count() <= len(awkward), name
    kept = neardup.without_copies(docs).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted((k or 0, t or "") for k, t in awkward)
    assert sys.modules["corpus_pipeline"].ORACLE_SQL is None
