"""Similarity and gates against brute force."""

from dataclasses import replace

import plain
import pytest
from pyspark.sql import functions as F

from clearlines.functions.similarity import closed_ratio, is_copy, length_bound, similarity_ratio
from clearlines.operators.gate import LOOSE, STRICT, mostly_copy, simpler_surface, with_reason, with_verdict
from clearlines.queries import all_queries
from clearlines.queries.data import candidates, near_pairs, pairs


@pytest.fixture(scope="module")
def pairs_df(spark, folder):
    made = candidates(spark, folder).select("doc_id", "kind", "normal", "candidate").where("doc_id < 12 and length(normal) < 600").drop("doc_id").distinct()
    own = [("own", a, b) for a in plain.AWKWARD for b in plain.AWKWARD]
    return made.unionByName(spark.createDataFrame(own, "kind string, normal string, candidate string")).cache()


def test_known_ratios(spark):
    rows = [("the cat sat on the mat.", "the cat sat on a mat."), ("abc", "xyz"), ("", ""), ("tide", "diet"), ("diet", "tide"),
            ("a" * 300, "a" * 300), ("abc" * 100, "abc" * 100 + "d")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(similarity_ratio(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.909091, 0, 1, 0.25, 0.5, 1, 600 / 601], abs=1e-6)


def test_frequent_characters_are_skipped_only_if_asked(spark):
    """From 200 characters on ``difflib`` leaves out frequent ones by default: nothing of these matches then."""
    df = spark.createDataFrame([("ab" * 150, "z" + "ab" * 149)], "a string, b string")
    counted = similarity_ratio(F.col("a"), F.col("b"))
    skipped = similarity_ratio(F.col("a"), F.col("b"), skip_frequent=True)
    assert tuple(df.select(counted, skipped).first()) == pytest.approx((2 * 298 / 599, 0.0))


def test_near_copies_are_asked(spark):
    """Neither text holds the other, so the length rules leave these open."""
    df = near_pairs(spark, "/root/testdata/sf0.001")
    open_ = closed_ratio(F.col("normal"), F.col("near")).isNull() & (length_bound(F.col("normal"), F.col("near")) >= 0.9 - 0.05)
    assert df.where(open_).count() > 0.9 * df.count()


def test_ratio_is_exact_and_bounded(pairs_df):
    a, b = F.col("normal"), F.col("candidate")
    rows = pairs_df.select(a, b, similarity_ratio(a, b).alias("r"), length_bound(a, b).alias("bound"),
                           is_copy(a, b).alias("copied")).collect()
    for r in rows:
        wanted = plain.ratio(r.normal, r.candidate)
        assert r.r == wanted and r.r <= r.bound + 1e-12 and r.copied == (wanted > 0.95), r


@pytest.mark.parametrize("gate", [STRICT, LOOSE, replace(STRICT, reject_blank=True), replace(LOOSE, max_ratio=None)])
def test_gate(pairs_df, gate):
    df = with_reason(with_verdict(pairs_df, "normal", "candidate", gate), "normal", "candidate", gate)
    seen = set()
    for r in df.collect():
        wanted = plain.reason(r.normal, r.candidate, gate)
        assert r.reason == wanted and r.passed == (wanted == "ok"), r
        seen.add(wanted)
    assert {"ok", "same", "numbers", "missing", "added"} <= seen


def test_missing_candidate_fails(spark):
    df = spark.createDataFrame([("Some text here.", None)], "s string, c string")
    row = with_reason(with_verdict(df, "s", "c", STRICT), "s", "c", STRICT).first()
    assert row.passed is False and row.reason is None


def test_surface_and_copies(pairs_df):
    a, b = F.col("normal"), F.col("candidate")
    for r in pairs_df.select(a, b, simpler_surface(a, b).alias("s"), mostly_copy(a, b).alias("c")).collect():
        assert r.s == plain.simpler(r.normal, r.candidate), r
        assert r.c == plain.copied(r.normal, r.candidate), r


def test_queries_without_sql(spark, folder):
    """The registered queries that ``difflib`` keeps from having SQL, against brute force."""
    base = {(r.doc_id, r.pos): r for r in pairs(spark, folder).collect()}
    queries = all_queries()
    rates = {r.source: r.copy_rate for r in queries["copy_rate_simple"](spark, folder).collect()}
    for source in rates:
        if any(p.source == source and len(p.normal) > 1000 for p in base.values()):
            continue  # brute force would take too long
        flags = [plain.ratio(p.normal.lower(), p.simple.lower()) > 0.95 for p in base.values() if p.source == source]
        assert rates[source] == pytest.approx(sum(flags) / len(flags))
    texts = {(r.doc_id, r.pos, r.kind): r for r in candidates(spark, folder).collect()}
    for r in queries["faithful_kinds"](spark, folder).collect():
        given = texts[r.doc_id, r.pos, r.kind]
        if len(given.normal) < 120:
            assert r.passed == (plain.reason(given.normal, given.candidate, STRICT) == "ok"), given


def test_a_source_is_read_once_for_all_its_candidates(spark, folder):
    from clearlines.operators.gate import with_rules
    from clearlines.queries import data, gates

    made = with_rules(gates._candidates(spark, folder), "normal", "candidate", LOOSE, facts="facts")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    # above the explode the sentence itself is only compared as a whole
    assert "regexp_extract_all(lower(sentence" not in plan.split("Generate explode")[0] and "regexp_extract_all(lower(normal" not in plan
    alone = with_rules(data.candidates(spark, folder), "normal", "candidate", LOOSE)
    rows = lambda df: sorted(map(repr, df.select("doc_id", "pos", "kind", "rule").collect()))
    assert rows(made) == rows(alone)


def test_texts_are_compared_once_and_stay_behind(spark):
    """One comparison a row, for rows that pass the rules; only keys and what Python is asked pass the exchange with it."""
    rows = [(1, "The old harbour was busy.", None), (2, None, "The harbour."), (3, " The OLD harbour.", "the old harbour.\u2003"),
            (4, "The old harbour was busy.", "The harbour was busy 3."), (5, "The old harbour was busy at noon.", "The old harbor was busy at noon."),
            (6, "the old harbour was busy.", "the old harbour was busy today"), (7, "It is so.", " ")]
    df = spark.createDataFrame(rows, "id int, s string, c string")
    judged = with_verdict(df, "s", "c", STRICT)
    assert {r.id: r.passed for r in judged.collect()} == {
        r[0]: None not in r[1:] and plain.reason(r[1], r[2], STRICT) == "ok" for r in rows}
    for made in (judged.select("id", "passed"), with_reason(df, "s", "c", STRICT).select("id", "reason")):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Contains(") == 2  # each text in the other
        given = plan.split("ArrowEvalPython")[1].split("\n")[1]
        assert "_cheap" in given and "lower" not in given and " s#" not in given and " c#" not in given


def test_facts_that_no_rule_asks_are_not_looked_for(spark):
    from clearlines.operators.gate import with_facts

    rows = [("Some plain text 5.", "some plain TEXT 5. "), ("Some plain text 5.", "Plain text 7 and more."), ("It is 5.", "It holds nothing."),
            ("Some plain text 5, some.", "About plain words 5 5 words."), ("Some plain text.", "")]
    facts = [tuple(r[0]) for r in with_facts(spark.createDataFrame(rows, "s string, c string"), "s", "c", STRICT, "f").select("f").collect()]
    # same, terms, missing, added, numbers
    assert facts == [(True, 2, None, None, None), (False, 2, None, None, 1), (False, 0, None, None, 0), (False, 2, 1, 1, 0), (False, 2, 2, 0, 0)]
