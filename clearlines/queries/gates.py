"""Gates over candidates that break each rule."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from clearlines.operators.gate import (
    LOOSE, STRICT, mostly_copy, simpler_surface, source_facts, surface, with_facts, with_reason, with_rules, with_verdict,
)
from clearlines.operators.ladder import shortest_candidate
from clearlines.queries import sql
from clearlines.queries.data import candidates, near_pairs, pairs
from clearlines.queries.registry import query

KEYS = ["doc_id", "pos", "kind"]


def _candidates(spark, folder):
    """Candidates with the facts that the gates compare; a sentence's own are found once for all its candidates."""
    known = candidates(spark, folder, by_key=False, known=source_facts(F.col("normal"), STRICT))
    return with_facts(known, "normal", "candidate", STRICT, "facts", "known").drop("known")


def _rules_sql(loose: bool) -> str:
    return f"WITH {sql.CANDIDATES} SELECT doc_id, pos, kind, {sql.rule('normal', 'candidate', loose)} AS rule FROM candidates"


@query("faithful_rules", _rules_sql(False))
def faithful_rules(spark, folder):
    return with_rules(_candidates(spark, folder), "normal", "candidate", STRICT, facts="facts").select(*KEYS, "rule")


@query("faithful_rules_loose", _rules_sql(True))
def faithful_rules_loose(spark, folder):
    return with_rules(_candidates(spark, folder), "normal", "candidate", LOOSE, facts="facts").select(*KEYS, "rule")


def _clauses(spark, folder):
    return pairs(spark, folder).select("doc_id", "pos", "normal", "clause")


def _whole_sql(loose: bool) -> str:
    ratio = sql.bound("normal", "clause")
    return f"WITH {sql.PAIRS} SELECT doc_id, pos, {sql.rule('normal', 'clause', loose, ratio)} IS NULL AS passed FROM pairs"


@query("faithful_strict_whole", _whole_sql(False))
def faithful_strict_whole(spark, folder):
    """The whole strict gate on clauses, frequent characters counted."""
    return with_verdict(_clauses(spark, folder), "normal", "clause", STRICT).select("doc_id", "pos", "passed")


@query("faithful_loose_whole", _whole_sql(True))
def faithful_loose_whole(spark, folder):
    return with_verdict(_clauses(spark, folder), "normal", "clause", LOOSE).select("doc_id", "pos", "passed")


def _near_sql(loose: bool) -> str:
    ratio = sql.near_ratio("lower(normal)", "lower(near)")
    return f"WITH {sql.NEAR} SELECT doc_id, pos, {sql.rule('normal', 'near', loose, ratio)} IS NULL AS passed FROM near_pairs"


@query("faithful_strict", _near_sql(False))
def faithful_strict(spark, folder):
    """The whole strict gate on near copies, whose ratio ``difflib`` must work out."""
    return with_verdict(near_pairs(spark, folder), "normal", "near", STRICT).select("doc_id", "pos", "passed")


@query("faithful_loose", _near_sql(True))
def faithful_loose(spark, folder):
    return with_verdict(near_pairs(spark, folder), "normal", "near", LOOSE).select("doc_id", "pos", "passed")


@query("faithful_kinds")
def faithful_kinds(spark, folder):
    """The whole strict gate on all kinds of candidates; some ratios have no SQL form."""
    judged = with_verdict(_candidates(spark, folder), "normal", "candidate", STRICT, facts="facts")
    return judged.select("doc_id", "pos", "kind", "passed")


@query("gate_reasons", f"""WITH {sql.CANDIDATES}, judged AS (
  SELECT kind, 'strict' AS gate, coalesce({sql.rule('normal', 'candidate', False)}, 'ok') AS reason FROM candidates
  UNION ALL SELECT kind, 'loose', coalesce({sql.rule('normal', 'candidate', True)}, 'ok') FROM candidates)
SELECT kind, gate, reason, count(*) AS sentences FROM judged GROUP BY kind, gate, reason""")
def gate_reasons(spark, folder):
    """Reasons of both gates without the similarity rule."""
    df = _candidates(spark, folder)
    for name, gate in (("strict", STRICT), ("loose", LOOSE)):
        df = with_reason(df, "normal", "candidate", replace(gate, max_ratio=None), into=name, facts="facts")
    both = df.unpivot(["kind"], ["strict", "loose"], "gate", "reason")
    return both.groupBy("kind", "gate", "reason").agg(F.count(F.lit(1)).alias("sentences"))


@query("gate_reasons_whole", f"""WITH {sql.PAIRS}, judged AS (
  SELECT source, coalesce({sql.rule('normal', 'clause', False, sql.bound('normal', 'clause'))}, 'ok') AS reason FROM pairs)
SELECT source, reason, count(*) AS sentences FROM judged GROUP BY source, reason""")
def gate_reasons_whole(spark, folder):
    """Reasons of the strict gate on clauses, similarity included, per document source."""
    judged = with_reason(pairs(spark, folder), "normal", "clause", STRICT)
    return judged.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("sentences"))


@query("simpler_surface", f"WITH {sql.CANDIDATES} SELECT doc_id, pos, kind, {sql.simpler('normal', 'candidate')} AS simpler FROM candidates")
def simpler(spark, folder):
    df = candidates(spark, folder, known=surface(F.col("normal")))
    return df.select(*KEYS, simpler_surface(F.col("normal"), F.col("candidate"), F.col("known")).alias("simpler"))


@query("mostly_copy", f"""WITH {sql.PAIRS} SELECT doc_id, pos, {sql.strip('clause')} = '' OR {sql.strip('lower(clause)')} = {sql.strip('lower(normal)')}
  OR {sql.bound('normal', 'clause')} >= 0.985::DOUBLE AS copied FROM pairs""")
def copies(spark, folder):
    copied = mostly_copy(F.col("normal"), F.col("clause"))
    return _clauses(spark, folder).select("doc_id", "pos", copied.alias("copied"))


@query("shortest_candidate", f"""WITH {sql.CANDIDATES} SELECT doc_id, pos, arg_min(candidate, length(candidate) * 1000 + ascii(kind)) AS candidate
FROM candidates WHERE kind <> 'blank' GROUP BY doc_id, pos""")
def shortest(spark, folder):
    tried = candidates(spark, folder).where(F.col("kind") != "blank").withColumn("attempt", F.ascii("kind"))
    best = shortest_candidate(tried, ["doc_id", "pos"], "attempt", "candidate")
    return best.select("doc_id", "pos", "candidate")
