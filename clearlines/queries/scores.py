"""Corpus scores of derived systems, and embedding F1 of derived token vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearlines.functions.sari import with_sari
from clearlines.operators import scores
from clearlines.operators.embedding_f1 import embedding_f1, mean_f1, vector_blocks
from clearlines.plans.staging import Staging
from clearlines.queries import sql
from clearlines.queries.data import COUNTS, TOKENS, near_pairs, pairs, systems, systems_with_tokens, table
from clearlines.queries.registry import query
from clearlines.sources import pairs as sources


@query("length_ratio", f"""WITH {sql.SYSTEMS} SELECT source, system, count(*) AS sentences,
  round(avg({sql.length_ratio('normal', 'predicted')}), 6) AS length_ratio FROM systems GROUP BY source, system""")
def length_ratio(spark, folder):
    ratio = scores.length_ratio(F.col("normal"), F.col("predicted"))
    return systems(spark, folder).groupBy("source", "system").agg(
        F.count(F.lit(1)).alias("sentences"), F.round(F.avg(ratio), 6).alias("length_ratio"))


@query("copy_rate_exact", f"""WITH {sql.SYSTEMS} SELECT source, system,
  round(avg(CASE WHEN lower(normal) = lower(predicted) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS copy_rate
  FROM systems GROUP BY source, system""")
def copy_rate_exact(spark, folder):
    same = (F.lower("normal") == F.lower("predicted")).cast("double")
    return systems(spark, folder).groupBy("source", "system").agg(F.round(F.avg(same), 6).alias("copy_rate"))


@query("copy_rate_whole", f"""WITH {sql.SYSTEMS} SELECT source, system,
  count(*) FILTER ({sql.bound('normal', 'predicted')} > 0.95::DOUBLE) AS copies,
  round(avg(CASE WHEN {sql.bound('normal', 'predicted')} > 0.95::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS copy_rate
  FROM systems GROUP BY source, system""")
def copy_rate_whole(spark, folder):
    """Copy rate with frequent characters counted (each prediction is part of its source)."""
    marked = scores.with_copy(systems(spark, folder))
    return marked.groupBy("source", "system").agg(
        F.count(F.when(F.col("copied"), 1)).alias("copies"),
        F.round(F.avg(F.col("copied").cast("double")), 6).alias("copy_rate"))


@query("copy_rate", f"""WITH {sql.NEAR} SELECT source, count(*) AS sentences,
  count(*) FILTER ({sql.near_ratio('lower(normal)', 'lower(near)')} > 0.95::DOUBLE) AS copies FROM near_pairs GROUP BY source""")
def copy_rate(spark, folder):
    """Copies among near copies, whose ratio ``difflib`` must work out."""
    marked = scores.with_copy(near_pairs(spark, folder), prediction="near")
    return marked.groupBy("source").agg(F.count(F.lit(1)).alias("sentences"), F.count(F.when(F.col("copied"), 1)).alias("copies"))


@query("copy_rate_simple")
def copy_rate_simple(spark, folder):
    """Copy rate of the short-word version; its ratio has no SQL form."""
    marked = scores.with_copy(pairs(spark, folder), prediction="simple")
    return marked.groupBy("source").agg(F.avg(F.col("copied").cast("double")).alias("copy_rate"))


_PAIRS_AS_SYSTEM = f"{sql.PAIRS}, scored AS (SELECT doc_id, pos, source, normal, clause AS predicted, simple FROM pairs)"


@query("sari_components", f"""WITH {_PAIRS_AS_SYSTEM}, {sql.sari('scored', 'doc_id, pos', sql.tokens_space)}
SELECT doc_id, pos, round(keep, 9) AS keep, round(del, 9) AS delete, round(add_f1, 9) AS add, round(score, 9) AS score FROM sari""")
def sari_components(spark, folder):
    scored = with_sari(pairs(spark, folder), "normal", "clause", "simple", tokenizer="space")
    return scored.select("doc_id", "pos", *[F.round(F.col(f"sari.{c}"), 9).alias(c) for c in ("keep", "delete", "add", "score")])


@query("sari", f"""WITH {sql.SYSTEMS}, {sql.sari('systems', 'source, system, doc_id, pos', sql.tokens_13a)}
SELECT source, system, count(*) AS sentences, round(avg(score) * 100, 6) AS sari FROM sari GROUP BY source, system""")
def sari(spark, folder):
    scored = with_sari(systems_with_tokens(spark, folder), "normal", "predicted", "simple", tokens=TOKENS)
    return scored.groupBy("source", "system").agg(
        F.count(F.lit(1)).alias("sentences"), F.round(F.avg("sari.score") * 100, 6).alias("sari"))


def _report_sql(systems_sql: str, relation: str, copy: str, f1: bool) -> str:
    """CTEs that end in ``report`` (a row per system) and ``metrics`` (a row per system and metric)."""
    names = scores.METRICS + (scores.F1_METRICS if f1 else ())
    meaning = f", {_VECTORS_SQL}" if f1 else ""
    both = ", f1_reference, f1_source" if f1 else ""
    return f"""WITH {systems_sql}{meaning}, {sql.sari(relation, 'system, doc_id, pos', sql.tokens_13a)},
basic AS (SELECT system, count(*)::DOUBLE AS samples,
  (count(*) FILTER ({copy} > 0.95::DOUBLE))::DOUBLE AS copy_count,
  avg(CASE WHEN {copy} > 0.95::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS copy_rate,
  avg({sql.length_ratio('normal', 'predicted')}) AS length_ratio,
  avg({sql.fkgl('normal')}) AS source_fkgl, avg({sql.fkgl('predicted')}) AS predicted_fkgl,
  avg({sql.fre('normal')}) AS source_fre, avg({sql.fre('predicted')}) AS predicted_fre FROM {relation} GROUP BY system),
report AS (SELECT basic.*, s.sari{both} FROM basic JOIN (SELECT system, avg(score) * 100 AS sari FROM sari GROUP BY system) s USING (system)
  {'LEFT JOIN meaning USING (system)' if f1 else ''}),
metrics AS (""" + " UNION ALL ".join(
        f"SELECT system, '{m}' AS metric, round({m}, 6) AS value FROM report" for m in names) + ")"


# Token vectors, in groups of 8: the predictions of two systems, then the reference and the source of a pair.
_VECTORS_SQL = """vectors AS (SELECT vec_id // 32 AS pair_id, (vec_id // 8) % 4 AS role, vec_id % 8 AS pos,
  embedding::DOUBLE[] AS vec FROM embeddings),
f1_sides(role, system) AS (VALUES (0, 'clause'), (1, 'same')), f1_others(other, side) AS (VALUES (2, 'reference'), (3, 'source')),
texts AS (SELECT DISTINCT pair_id, role FROM vectors),
asked AS (SELECT pair_id, role, other, system, side FROM texts JOIN f1_sides USING (role), f1_others),
best AS (SELECT q.pair_id, q.system, q.side, TRUE AS p, a.pos, max(list_cosine_similarity(a.vec, b.vec)) AS value
  FROM asked q JOIN vectors a USING (pair_id, role) JOIN vectors b ON b.pair_id = q.pair_id AND b.role = q.other GROUP BY ALL
  UNION ALL SELECT q.pair_id, q.system, q.side, FALSE, b.pos, max(list_cosine_similarity(a.vec, b.vec))
  FROM asked q JOIN vectors a USING (pair_id, role) JOIN vectors b ON b.pair_id = q.pair_id AND b.role = q.other GROUP BY ALL),
means AS (SELECT pair_id, system, side, avg(value) FILTER (p) AS precision, avg(value) FILTER (NOT p) AS recall
  FROM best GROUP BY pair_id, system, side),
f1 AS (SELECT q.pair_id, q.system, q.side, coalesce((precision - 0.1) / 0.9, 0) AS precision, coalesce((recall - 0.1) / 0.9, 0) AS recall,
  coalesce((2 * precision * recall / (precision + recall) - 0.1) / 0.9, 0) AS f1 FROM asked q LEFT JOIN means USING (pair_id, system, side)),
meaning AS (SELECT system, avg(f1) FILTER (side = 'reference') AS f1_reference, avg(f1) FILTER (side = 'source') AS f1_source
  FROM f1 GROUP BY system)"""
_REPORT_SQL = _report_sql(sql.SYSTEMS, "systems", sql.bound("normal", "predicted"), True)


def token_blocks(spark, folder, block):
    """(pair, system, side, block, vecs) from the embeddings."""
    at = F.col("vec_id")
    role = F.floor(at / 8) % 4
    rows = table(spark, folder, "embeddings").select(
        F.floor(at / 32).alias("pair_id"), F.when(role == 0, "clause").when(role == 1, "same").alias("system"),
        F.when(role < 2, "predicted").when(role == 2, "reference").otherwise("source").alias("side"),
        (at % 8).alias("pos"), F.col("embedding").alias("vec"))
    return vector_blocks(rows, block, system="system")


def _report(spark, folder):
    meaning = mean_f1(token_blocks(spark, folder, 4), baseline=0.1)
    return scores.score_systems(systems_with_tokens(spark, folder), f1=meaning, tokens=TOKENS, counts=COUNTS)


@query("metric_report", _REPORT_SQL + " SELECT system, metric, value FROM metrics")
def metric_report(spark, folder):
    rows = scores.metric_rows(_report(spark, folder))
    return rows.select("system", "metric", F.round("value", 6).alias("value"))


@query("system_compare", _REPORT_SQL + """ SELECT metric, max(value) FILTER (system = 'clause') AS clause,
  max(value) FILTER (system = 'same') AS same FROM metrics GROUP BY metric""")
def system_compare(spark, folder):
    rows = scores.metric_rows(_report(spark, folder))
    return scores.compare_systems(rows.withColumn("value", F.round("value", 6)), ["clause", "same"])


@query("report_round_trip", _REPORT_SQL + " SELECT system, metric, value FROM metrics")
def report_round_trip(spark, folder):
    """The report written to a table, a run for each system and one of them twice, and read back."""
    staging = Staging(spark)
    path, rows = staging.path("report"), staging.write(scores.metric_rows(_report(spark, folder)), "rows")
    for name in ("clause", "same", "clause"):
        sources.write_report(rows.where(F.col("system") == name), path, run=name)
    return spark.read.parquet(path).select("system", "metric", F.round("value", 6).alias("value"))


# Blank predictions, the sentence with "the " before it, and its clause.
_PATCHED = f"""{sql.PAIRS}, offered AS (SELECT doc_id, pos, 'patched' AS system, normal, simple,
  CASE pos % 3 WHEN 0 THEN ' ' WHEN 1 THEN 'the ' || normal ELSE clause END AS given FROM pairs),
filled AS (SELECT *, CASE WHEN {sql.strip('given')} = '' THEN normal ELSE given END AS whole FROM offered),
patched AS (SELECT doc_id, pos, system, normal, simple, CASE WHEN {sql.bound('normal', 'whole')} > 0.95::DOUBLE
  THEN {sql.strip("replace(whole, 'the ', '')")} ELSE whole END AS predicted FROM filled)"""


@query("score_options", f"""WITH {_PATCHED}, {sql.sari('patched', 'system, doc_id, pos', sql.tokens_13a)}
SELECT system, count(*) AS samples, round(avg({sql.length_ratio('normal', 'predicted')}), 6) AS length_ratio,
  round(avg({sql.fkgl('predicted')}), 6) AS predicted_fkgl, (SELECT round(avg(score) * 100, 6) FROM sari) AS sari FROM patched GROUP BY system""")
def score_options(spark, folder):
    """Blank predictions count as their source, and near copies lose each "the "."""
    at = F.col("pos") % 3
    given = F.when(at == 0, " ").when(at == 1, F.concat(F.lit("the "), "normal")).otherwise(F.col("clause"))
    offered = pairs(spark, folder).select(F.lit("patched").alias("system"), "normal", given.alias("predicted"), "simple")
    scored = scores.score_systems(offered, empty_to_source=True, strip_the=True)
    return scored.select("system", "samples", *[F.round(c, 6).alias(c) for c in ("length_ratio", "predicted_fkgl", "sari")])


@query("embedding_f1", f"""WITH {_VECTORS_SQL} SELECT pair_id, system, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1 FROM f1 WHERE side = 'reference'""")
def embedding_scores(spark, folder):
    """Small blocks, so that each text is made of several."""
    scored = embedding_f1(token_blocks(spark, folder, 3), "reference", 0.1, system="system")
    return scored.select("pair_id", "system", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("verdict", _REPORT_SQL + """
SELECT system, CASE WHEN copy_rate > 0.4 THEN 'FAIL: copying too much' WHEN length_ratio > 0.95 THEN 'WARN: not simplifying enough'
  WHEN predicted_fkgl >= source_fkgl THEN 'FAIL: not reducing complexity'
  WHEN f1_source < 0.85 THEN 'FAIL: losing too much meaning' ELSE 'PASS' END AS verdict FROM report""")
def verdict(spark, folder):
    return _report(spark, folder).select("system", scores.verdict(
        F.col("copy_rate"), F.col("length_ratio"), F.col("predicted_fkgl"), F.col("source_fkgl"), F.col("f1_source")).alias("verdict"))
