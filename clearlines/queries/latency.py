"""Waiting-time estimates from the events as timings."""

from __future__ import annotations

from pyspark.sql import functions as F

from clearlines.operators import latency
from clearlines.plans.staging import Staging
from clearlines.queries import sql
from clearlines.queries.data import requests
from clearlines.queries.registry import query
from clearlines.streaming.latency import rocksdb_state, trailing_mean_batches, trailing_mean_stream

_FRAME = "(PARTITION BY session, stage ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_TRAILING = f"""{sql.REQUESTS}, trail AS (
  SELECT *, avg(seconds) OVER {_FRAME} AS mean, count(*) OVER {_FRAME} AS history FROM requests)"""
_TRAILING_SQL = f"""WITH {_TRAILING} SELECT session, stage, id, round(mean, 9) AS seconds_mean, history FROM trail"""
KEYS = ["session", "stage"]


def _trailing(spark, folder, **options):
    return latency.trailing_mean(requests(spark, folder), KEYS, ["ts", "id"], ["seconds"], **options)


def _means(df):
    return df.select(*KEYS, "id", F.round("seconds_mean", 9).alias("seconds_mean"), "history")


@query("latency_trailing", _TRAILING_SQL)
def trailing(spark, folder):
    return _means(_trailing(spark, folder))


@query("latency_trailing_hot", _TRAILING_SQL)
def trailing_hot(spark, folder):
    """The same in many chunks, so that most sessions span several."""
    return _means(_trailing(spark, folder, chunks=97))


_ETA = f"""{_TRAILING}, guessed AS (SELECT *, CASE stage WHEN 'simplify' THEN least(240.0::DOUBLE, 25.0::DOUBLE + 0.45::DOUBLE * words)
    ELSE least(180.0::DOUBLE, 18.0::DOUBLE + 0.30::DOUBLE * words) END AS guess FROM trail),
etas AS (SELECT *, CASE WHEN mean IS NULL THEN guess ELSE greatest(mean, 0.60::DOUBLE * guess) END AS eta FROM guessed),
bounded AS (SELECT *, eta * CASE WHEN history < 1 THEN 0.75::DOUBLE WHEN history < 3 THEN 0.80::DOUBLE
    WHEN history < 8 THEN 0.85::DOUBLE ELSE 0.90::DOUBLE END AS eta_low,
  eta * CASE WHEN history < 1 THEN 1.80::DOUBLE WHEN history < 3 THEN 1.50::DOUBLE
    WHEN history < 8 THEN 1.35::DOUBLE ELSE 1.20::DOUBLE END AS eta_high FROM etas)"""


def _eta(spark, folder):
    return latency.eta(_trailing(spark, folder), "stage", "words", "seconds_mean")


@query("eta", f"""WITH {_ETA} SELECT session, stage, id, round(eta, 9) AS eta, round(eta_low, 9) AS eta_low,
  round(eta_high, 9) AS eta_high FROM bounded""")
def eta(spark, folder):
    return _eta(spark, folder).select(*KEYS, "id", *[F.round(c, 9).alias(c) for c in ("eta", "eta_low", "eta_high")])


_WIDE_FRAME = "(PARTITION BY session ORDER BY ts, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"


def _bounds_sql(name: str, mean: str, guess: str) -> str:
    low = "CASE WHEN history < 1 THEN 0.75 WHEN history < 3 THEN 0.80 WHEN history < 8 THEN 0.85 ELSE 0.90 END::DOUBLE"
    high = "CASE WHEN history < 1 THEN 1.80 WHEN history < 3 THEN 1.50 WHEN history < 8 THEN 1.35 ELSE 1.20 END::DOUBLE"
    eta_ = f"CASE WHEN {mean} IS NULL THEN {guess} ELSE greatest({mean}, 0.60::DOUBLE * {guess}) END"
    return f"({eta_}) AS {name}_eta, ({eta_}) * {low} AS {name}_low, ({eta_}) * {high} AS {name}_high"


@query("request_eta", f"""WITH {sql.REQUESTS}, wide AS (
  SELECT *, avg(seconds) OVER {_WIDE_FRAME} AS smean, avg(seconds / 2) OVER {_WIDE_FRAME} AS tmean, count(*) OVER {_WIDE_FRAME} AS history
  FROM requests), both_stages AS (SELECT *,
    {_bounds_sql('s', 'smean', 'least(240.0::DOUBLE, 25.0::DOUBLE + 0.45::DOUBLE * words)')},
    {_bounds_sql('t', 'tmean', 'least(180.0::DOUBLE, 18.0::DOUBLE + 0.30::DOUBLE * words)')} FROM wide)
SELECT session, id, round(s_eta, 9) AS simplify_eta, round(t_eta, 9) AS translate_eta,
  round(s_low + t_low, 9) AS total_low, round(s_high + t_high, 9) AS total_high FROM both_stages""")
def request_eta(spark, folder):
    """One row per request with the timings of both stages."""
    wide = requests(spark, folder).select("session", "ts", "id", "words", F.col("seconds").alias("s"), (F.col("seconds") / 2).alias("t"))
    means = latency.trailing_mean(wide, ["session"], ["ts", "id"], ["s", "t"])
    done = latency.request_eta(means, "words", "s_mean", "t_mean")
    return done.select("session", "id", *[F.round(c, 9).alias(c) for c in ("simplify_eta", "translate_eta", "total_low", "total_high")])


def _text_sql(x: str) -> str:
    return f"CASE WHEN {x} < 60 THEN printf('%.1fs', {x}) ELSE printf('%.1fm', {x} / 60) END"


@query("eta_text", f"""WITH {sql.REQUESTS} SELECT id, {_text_sql('seconds')} AS took,
  {_text_sql('seconds * 0.75::DOUBLE')} || '-' || {_text_sql('seconds * 1.8::DOUBLE')} AS span FROM requests""")
def eta_text(spark, folder):
    s = F.col("seconds")
    return requests(spark, folder).select("id", latency.seconds_text(s).alias("took"),
                                          latency.range_text(s * 0.75, s * 1.8).alias("span"))


SLICES = 10


def _slices(spark, folder):
    """The requests, and the column that cuts them into ``SLICES`` parts by time."""
    rows = requests(spark, folder).drop("words")
    at = F.unix_timestamp("ts")
    low, high = rows.agg(F.min(at), F.max(at)).first()
    return rows, F.least(F.floor(SLICES * (at - low) / max(1, high - low)), F.lit(SLICES - 1))


@query("stream_latency", _TRAILING_SQL)
def stream_latency(spark, folder):
    """The events arriving in ten parts, with the last timings of each group as state; each part is a run of the query that
    goes on from the state of the one before."""
    staging = Staging(spark)
    rows, part = _slices(spark, folder)
    for i in range(SLICES):
        rows.where(part == i).write.mode("append").parquet(staging.path("in"))
        stream = spark.readStream.schema(rows.schema).parquet(staging.path("in"))
        with rocksdb_state(spark):
            running = (trailing_mean_stream(stream).writeStream.format("parquet").option("path", staging.path("out"))
                       .option("checkpointLocation", staging.path("state")).trigger(availableNow=True).start())
        running.awaitTermination()
    return _means(spark.read.parquet(staging.path("out")))


@query("stream_latency_batches", _TRAILING_SQL)
def stream_latency_batches(spark, folder):
    """The events in ten parts by time, a micro-batch each, with the last timings of each group as a table."""
    staging = Staging(spark)
    rows, part = _slices(spark, folder)
    for i in range(SLICES):
        rows.where(part == i).write.mode("append").parquet(staging.path("in"))
        stream = spark.readStream.schema(rows.schema).parquet(staging.path("in"))
        trailing_mean_batches(stream, staging.path("out"), staging.path("tails"), staging.path("checkpoint")).awaitTermination()
    return _means(spark.read.parquet(staging.path("out")))
