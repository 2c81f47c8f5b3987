"""Trailing means, estimates and their texts."""

import random

import pytest
from pyspark.sql import functions as F

from clearlines.operators import latency
from clearlines.plans.staging import Staging
from clearlines.streaming.latency import rocksdb_state, trailing_mean_stream


def timings(seed=1, n=600):
    rng = random.Random(seed)
    # one session holds most rows, some rows share a time, one key is NULL
    return [(None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", "simplify" if i % 5 else "translate",
             rng.randint(0, 80), i, float(rng.randint(1, 900)) / 10) for i in range(n)]


SCHEMA = "session string, stage string, ts long, id long, seconds double"


def brute(rows, size=20):
    out = {}
    for key in {(r[0], r[1]) for r in rows}:
        recent = []
        for r in sorted((r for r in rows if (r[0], r[1]) == key), key=lambda r: (r[2], r[3])):
            out[r[3]] = (sum(recent) / len(recent) if recent else None, len(recent))
            recent = [*recent, r[4]][-size:]
    return out


@pytest.mark.parametrize("chunks", [None, 1, 13, 150])
def test_trailing_mean(spark, chunks):
    rows = timings()
    df = spark.createDataFrame(rows, SCHEMA)
    got = latency.trailing_mean(df, ["session", "stage"], ["ts", "id"], ["seconds"], chunks=chunks, staging=Staging(spark)).collect()
    wanted = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        mean, size = wanted[r.id]
        assert r.history == size and (r.seconds_mean is None if mean is None else r.seconds_mean == pytest.approx(mean))


@pytest.mark.parametrize("mean, history, wanted", [(None, 0, (70.0, 52.5, 126.0)), (10.0, 3, (42.0, 35.7, 56.7)),
                                                   (100.0, 1, (100.0, 80.0, 150.0)), (100.0, 8, (100.0, 90.0, 120.0))])
def test_eta(spark, mean, history, wanted):
    df = spark.createDataFrame([("simplify", 100, mean, history)], "stage string, words int, m double, history int")
    row = latency.eta(df, "stage", "words", "m").first()
    assert (row.eta, row.eta_low, row.eta_high) == pytest.approx(wanted)


def test_request_eta(spark):
    df = spark.createDataFrame([(1000, None, 5.0, 0)], "words int, s double, t double, history int")
    row = latency.request_eta(df, "words", "s", "t").first()
    assert (row.simplify_eta, row.translate_eta) == pytest.approx((240.0, 108.0))
    assert (row.total_low, row.total_high) == pytest.approx((348 * 0.75, 348 * 1.8))


def test_duration_text(spark):
    rng = random.Random(2)
    values = [0.05, 0.15, 0.25, 0.35, 0.45, 59.95, 59.949999, 60.0, 90.0, 63.0, 75.0, 0.0, 1e5] + [
        rng.choice([rng.uniform(0, 200), rng.randint(0, 4000) / 20, rng.randint(0, 9000) / 40]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(latency.seconds_text(F.col("v"))).collect()]
    assert got == [f"{v:.1f}s" if v < 60 else f"{v / 60:.1f}m" for v in values]
    assert df.limit(1).select(latency.range_text(F.lit(5.0), F.lit(120.0))).first()[0] == "5.0s-2.0m"
    assert [r[0] for r in spark.createDataFrame([(" a  b ",), (None,)], "t string").select(latency.request_words(F.col("t"))).collect()] == [2, 0]


def streamed(spark, stream, folder, **options):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "forget_after_ms" not in options)
    with rocksdb_state(spark):
        query = (trailing_mean_stream(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out")
                 .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert query.awaitTermination(120)
    return spark.read.parquet(f"{folder}/out")


@pytest.mark.parametrize("forget", [None, 3_600_000])
def test_stream_equals_batch(spark, tmp_path, forget):
    """Rows arriving in order, in several micro-batches, some timings NULL."""
    own = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rows = sorted((r[:4] + (None,) if r[3] % 97 == 0 else r for r in timings(4)), key=lambda r: (r[2], r[3]))
    for part in range(3):
        piece = spark.createDataFrame(rows[part * 200:(part + 1) * 200], SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streamed(spark, stream, tmp_path, **({"forget_after_ms": forget} if forget else {})).collect()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == own
    assert len(got) == len(rows)
    wanted = {}
    for key in {(r[0], r[1]) for r in rows}:
        recent = []
        for r in (r for r in rows if (r[0], r[1]) == key):
            known = [s for s in recent if s is not None]
            wanted[r[3]] = (sum(known) / len(known) if known else None, len(recent))
            recent = [*recent, r[4]][-20:]
    for r in got:
        mean, size = wanted[r.id]
        assert r.history == size and (r.seconds_mean is None if mean is None else r.seconds_mean == pytest.approx(mean))


def test_timings_are_forgotten(spark, tmp_path):
    """A group's timings of a micro-batch that is long past count no more."""
    schema = None
    for part in range(2):
        piece = spark.createDataFrame([("s", "simplify", part, part, 5.0)], SCHEMA).withColumn("ts", F.timestamp_seconds("ts"))
        piece.write.mode("append").parquet(str(tmp_path / "in"))
        schema = piece.schema
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = streamed(spark, stream, tmp_path, forget_after_ms=1)
    assert sorted((r.id, r.history) for r in got.collect()) == [(0, 0), (1, 0)]


def test_large_group_within_bounded_memory(spark, tmp_path):
    """A million timings of one session in one micro-batch: no worker ever has 900 MB."""
    rows = spark.range(1_000_000).select(F.lit("hot").alias("session"), F.lit("simplify").alias("stage"),
                                         F.timestamp_seconds(F.col("id")).alias("ts"), "id", (F.col("id") % 7).cast("double").alias("seconds"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = streamed(spark, stream, tmp_path)
    ids = spark.range(1_000_000)
    last = got.where("id >= 999980").orderBy("id").collect()
    assert got.count() == ids.count() and got.where("history < 20").count() == 20
    for r in last:
        assert r.seconds_mean == pytest.approx(sum(i % 7 for i in range(r.id - 20, r.id)) / 20)

    def peaks(parts):
        import resource

        for part in parts:
            yield part.assign(id=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)

    # the workers that served the stream serve this as well
    assert max(r.id for r in spark.range(0, 64, 1, 16).mapInPandas(peaks, "id long").collect()) < 900


def test_stream_of_small_groups_with_null_numbers_and_times(spark, tmp_path):
    """Groups are plain rows, not frames; a NULL session is a group of its own, and a NULL time comes last."""
    rows = [(None if i % 9 == 0 else i % 4, None if i % 10 == 3 else "a", None if i % 13 == 5 else i // 2, i, float(i % 7)) for i in range(120)]
    df = spark.createDataFrame(rows, "session long, stage string, ts long, id long, seconds double").withColumn("ts", F.timestamp_seconds("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    done = streamed(spark, spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), str(tmp_path))
    groups = {}
    for session, stage, ts, id_, seconds in sorted(rows, key=lambda r: (r[2] is None, r[2] or 0, r[3])):
        groups.setdefault((session, stage), []).append((id_, seconds))
    wanted = {}
    for key, timed in groups.items():
        for at, (id_, _) in enumerate(timed):
            before = [s for _, s in timed[max(0, at - 20):at]]
            wanted[id_] = (*key, len(before), pytest.approx(sum(before) / len(before)) if before else None)
    got = {r.id: (r.session, r.stage, r.history, r.seconds_mean) for r in done.collect()}
    assert got == wanted
