"""Trailing mean of stage timings on a stream, with the last timings of a group as state.

Two ways. As a stateful operator, one task takes a group's rows of a micro-batch and keeps the last timings in a list
state. As batch jobs over micro-batches, the last rows of each group are a table, and the chunked plan of the
batch operator spreads a large group over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from clearlines import fixed
from clearlines.operators.latency import trailing_mean
from clearlines.plans.staging import Staging


def _processor(rows: int, forget_after_ms: int | None) -> StatefulProcessor:
    """What is kept of a group: its last ``rows`` timings, as a list state.

    Groups are many and mostly small, so a group's rows are plain values: a frame for each would cost far more than its rows.
    """
    class Trailing(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.recent = handle.getListState("recent", "seconds double", forget_after_ms)

        def handleInputRows(self, key: tuple, parts: Iterator[Row], timers) -> Iterator[Row]:
            from collections import deque

            from pyspark.sql import Row

            recent = deque((s for (s,) in self.recent.get()), maxlen=rows)
            # NULLs come last
            batch = sorted(((r["ts"] is None, r["ts"], r["id"] is None, r["id"], r["seconds"]) for r in parts), key=lambda r: r[:4])
            for *_, at, seconds in batch:
                if seconds is not None and seconds != seconds:
                    seconds = None
                total, known = 0.0, 0
                for s in recent:
                    if s is not None:
                        total, known = total + s, known + 1
                yield Row(session=key[0], stage=key[1], id=at, seconds=seconds, seconds_mean=total / known if known else None,
                          history=len(recent))
                recent.append(seconds)
            self.recent.put([(s,) for s in recent])

        def close(self) -> None:
            pass

    return Trailing()


def trailing_mean_stream(timings: DataFrame, rows: int = fixed.HISTORY, forget_after_ms: int | None = None) -> DataFrame:
    """(session, stage, id, seconds, seconds_mean, history) for rows (session, stage, ts, id, seconds).

    Rows of one micro-batch are taken in the order of (ts, id), and later micro-batches must come later; bound the
    micro-batch at the source (``maxFilesPerTrigger`` or the like): its rows of one group are sorted in one worker, as plain
    values, and leave it one by one. ``ts`` is a timestamp column. NULL timings count in the history, not in the mean.
    Timings are forgotten ``forget_after_ms`` after their micro-batch; Spark then runs micro-batches without data too, so a query
    with ``availableNow`` only ends if ``spark.sql.streaming.noDataMicroBatches.enabled`` is false. Start the query within
    :func:`rocksdb_state`.
    """
    fields = {f.name: f.dataType.simpleString() for f in timings.schema.fields}
    out = (f"session {fields['session']}, stage {fields['stage']}, id {fields['id']}, "
           "seconds double, seconds_mean double, history bigint")
    mode = "None" if forget_after_ms is None else "ProcessingTime"
    return (timings.select("session", "stage", "ts", "id", "seconds").groupBy("session", "stage")
            .transformWithState(_processor(rows, forget_after_ms), out, "append", mode))


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state in RocksDB; the session's own setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, own)


def trailing_mean_batches(timings: DataFrame, output: str, state: str, checkpoint: str, rows: int = fixed.HISTORY,
                          keys: tuple[str, ...] = ("session", "stage"), order: tuple[str, ...] = ("ts", "id"),
                          values: tuple[str, ...] = ("seconds",), trigger: dict | None = None) -> StreamingQuery:
    """Start writing ``timings`` with their trailing means to ``output``, one folder per micro-batch.

    The last ``rows`` rows of each group are a table in ``state``, written anew for each
    micro-batch; a repeated micro-batch starts from the table before it and replaces its own
    folders. Rows of later micro-batches must come later in ``order``.
    """
    columns = [*keys, *order, *values]

    def one_batch(batch: DataFrame, number: int) -> None:
        spark, staging = batch.sparkSession, Staging(batch.sparkSession)
        fresh = batch.withColumn("_fresh", F.lit(True))
        if number:
            before = spark.read.parquet(f"{state}/batch={number - 1}").withColumn("_fresh", F.lit(False))
            fresh = fresh.unionByName(before, allowMissingColumns=True)
        done = trailing_mean(fresh, list(keys), list(order), list(values), rows, staging=staging)
        done.where("_fresh").drop("_fresh").write.mode("overwrite").parquet(f"{output}/batch={number}")
        # Spark keeps the first rows of a group before it shuffles them
        latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        last = fresh.select(*columns, F.row_number().over(latest).alias("_rank")).where(F.col("_rank") <= rows)
        last.drop("_rank").write.mode("overwrite").parquet(f"{state}/batch={number}")
        staging.close()

    return (timings.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
