"""Helpers shared by the operators: staged tables, Arrow batches, byte words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from clearlines.plans.staging import shared_folder

#: Bytes to byte words: A-Z in lower case, ASCII that is neither letter nor digit to a space, the rest as it is.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
                   for c in range(256))

#: Rows of a record batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 512


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: it is computed once, and a
    lost executor costs nothing that is written. Each call has a folder of its own."""
    path = f"{shared_folder(df.sparkSession)}/clearlines-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str) -> DataFrame:
    """``mapInArrow`` with small batches. Only the columns of ``df`` travel to Python: select first."""
    bounded_batches(df)
    return df.mapInArrow(run, schema)


def arrow_filter(df: DataFrame, text: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """The rows of ``df``, all columns, that a decision about their texts keeps; ``make()`` runs once per task."""
    at = df.columns.index(text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        decide = make()
        for batch in batches:
            yield batch.filter(pa.array(decide(batch.column(at).to_pylist()), pa.bool_()))

    bounded_batches(df)
    return df.mapInArrow(run, df.schema)


def bounded_batches(df: DataFrame) -> None:
    """Lower the session's rows per record batch to :data:`BATCH_ROWS`."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def per_worker(key, make: Callable):
    """What ``make()`` gives, made once per Python worker: workers serve many tasks."""
    import sys
    import types

    kept = sys.modules.setdefault("_clearlines_kept", types.ModuleType("_clearlines_kept")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]
