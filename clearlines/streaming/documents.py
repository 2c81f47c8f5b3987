"""Simplifying a stream of documents.

A rule needs no state and no shuffle, so the batch function serves as it is. A ladder runs inside one streaming
plan too (``in_row``), a document being the unit of work. Otherwise it writes its attempts, which a streaming plan
cannot do in its midst: each micro-batch runs the batch job, whose unit is the sentence, and replaces its own folder,
so a repeated batch leaves one copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clearlines.operators.generate import HEURISTIC, Generator, Rule
from clearlines.operators.ladder import TWO, Ladder
from clearlines.operators.row_ladder import simplify_in_row
from clearlines.plans.simplify import simplify, simplify_by_rule
from clearlines.plans.staging import Staging


def simplify_stream(docs: DataFrame, output: str, checkpoint: str, generator: Generator | Rule = HEURISTIC,
                    ladder: Ladder | None = None, key: str = "doc_id", text: str = "text",
                    partitions: int | None = None, trigger: dict | None = None, in_row: bool = False) -> StreamingQuery:
    """Start writing simplified documents to parquet; without a ladder a rule is applied directly.

    ``partitions`` spreads each micro-batch over that many tasks (model tasks with a ladder),
    for sources that deliver few large pieces. ``in_row`` keeps a ladder inside the streaming plan: no stage is
    written, nothing is shuffled (but by ``partitions``), and keys do not matter.
    """
    trigger = trigger or {"availableNow": True}
    by_rule = ladder is None and isinstance(generator, Rule)
    if by_rule or in_row:
        if partitions:
            docs = docs.repartition(partitions, key)
        out = simplify_by_rule(docs, text, generator) if by_rule else simplify_in_row(docs, text, generator, ladder or TWO)
        return (out.writeStream.format("parquet").option("path", output)
                .option("checkpointLocation", checkpoint).trigger(**trigger).start())

    def one_batch(batch: DataFrame, number: int) -> None:
        staging = Staging(batch.sparkSession)
        done = simplify(batch, key, text, generator, ladder or TWO, staging, partitions)
        done.write.mode("overwrite").parquet(f"{output}/batch={number}")
        staging.close()

    return (docs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(**trigger).start())
