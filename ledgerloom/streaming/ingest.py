"""Statements that arrive over time: each micro-batch of whole documents runs the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.plans.sweep import Run, sweep
from ledgerloom.sources.words import WORDS


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[Run, int], None], **options: object) -> StreamingQuery:
    """Run the sweep on every batch of new files in ``folder`` (a file holds whole documents); the sink must be idempotent by batch id."""

    def each(batch: DataFrame, number: int) -> None:
        sink(sweep(batch, **options), number)

    return spark.readStream.schema(WORDS).parquet(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
