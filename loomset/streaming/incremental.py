"""Captioning as a stream of micro-batches: what is done stays done, and a restart goes on from there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def caption_stream(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, files_per_batch: int = 1) -> StreamingQuery:
    """Runs ``step`` over new Parquet files of ``source`` and stores each batch before the next one begins.

    A batch is written to a partition of its own, replaced when it is run again after a failure, so each
    row is stored once.
    """

    def store(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
