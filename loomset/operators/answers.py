"""The log of a model's answers: asked once, kept at once, read back in any order.

A run puts what has no answer yet into a queue of small files. A stream takes them by batches, and each
batch's answers are a table of their own, told by run and batch, before the next batch begins; a batch
that is done again replaces its table. What is read afterwards is the log, so sorting, joining and
counting never ask a model again. A later run asks for what the log lacks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.operators.batch import Journal, Pace, Retries, run_backend
from loomset.store import shared_dir, track


@dataclass(frozen=True)
class AnswerLog:
    """``path`` is a folder of any store that Spark writes.

    ``parallel`` calls run at once, each for up to ``each`` rows of a batch. A driver or executor that
    dies loses the answers of the batch that wasn't done, unless there is a ``journal``: a plain folder
    that all machines share, which has each answer before the next call.
    """

    path: str
    journal: str = ""
    parallel: int = 8
    each: int = 16

    def read(self, spark: SparkSession, key: str, kind: str) -> DataFrame:
        """All answers (key, output, status, error, run, batch); a key that failed may have one for each run."""
        schema = f"`{key}` {kind}, output string, status int, error string, run int, batch long"
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/answers")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def latest(self, spark: SparkSession, key: str, kind: str) -> DataFrame:
        """(key, output, status, error): each key's answer, or its last failure while it has none."""
        told = F.struct((F.col("error") == "").alias("said"), "run", "batch", "output", "status", "error")
        return self.read(spark, key, kind).groupBy(key).agg(F.max(told).alias("x")).select(key, "x.output", "x.status", "x.error")

    def ask(self, rows: DataFrame, key: str, payload: str, opened: Callable[[], Callable[[Any], str]], retries: Retries = Retries(), stop: Callable[[], bool] | None = None, keep: Callable[[Any, str], None] | None = None, pace: Pace | None = None) -> DataFrame:
        """Asks for the rows without an answer, and returns ``latest`` for all of ``rows`` that were ever reached.

        A key that repeats is asked once. A null key is left out.
        """
        spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
        before = self.read(spark, key, kind)
        run = (before.agg(F.max("run")).first()[0] or 0) + 1
        journal = Journal(self.journal) if self.journal else None
        if journal and (files := journal.files()):
            # What a run that was killed had been told: the log takes it first.
            left = journal.answers(spark, key, kind).dropDuplicates([key]).join(before.where("error = ''").select(key), key, "left_anti")
            left.select(key, "output", F.lit(None).cast("int").alias("status"), F.lit("").alias("error")).write.mode("overwrite").parquet(f"{self.path}/answers/run={run}/batch=-1")
            for file in files:
                file.unlink()
        said = self.read(spark, key, kind).where("error = ''").select(key)
        todo = rows.where(F.col(key).isNotNull()).select(key, payload).dropDuplicates([key]).join(said, key, "left_anti")
        home = f"{self.path}/runs/{run}-{uuid.uuid4().hex[:8]}"
        todo.repartitionByRange(key).sortWithinPartitions(key).write.option("maxRecordsPerFile", self.each).parquet(f"{home}/queue")

        def store(batch: DataFrame, number: int) -> None:
            # Tasks deal the batch by key, so a batch that is done again has the same parts.
            dealt = batch.repartition(self.parallel, key).sortWithinPartitions(key) if self.parallel > 1 else batch.coalesce(1).sortWithinPartitions(key)
            answers = run_backend(dealt, key, payload, opened, retries, stop, keep, pace, journal, f"{run}.{number}")
            answers.write.mode("overwrite").parquet(f"{self.path}/answers/run={run}/batch={number}")

        stream = spark.readStream.schema(todo.schema).option("maxFilesPerTrigger", self.parallel).parquet(f"{home}/queue")
        stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start().awaitTermination()
        for file in journal.files() if journal else []:
            file.unlink()  # the log has it all now
        return rows.where(F.col(key).isNotNull()).select(key).distinct().join(self.latest(spark, key, kind), key)


def scratch_log(spark: SparkSession, **how: Any) -> AnswerLog:
    """A log in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/loomset-answers-{uuid.uuid4().hex[:12]}"
    track(spark, path)
    return AnswerLog(path, **how)
