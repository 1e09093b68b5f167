"""Jobs of a remote service as a stream with state: submitted once, asked after by timers, done, failed or given up.

Each job is a key of its own with the service's ticket and a deadline as its state, so thousands are
waited for without a thread for any. State and timers are in the query's checkpoint: a driver that is
started again asks after the jobs that it has submitted, and doesn't submit them anew.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loomset.functions.messages import LONGEST
from loomset.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "job string, state string, output string, message string, polls long"


class Transport(Protocol):
    """The service, as tasks reach it; it goes to the executors."""

    def backlog(self) -> int:
        """Jobs that wait at the service."""

    def submit(self, request: str) -> str:
        """The ticket of the job; raises where it is turned down."""

    def status(self, ticket: str) -> tuple[str, str]:
        """("waiting", ""), ("done", the output, "" if there is none) or ("error", why)."""


@dataclass(frozen=True)
class Patience:
    """How long and how often jobs are asked after, and how many may wait before others are turned away (``front``: never)."""

    timeout_s: float = 600.0
    poll_s: float = 1.5
    most_waiting: int = 10
    front: bool = False


class Jobs(StatefulProcessor):
    def __init__(self, transport: Transport, patience: Patience) -> None:
        self.transport, self.patience = transport, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "ticket string, deadline long, polls long")

    def _after(self, now: int) -> None:
        self.handle.registerTimer(now + round(self.patience.poll_s * 1000))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        request = next(iter(rows))["request"]
        if self.job.exists():  # the same job again: it is under way
            return
        try:
            if not self.patience.front and (waiting := self.transport.backlog()) > self.patience.most_waiting:
                yield result(key[0], "refused", message=f"{waiting} jobs are waiting already: clear the queue, or go to its front")
                return
            ticket = self.transport.submit(request)
        except Exception as e:
            yield result(key[0], "failed", message=str(e) or type(e).__name__)
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        self.job.update((ticket, now + round(self.patience.timeout_s * 1000), 0))
        self._after(now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        ticket, deadline, polls = self.job.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        try:
            state, said = self.transport.status(ticket)
        except Exception as e:  # the service may be back at the next time
            state, said = "waiting", str(e)
        if state == "done" and said:
            yield result(key[0], "done", said, polls=polls + 1)
        elif state == "done":
            yield result(key[0], "failed", message="it is done and has made nothing", polls=polls + 1)
        elif state == "error":
            yield result(key[0], "failed", message=said, polls=polls + 1)
        elif now >= deadline:
            yield result(key[0], "lost", message=f"not done within {self.patience.timeout_s:g} s; it may still be running. {said}".strip(), polls=polls + 1)
        else:
            self.job.update((ticket, deadline, polls + 1))
            self._after(now)
            return
        self.job.clear()

    def close(self) -> None:
        pass


def result(job: str, state: str, output: str | None = None, message: str = "", polls: int = 0) -> Row:
    return Row(job=job, state=state, output=output, message=message[:LONGEST], polls=polls)


def run_jobs(spark: SparkSession, source: str, transport: Transport, sink: str, checkpoint: str, patience: Patience = Patience()) -> StreamingQuery:
    """Submits the jobs (job, request) of the Parquet files that come into ``source``, and stores how each ends.

    Results (job, state, output, message, polls) are written batch by batch, each replaced when it is run again.
    A job that was turned away or failed may come again. Null requests are submitted as such.
    """
    ship(spark)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings that it began with

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    try:
        rows = spark.readStream.schema("job string, request string").parquet(source).where("job IS NOT NULL")
        ends = rows.groupBy("job").transformWithState(Jobs(transport, patience), RESULT, "Append", "ProcessingTime")
        stream = ends.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).outputMode("append")
        return stream.trigger(processingTime=f"{patience.poll_s} seconds").start()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def ended(spark: SparkSession, sink: str) -> DataFrame:
    """The results so far."""
    return spark.read.schema(RESULT).parquet(sink)


def wait_for(spark: SparkSession, query: StreamingQuery, sink: str, jobs: int, limit_s: float) -> DataFrame:
    """The results once as many jobs have ended; the query goes on. Raises where it fails, or the limit is reached."""
    until = time.monotonic() + limit_s
    while time.monotonic() < until:
        if query.exception():
            raise query.exception()
        try:
            if ended(spark, sink).count() >= jobs:
                return ended(spark, sink)
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        time.sleep(0.5)
    raise TimeoutError(f"not all of {jobs} jobs ended within {limit_s:g} s")
