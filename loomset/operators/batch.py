"""Model backends over batches of images: one opening per task, paced calls, retries, failures as rows."""

from __future__ import annotations

import fcntl
import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions.messages import TRANSIENT
from loomset.session import ship

LIMITED = 429


@dataclass(frozen=True)
class Retries:
    """``tries`` in all; after a transient failure the pause doubles from ``pause`` seconds.

    A service that says "too many" gets ``limited_tries``, the pauses growing by ``limited_pause`` seconds each.
    """

    tries: int = 3
    pause: float = 2.0
    limited_tries: int = 4
    limited_pause: float = 5.0

    def after(self, status: int | None, failed: int) -> float | None:
        """Seconds until the next try after so many failures, the last with that status; None: no more tries."""
        if status == LIMITED:
            return self.limited_pause * failed if failed < self.limited_tries else None
        return self.pause * 2 ** (failed - 1) if status in TRANSIENT and failed < self.tries else None


@dataclass(frozen=True)
class Pace:
    """Call slots, ``spacing`` seconds apart for all tasks of all executors together.

    The time of the next free slot stands in a file, in a folder that all machines share; whoever wants to
    call takes it under the file's lock and moves it on. A lost executor leaves a slot unused, no more.
    """

    path: str
    spacing: float

    def move(self, step: Callable[[float], tuple[float, float]]) -> float:
        with open(os.open(self.path, os.O_RDWR | os.O_CREAT), "r+") as held:
            fcntl.flock(held, fcntl.LOCK_EX)
            taken, then = step(float(held.read() or "-inf"))
            held.seek(0)
            held.truncate()
            held.write(repr(then))
            held.flush()
            os.fsync(held.fileno())
        return taken

    def claim(self, now: float) -> float:
        """The time of the slot that is taken: now at the earliest."""
        return self.move(lambda free: (max(now, free), max(now, free) + self.spacing))

    def postpone(self, until: float) -> None:
        """No slot before then, for anyone: the service has said that calls come too fast."""
        self.move(lambda free: (until, max(free, until)))


@dataclass(frozen=True)
class Journal:
    """Answers as they come, in a plain folder that driver and executors share.

    Each is a line, on disk before the next call is made. A task that runs again after its executor was
    lost finds what was answered before; a line that was cut off is no answer.
    """

    folder: str

    def files(self, batch: str = "") -> list[Path]:
        return sorted(Path(self.folder).glob(f"{batch}-*.jsonl" if batch else "*.jsonl"))

    def told(self, batch: str) -> dict[Any, str]:
        return {key: output for file in self.files(batch) for key, output in _lines(file)}

    def note(self, batch: str, part: int, key: Any, output: str) -> None:
        os.makedirs(self.folder, exist_ok=True)
        with open(Path(self.folder) / f"{batch}-{part}.jsonl", "a", encoding="utf-8") as out:
            out.write(json.dumps({"key": key, "output": output}) + "\n")
            out.flush()
            os.fsync(out.fileno())

    def answers(self, spark, key: str, kind: str) -> DataFrame:
        """(key, output) of all that the journal tells."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    found = _lines(Path(name))
                    yield pa.RecordBatch.from_pylist([{key: k, "output": o} for k, o in found], schema)

        files = [(str(f),) for f in self.files()]
        schema = pa.schema([(key, pa.string() if kind == "string" else pa.int64()), ("output", pa.string())])
        ship(spark)
        return spark.createDataFrame(files, "name string").mapInArrow(run, f"`{key}` {kind}, output string")


def _lines(file: Path) -> Iterator[tuple[Any, str]]:
    for line in file.read_text(encoding="utf-8", errors="replace").splitlines():
        try:
            found = json.loads(line)
            yield found["key"], found["output"]
        except (ValueError, TypeError, KeyError):
            continue


def status_of(error: BaseException) -> int | None:
    """The HTTP status that an error carries, or that its response does."""
    for holder in (error, getattr(error, "response", None)):
        for name in ("code", "status_code"):
            if isinstance(got := getattr(holder, name, None), int):
                return got
    return None


def call(step: Callable[[], Any], retries: Retries, pace: Pace | None = None, sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.time) -> Any:
    """The step's answer; each try waits for a slot of its own, and a service that says "too many" puts off everyone's."""
    failed = 0
    while True:
        if pace and (wait := pace.claim(now()) - now()) > 0:
            sleep(wait)
        try:
            return step()
        except Exception as e:
            failed += 1
            status = status_of(e)
            pause = retries.after(status, failed)
            if pause is None:
                raise
            if pace and status == LIMITED:
                pace.postpone(now() + pause)
            sleep(pause)


def run_backend(
    rows: DataFrame, key: str, payload: str, opened: Callable[[], Callable[[Any], str]], retries: Retries = Retries(), stop: Callable[[], bool] | None = None,
    keep: Callable[[Any, str], None] | None = None, pace: Pace | None = None, journal: Journal | None = None, batch_name: str = "batch",
) -> DataFrame:
    """(key, output, status, error): ``opened()`` loads a model once for a task and gives the function that answers a payload.

    Calls at once are bounded by the partitions of ``rows``; no batch waits for another one. Once ``stop()``
    says so nothing more is asked, and what wasn't reached has no row. A row without a payload is a failure
    of its own and isn't asked. ``keep(key, output)`` gets each answer at once, and the journal before it.
    The plan that is returned asks each time that it runs: write it, and read what was written.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, told, part = None, journal.told(batch_name) if journal else {}, TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for spot, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stop and stop():
                    break
                try:
                    if spot in told:
                        said = told[spot]
                    elif value is None:
                        raise ValueError("there is nothing to send")
                    else:
                        answer = answer or opened()
                        said = call(lambda v=value: answer(v), retries, pace)
                        if journal:
                            journal.note(batch_name, part, spot, said)
                    if keep:
                        keep(spot, said)
                    out.append((said, None, ""))
                except Exception as e:  # one failed image must not stop the others
                    out.append((None, status_of(e), str(e) or type(e).__name__))
            texts, codes, errors = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, len(out)), pa.array(texts, pa.string()), pa.array(codes, pa.int32()), pa.array(errors, pa.string())], [key, "output", "status", "error"])

    ship(rows.sparkSession)
    return rows.select(F.col(key), F.col(payload)).mapInArrow(run, f"`{key}` {kind}, output string, status int, error string")
