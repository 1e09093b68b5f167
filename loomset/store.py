"""The scratch store: intermediate tables in the folder that driver and executors share.

Tables go to the folder that the cluster names in ``spark.checkpoint.dir``; only where that is unset,
as in tests, a local folder takes its place. A table goes when its operator has no more use for it;
tables that a lazy result still reads go when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Path and file system of the tables that are still there.
_KEPT: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext.getCheckpointDir()
        if known:
            return known
        base = tempfile.mkdtemp(prefix="loomset-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        return spark.sparkContext.getCheckpointDir()
    return base


def track(spark: SparkSession, path: str) -> None:
    """The folder is deleted when it is spent, or when the driver ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    _KEPT[path] = at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def free_shuffles(spark: SparkSession) -> None:
    """Spark removes what a finished job has shuffled once its driver has collected its garbage; one with little to do seldom does so."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table of the shared folder and read it back.

    This cuts the lineage: when executors are lost, later stages reread the table and recompute
    nothing before it. The table's size is also known to the planner from here on, so that joins
    with it are broadcast only when it is in fact small.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/loomset-{name}-{uuid.uuid4().hex[:12]}"
    schema, began = df.schema, time.monotonic()
    track(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    if time.monotonic() - began > 2:
        free_shuffles(spark)  # a short write has left little behind
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing reads any more: all that came from them is a table by now."""
    for t in tables:
        at, files = _KEPT.pop(t._scratch_path)
        files.delete(at, True)


@contextlib.contextmanager
def spent_after() -> Iterator[list[DataFrame]]:
    """Scratch tables that are made within are deleted at its end, but for those that are put into the list."""
    before, kept = set(_KEPT), []
    yield kept
    for path in set(_KEPT) - before - {t._scratch_path for t in kept}:
        at, files = _KEPT.pop(path)
        files.delete(at, True)


@atexit.register
def _discard_rest() -> None:
    for at, files in _KEPT.values():
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            files.delete(at, True)
