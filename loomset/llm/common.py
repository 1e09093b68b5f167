"""What the corpus operators share: batch bounds, text columns and numbers for rows; their scratch tables are those of the store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.session import ship
from loomset.store import discard, free_shuffles, materialize, shared_dir, track

__all__ = ["BATCH_ROWS", "WORD", "bucketed", "discard", "id_and_bytes", "materialize", "numbered", "small_batches", "table", "text_bytes"]

#: A word: a run of anything but ASCII white space. ``bytes.split()`` yields exactly these on UTF-8.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of text in one Arrow batch: bounds a Python worker's memory, whatever the texts' number.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``number`` from 0 by ``order``, as a table: rows are sorted in ranges, and each range starts after the rows before it.

    No task sees all rows; only the ranges' counts, a row each, come together. Rows that tie are numbered
    as they come, so ``order`` should be of unique keys.
    """
    ranged = df.repartitionByRange(*order).select("*", F.spark_partition_id().alias("range"))
    ranged = materialize(ranged, f"{name}-ranged")
    starts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.sum("n").over(W.orderBy("range")) - F.col("n")).drop("n")
    place = F.row_number().over(W.partitionBy("range").orderBy(*order)) - 1
    out = ranged.withColumn("place", place).join(F.broadcast(starts), "range").withColumn("number", F.col("start") + F.col("place"))  # a row for each task of the shuffle
    out = materialize(out.drop("range", "place", "start"), f"{name}-numbered")
    discard(ranged)
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` as a scratch table in as many buckets by ``key`` as there are shuffle partitions: joins on the key then move the other side only."""
    spark = df.sparkSession
    n, known = int(spark.conf.get("spark.sql.shuffle.partitions")), f"loomset_{uuid.uuid4().hex[:12]}"
    path = f"{shared_dir(spark).rstrip('/')}/loomset-{name}-{known}"
    track(spark, path)
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(known)
    free_shuffles(spark)
    out = spark.table(known)
    spark.sql(f"DROP TABLE {known}")  # an entry of the catalog; the files stay until they are discarded
    out._scratch_path = path
    return out


def small_batches(spark: SparkSession) -> None:
    """Before any Python map: the package goes to the executors, and batches stay small.

    Spark bounds a batch's bytes itself. All operators use the same number of rows, so it doesn't matter
    when a lazy plan runs; a number that the user has set to anything but Spark's own is left alone.
    """
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def text_bytes(column: str) -> Column:
    """The text as UTF-8, null as empty."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, ``id`` and ``body``: whatever else ``df`` holds can't clash with an operator's own names."""
    return df.select(F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("body"))
