"""Export: status of each image, numbering, upserts, and order-keeping merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.store import materialize


def status(caption: Column) -> Column:
    """ready, empty (a blank caption) or missing (none)."""
    return F.when(caption.isNull(), "missing").when(F.trim(caption) == "", "empty").otherwise("ready")


def counts(statuses: DataFrame) -> DataFrame:
    return statuses.agg(*(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ready", "empty", "missing")))


def numbered(rows: DataFrame, order: str = "ord") -> DataFrame:
    """``rows`` with ``number`` from 1 by ``order``, over range partitions: no task sees all rows.

    Rows are numbered within ranges of the order, and each range starts after the rows before it;
    only the ranges' counts come together. ``order`` must be unique.
    """
    ranged = rows.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, order).withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "numbered")  # ranges are those of the table, whichever executors are lost
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.withColumn("start", F.sum("size").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)))  # a row per range
    place = F.row_number().over(W.partitionBy("range").orderBy(order))
    return ranged.withColumn("place", place).join(F.broadcast(starts.drop("size")), "range").withColumn("number", (F.coalesce("start", F.lit(0)) + F.col("place")).cast("long")).drop("range", "place", "start")


def file_name(number: Column, suffix: Column) -> Column:
    return F.concat(F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")), suffix)


def upsert(existing: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Existing rows without those redone, and the new ones."""
    return existing.join(results.select(key), key, "left_anti").unionByName(results)


def without_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def priced(rows: DataFrame, model: str, prices: dict[str, float], default: float) -> DataFrame:
    """(model, n, cost): prices by a literal map, with a default."""
    table = F.create_map(*(F.lit(x) for kv in prices.items() for x in kv))
    got = rows.groupBy(F.col(model).alias("model")).agg(F.count(F.lit(1)).alias("n"))
    return got.select("model", "n", (F.col("n") * F.coalesce(F.try_element_at(table, F.col("model")), F.lit(default))).alias("cost"))


def neighbours(rows: DataFrame, group: str, order: str) -> DataFrame:
    """Previous and next within the group, clamped at its ends, and the position."""
    w = W.partitionBy(group).orderBy(order)
    every = W.partitionBy(group)
    return rows.select(group, order, F.coalesce(F.lag(order).over(w), F.col(order)).alias("prev"), F.coalesce(F.lead(order).over(w), F.col(order)).alias("next"), F.row_number().over(w).cast("long").alias("position"), F.count(F.lit(1)).over(every).alias("of"))


def ordered_union(first: DataFrame, second: DataFrame, key: str, order: str) -> DataFrame:
    """Keys of both, each once, those of the first before those of the second, in their orders."""
    a = first.select(key, F.lit(0).alias("part"), F.col(order).alias("at"))
    b = second.select(key, F.lit(1).alias("part"), F.col(order).alias("at"))
    return a.unionByName(b).groupBy(key).agg(F.min(F.struct("part", "at")).alias("at")).select(key, "at.part", "at.at")
