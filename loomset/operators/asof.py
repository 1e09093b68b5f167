"""As-of joins: each row with the last row of another table at its time or before, and lists of models by their age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.store import discard, materialize


def as_of(rows: DataFrame, past: DataFrame, by: str, at: str, name: str = "last") -> DataFrame:
    """``rows`` with ``name``: the last row of ``past`` with the same ``by`` whose ``at`` isn't after theirs, as a struct; null where there is none.

    Rows of both are sorted together in ranges of key and time, and each looks back within its range; what
    came last before a range is carried into it. So a key with very many rows takes several tasks, and no
    pairs are made. Of rows of ``past`` with one time the greatest struct counts; null times are in none.
    A null key matches a null key. Rows that repeat stay.
    """
    told = F.struct(*(F.col(f"`{c}`") for c in past.columns))
    kind = past.select(told.alias("t")).schema["t"].dataType
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), F.col(f"`{by}`").alias("by"), F.col(f"`{at}`").alias("at"), F.lit(None).cast(kind).alias("told"))
    other = past.where(F.col(f"`{at}`").isNotNull()).select(F.lit(None).cast(own.schema["row"].dataType).alias("row"), F.col(f"`{by}`").alias("by"), F.col(f"`{at}`").alias("at"), told.alias("told"))
    # At one time, what is looked for comes before those that look.
    ranged = own.unionByName(other).repartitionByRange("by", "at", F.col("told").isNull(), F.xxhash64("row", "told"))
    ranged = ranged.withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "asof-ranged")
    end = F.max(F.when(F.col("told").isNotNull(), F.struct("at", "told"))).alias("end")
    # A row for each key of a range; what was carried into a range is the greatest end before it.
    before = W.partitionBy("by").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    spans = ranged.groupBy("by", "range").agg(end)
    carried = materialize(spans.select("by", "range", F.max("end").over(before).alias("carried")).where("carried IS NOT NULL"), "asof-carried")
    look = W.partitionBy("range", "by").orderBy("at").rangeBetween(W.unboundedPreceding, W.currentRow)
    seen = ranged.withColumn("seen", F.max(F.when(F.col("told").isNotNull(), F.struct("at", "told"))).over(look)).where("row IS NOT NULL")
    back = carried.select(F.col("by").alias("carried_by"), F.col("range").alias("carried_range"), "carried")
    out = seen.join(back, F.col("by").eqNullSafe(F.col("carried_by")) & (F.col("range") == F.col("carried_range")), "left")
    last = F.when(F.col("at").isNotNull(), F.coalesce(F.col("seen.told"), F.col("carried.told")))
    out = materialize(out.select("row.*", last.alias(name)), "asof")
    discard(ranged, carried)
    return out


def listed(requests: DataFrame, pulls: DataFrame, by: str, at: str, live: Column, models: str, static: Column, max_age_s: int = 86_400) -> DataFrame:
    """``requests`` with ``origin`` and ``models``: where the list that each gets comes from, and the list.

    The last pull that found something is "fresh" up to ``max_age_s`` seconds. Otherwise a request pulls by
    itself: ``live`` is what it finds, null where the service can't be reached. Failing that it gets the
    "stale" list, and with no pull at all the "static" one.
    """
    kept = pulls.where(F.size(models) > 0).select(by, at, F.col(models).alias("pulled"))
    got = as_of(requests.withColumn("live_list", live), kept, by, at, "cached")
    age = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col(f"cached.{at}").cast("timestamp"))
    alive = F.size(F.coalesce("live_list", F.array().cast("array<string>"))) > 0
    origin = F.when(age <= max_age_s * 1_000_000, "fresh").when(alive, "live").when(F.col("cached").isNotNull(), "stale").otherwise("static")
    got = got.withColumn("origin", origin)
    chosen = F.when(F.col("origin") == "live", F.col("live_list")).when(F.col("origin") == "static", static).otherwise(F.col("cached.pulled"))
    return got.withColumn("models", chosen).drop("live_list", "cached")
