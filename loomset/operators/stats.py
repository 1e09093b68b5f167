"""Numbers of a dataset: sizes, aspects, buckets, steps. Frames have (w, h, has_caption)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aspect labels in order of preference for equal distance, training steps, bucket sides.
ASPECTS = [("3:2", 3 / 2), ("4:3", 4 / 3), ("16:9", 16 / 9), ("2:3", 2 / 3), ("3:4", 3 / 4), ("9:16", 9 / 16)]
STEPS_PER_IMAGE, MIN_STEPS, MAX_STEPS = 75, 1000, 4000
LADDER = [512, 768, 1024]


def aspect_label(w: Column, h: Column) -> Column:
    """Square only when the sides are equal, else the nearest of the other ratios."""
    ratio = w / h
    nearest = F.array_min(F.array(*(F.struct(F.abs(ratio - F.lit(r)).alias("gap"), F.lit(i).alias("rank"), F.lit(n).alias("label")) for i, (n, r) in enumerate(ASPECTS))))
    return F.when(w == h, "square").otherwise(nearest["label"])


def dataset_stats(images: DataFrame) -> DataFrame:
    side = F.greatest("w", "h")
    got = images.agg(F.count(F.lit(1)).alias("n_images"), F.count_if("has_caption").alias("n_captioned"), F.coalesce(F.min(side), F.lit(0)).alias("min_long_side"), F.coalesce(F.max(side), F.lit(0)).alias("max_long_side"))
    return got.withColumn("suggested_steps", suggested_steps(F.col("n_images"))).withColumn("num_repeats", num_repeats(F.col("n_images")))


def suggested_steps(n: Column) -> Column:
    return F.greatest(F.lit(MIN_STEPS), F.least(F.lit(MAX_STEPS), n * STEPS_PER_IMAGE)).cast("long")


def num_repeats(n: Column) -> Column:
    return F.when(n > 0, F.greatest(F.lit(1), F.bround(F.lit(400.0) / n).cast("long"))).otherwise(F.lit(1)).cast("long")


def aspect_histogram(images: DataFrame) -> DataFrame:
    return images.groupBy(aspect_label(F.col("w"), F.col("h")).alias("aspect")).agg(F.count(F.lit(1)).alias("n"))


def buckets(resolution: Column, max_long: Column) -> Column:
    top = F.least(resolution, F.when(max_long > 0, max_long).otherwise(resolution))
    ladder = F.filter(F.array(*map(F.lit, LADDER)), lambda b: b <= top)
    every = F.array_sort(F.array_distinct(F.concat(ladder, F.when(resolution <= top, F.array(resolution)).otherwise(F.array().cast("array<int>")))))
    return F.when(F.size(every) > 0, every).otherwise(F.array(resolution))
