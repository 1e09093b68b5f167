"""Tags from scored labels. Frames have (image, idx, name, category, prob)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T

#: The categories of each role by scheme.
SCHEMES = {"danbooru": {"general": [0], "character": [4], "rating": [9]}, "e621": {"general": [0, 5], "character": [1, 3, 4, 8], "rating": []}}


def scheme_roles(scheme: str) -> dict[str, list[int]]:
    return SCHEMES.get(scheme, SCHEMES["danbooru"])


def select_tags(labels: DataFrame, general: float = 0.35, character: float = 0.85, scheme: str = "danbooru") -> DataFrame:
    """(image, tags): general tags by falling score, then characters; ties keep the labels' order."""
    roles = scheme_roles(scheme)
    rank = F.when(F.col("category").isin(roles["general"]) & (F.col("prob") >= general), 0).when(F.col("category").isin(roles["character"]) & (F.col("prob") >= character), 1)
    picked = labels.withColumn("rank", rank).where("rank IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("rank", (-F.col("prob")).alias("minus"), "idx", "name")))
    return picked.groupBy("image").agg(F.transform(ordered, lambda x: x["name"]).alias("tags"))


def select_rating(labels: DataFrame, scheme: str = "danbooru") -> DataFrame:
    """(image, rating): the best rated label, the first of equals."""
    rated = labels.where(F.col("category").isin(scheme_roles(scheme)["rating"]) if scheme_roles(scheme)["rating"] else F.lit(False))
    return rated.groupBy("image").agg(F.min_by("name", F.struct((-F.col("prob")).alias("minus"), "idx")).alias("rating"))


def tag_captions(labels: DataFrame, general: float = 0.35, character: float = 0.85, scheme: str = "danbooru", rating: bool = False, keep_underscores: bool = False) -> DataFrame:
    tags = select_tags(labels, general, character, scheme)
    out = F.transform("tags", lambda x: T.format_tag(x, keep_underscores))
    if not rating:
        return tags.select("image", F.array_join(out, ", ").alias("caption"))
    both = tags.join(select_rating(labels, scheme), "image", "full")
    every = F.concat(F.coalesce(out, F.array().cast("array<string>")), F.array_compact(F.array(T.format_tag(F.col("rating"), keep_underscores))))
    return both.select("image", F.array_join(every, ", ").alias("caption"))
