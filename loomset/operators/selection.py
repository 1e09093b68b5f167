"""Which rows go on: picks, redone and carried rows, models on offer, names without clashes."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.operators.export import numbered

#: Parts of names that rule a model out.
NOT_IMAGE = ("imagen", "-shut-down", "deprecated", "-experimental")
NOT_CAPTION = ("image", "imagen", "embedding", "tts", "audio", "live", "-omni")
REPO_ID = r"^[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)?$"


def _none_of(name: Column, parts: tuple[str, ...]) -> Column:
    return ~name.rlike("|".join(parts))


def image_models(models: DataFrame) -> DataFrame:
    """Models (``model_id``) that edit images."""
    name = F.col("model_id")
    return models.where(F.contains(name, F.lit("image")) & _none_of(name, NOT_IMAGE))


def caption_models(models: DataFrame, family: str, action: str = "generateContent") -> DataFrame:
    """Models (``model_id``, ``actions``) that describe images, with ``place``: rolling names first, then by name."""
    name = F.col("model_id")
    fit = models.where(F.array_contains("actions", action) & name.startswith(family) & _none_of(name, NOT_CAPTION))
    return fit.withColumn("late", F.when(name.endswith("latest"), 0).otherwise(1))


def picked(rows: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """The picked rows; picks that no row has are left out."""
    return rows.join(picks.select(key).distinct(), key, "left_semi")


def ticked(rows: DataFrame, mode: str, caption: str = "caption") -> DataFrame:
    """``rows`` with ``picked``: "all" of them, "none", or the "captioned" ones, whose caption isn't blank."""
    if mode not in ("all", "none", "captioned"):
        raise ValueError(f"pick all, none or captioned, not {mode!r}")
    return rows.withColumn("picked", F.trim(F.coalesce(caption, F.lit(""))) != "" if mode == "captioned" else F.lit(mode == "all"))


def to_redo(plan: DataFrame, kept: DataFrame, key: str = "id") -> DataFrame:
    return plan.join(kept.select(key).distinct(), key, "left_anti")


def carried_or_all(listed: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """The listed rows that were carried over, or all of them when none was."""
    marked = listed.join(carried.select(F.col(key), F.lit(True).alias("carried")).distinct(), key, "left")
    found = marked.agg(F.coalesce(F.bool_or("carried"), F.lit(False)).alias("some"))
    return marked.join(F.broadcast(found)).where("carried OR NOT some").drop("carried", "some")  # one row


def present(results: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Results whose file is still there, and those that have none."""
    there = files.select(F.col(path).alias("there")).distinct()
    return results.join(there, F.col(path) == F.col("there"), "left").where(f"`{path}` IS NULL OR there IS NOT NULL").drop("there")


def dealt(targets: DataFrame, order: str, values: DataFrame, value_order: str) -> DataFrame:
    """Targets and values side by side in their orders, as far as both go."""
    return numbered(targets, order).join(numbered(values, value_order), "number").drop("number")


def unclashing(rows: DataFrame, stem: str, order: str, mark: str = "_") -> DataFrame:
    """``rows`` with ``free_name``: the stem, then the stem with 2, 3 and so on."""
    place = F.row_number().over(W.partitionBy(stem).orderBy(order))
    return rows.withColumn("free_name", F.when(place == 1, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit(mark), place.cast("string"))))


def version(c: Column) -> Column:
    """A version's numbers; a part without digits is 0."""
    parts = F.split(F.regexp_replace(F.trim(c), "^[vV]+", ""), r"\.")
    return F.transform(parts, lambda p: F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(p, "[^0-9]", ""), F.lit("")), F.lit("9" * 18)).cast("long"), F.lit(0).cast("long")))


def is_newer(latest: Column, current: Column) -> Column:
    return F.coalesce(version(latest) > version(current), F.lit(False))


def repo_id(c: Column) -> Column:
    """A trimmed repository id, null when it isn't valid."""
    bare = F.btrim(F.trim(c), F.lit("/"))
    return F.when(bare.rlike(REPO_ID), bare)


def installed_name(wanted: DataFrame, installed: DataFrame) -> DataFrame:
    """(value, found): the server's name for each value: separators don't count, and case only if need be."""
    plain = lambda c: F.translate(c, "\\", "/")
    left = wanted.select("value", plain(F.col("value")).alias("norm")).distinct()
    right = installed.select("name", plain(F.col("name")).alias("norm"))
    joined = left.alias("l").join(right.alias("r"), F.lower("l.norm") == F.lower("r.norm"), "left")
    rank = F.struct((F.col("l.norm") != F.col("r.norm")).alias("differs"), F.col("name"))
    return joined.groupBy("value").agg(F.min_by("name", rank).alias("found"))


def closest(value: str, installed: list[str], n: int = 3, cutoff: float = 0.5) -> list[str]:
    """The most similar names of a server's list, for a message."""
    return difflib.get_close_matches(value.replace("\\", "/"), [x.replace("\\", "/") for x in installed], n, cutoff)


def tallies(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Outcomes (``output``, ``error``) counted; an error alone makes a failure."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return outcomes.groupBy(*(by or [])).agg(F.count_if(~failed & F.col("output").isNotNull()).alias("n_done"), F.count_if(failed).alias("n_failed"))


def first_sample(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The first caption, by image, that isn't blank."""
    return pairs.where(F.trim("caption") != "").groupBy(*(by or [])).agg(F.min_by("caption", "image").alias("sample"))


def joined_set(rows: DataFrame, value: str, by: list[str] | None = None, mark: str = "/") -> DataFrame:
    """The distinct values in order, as one text; for columns of few values."""
    return rows.groupBy(*(by or [])).agg(F.array_join(F.array_sort(F.collect_set(value)), mark).alias("joined"))


def caption_fit(kind: Column, expects_tags: Column) -> Column:
    """A warning where a base model and the captions don't go together."""
    return F.when((kind == "prose") & expects_tags, "tag-trained model, prose captions").when((kind == "tags") & ~expects_tags, "prose model, tag captions").otherwise("")


def mask_union(masks: Column) -> Column:
    """One mask, array<boolean>, of an array of masks."""
    return F.aggregate(F.slice(masks, 2, 1 << 30), F.get(masks, F.lit(0)), lambda a, m: F.zip_with(a, m, lambda x, y: x | y))


def overlap_share(subject: Column, exclude: Column) -> Column:
    """How much of the excluded part lies in the subject; 0 where nothing is excluded."""
    both = F.size(F.filter(F.zip_with(subject, exclude, lambda s, e: s & e), lambda x: x))
    every = F.size(F.filter(exclude, lambda x: x))
    return F.when(every > 0, both / every).otherwise(0.0)
