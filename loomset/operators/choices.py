"""Choices with a fallback, fields that are filled or cleared, ranges of picks, and checks, as expressions and joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T

#: Kinds of shots that show clothes, and the words before a style of one's own.
DRESSED = ("angle", "pose")
RENDERED = "Rendered as "
FORBIDDEN = r'[<>"|?*:]'


def known(value: Column, allowed: tuple[str, ...]) -> Column:
    """The trimmed, lower-case value if it is allowed, else null."""
    low = F.lower(F.trim(T.empty(value)))
    return F.when(low.isin(*allowed), low)


def shot_style(key: Column, custom: Column, styles: tuple[str, ...], default: str = "match", own: str = "custom") -> Column:
    """struct<style, phrase>: the style's key, the default for an unknown one; one's own needs a text, which makes its phrase."""
    found = F.coalesce(known(key, styles), F.lit(default))
    text = F.rtrim(T.squeeze(custom), F.lit("."))
    mine = (found == own) & (text != "")
    style = F.when((found == own) & (text == ""), F.lit(default)).otherwise(found)
    return F.struct(style.alias("style"), F.when(mine, F.concat(F.lit(RENDERED), T.lower_first(text), F.lit("."))).otherwise("").alias("phrase"))


def plan_key(dataset_type: Column) -> Column:
    """The plan of a dataset's type: none (null) for styles; a type that isn't known is a character."""
    return F.when(dataset_type == "style", F.lit(None).cast("string")).when(dataset_type == "concept", "concept").otherwise("character")


def planned(rows: DataFrame, dataset_type: str, plans: DataFrame, plan: str = "plan") -> DataFrame:
    """The rows with the shots of their plan; rows without a plan have none."""
    return rows.withColumn("_plan", plan_key(F.col(dataset_type))).join(plans.withColumnRenamed(plan, "_of"), F.col("_plan") == F.col("_of")).drop("_plan", "_of")


def preset(rows: DataFrame, trainer: str, key: str, presets: DataFrame) -> DataFrame:
    """The rows with their trainer's preset of that key, else its first; ``presets`` has (of, name, ord, value)."""
    firsts = presets.groupBy("of").agg(F.min_by("value", "ord").alias("first_value"))
    exact = presets.select(F.col("of").alias("of_exact"), F.col("name").alias("name_exact"), F.col("value").alias("exact"))
    found = rows.join(firsts, F.col(trainer) == F.col("of"), "left").join(exact, (F.col(trainer) == F.col("of_exact")) & (F.col(key) == F.col("name_exact")), "left")
    return found.withColumn("preset", F.coalesce("exact", "first_value")).drop("of", "first_value", "of_exact", "name_exact", "exact")


def filled(current: Column, incoming: Column) -> Column:
    """The trimmed current value, or the incoming one where nothing is there."""
    return F.coalesce(F.nullif(F.trim(T.empty(current)), F.lit("")), incoming)


def cleared(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.lit("") for c in columns})


def dressed(shots: DataFrame, outfits: DataFrame, key: str = "id") -> DataFrame:
    """All shots; those of kinds that show clothes take their outfit by id, where one is dealt to them."""
    given = outfits.select(F.col(key).alias("_id"), F.col("outfit").alias("_outfit"))
    fit = F.col("kind").isin(*DRESSED) & F.col("_outfit").isNotNull()
    return shots.join(given, F.col(key) == F.col("_id"), "left").withColumn("outfit", F.when(fit, F.col("_outfit")).otherwise(T.empty(F.col("outfit")))).drop("_id", "_outfit")


def output_folder(path: Column) -> Column:
    """A folder's path without quotes around it; null for one that is empty or that some system can't create."""
    raw = F.btrim(F.trim(T.empty(path)), F.lit('"'))
    tail = F.when(F.substring(raw, 2, 1) == ":", F.substring(raw, 3, 1 << 30)).otherwise(raw)
    return F.when((raw != "") & ~tail.rlike(FORBIDDEN) & ~raw.rlike(r"[\x00-\x1f]"), raw)


def picker_label(label: Column, is_picked: Column, on: str = "✅", off: str = "⬜") -> Column:
    return F.concat(F.when(is_picked, on).otherwise(off), F.lit(" "), label)


def range_picked(rows: DataFrame, order: str, one: int, other: int) -> DataFrame:
    """The rows from one place to the other, whichever comes first."""
    return rows.where(F.col(order).between(min(one, other), max(one, other)))


def report(checks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(all_ok, n_missing): whether all checks (``name``, ``ok``) are, and how many aren't; no checks are all right."""
    return checks.groupBy(*(by or [])).agg(F.coalesce(F.every("ok"), F.lit(True)).alias("all_ok"), F.count_if(~F.col("ok")).alias("n_missing"))


def missing(wanted: DataFrame, installed: DataFrame, name: str = "name") -> DataFrame:
    """What is wanted and isn't there, each once."""
    return wanted.select(name).distinct().join(installed.select(name).distinct(), name, "left_anti")


def type_differs(recorded: Column, selected: Column) -> Column:
    """Whether a dataset's recorded type, if any, isn't the selected one."""
    return (T.empty(recorded) != "") & (T.empty(recorded) != T.empty(selected))


def caption_steps(c: Column, style: str, trigger: str = "", name: str = "", aliases: tuple[str, ...] = (), kind: str = "character", drop: str = "", prefix: str = "", suffix: str = "") -> Column:
    """A caption's whole way: finished for its style, noisy tags dropped, then what comes before and after it."""
    tags = style in ("tags", "e621")
    done = T.finalize_tags(c, trigger) if tags else T.finalize_prose(c, trigger, name, aliases, kind)
    return reduce(lambda x, step: step(x), (lambda x: T.drop_tags(x, T.parse_drop_list(drop), style), lambda x: T.affixes(x, prefix, suffix, style)), done)
