"""Caption health: findings, duplicate groups, tag statistics. Frames have (ord, image, caption)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.functions import text as T

CLIP_LIMIT = 77


def flags(pairs: DataFrame, trigger: str = "", min_words: int = 2, clip_limit: int = 0) -> DataFrame:
    """One row per pair with a flag for each check; an empty caption is only empty."""
    norm, n = T.normal(F.col("caption")), F.size(T.words(F.col("caption")))
    blank = norm == ""
    lead = " ".join(trigger.split()).lower()
    return pairs.select(
        "ord", "image", norm.alias("norm"), blank.alias("empty"),
        (~blank & (n < min_words)).alias("short"),
        (~blank & (~F.startswith(norm, F.lit(lead)) if lead else F.lit(False))).alias("missing_trigger"),
        (~blank & (T.clip_tokens(F.col("caption")) > clip_limit if clip_limit > 0 else F.lit(False))).alias("too_long"),
    )


CHECKS = ("empty", "short", "missing_trigger", "too_long")


def findings(pairs: DataFrame, **options) -> DataFrame:
    """(check, ord, image), a row per finding."""
    flagged = flags(pairs, **options)
    hits = F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in CHECKS)))
    return flagged.select(F.explode(hits).alias("check"), "ord", "image")


def duplicate_groups(pairs: DataFrame) -> DataFrame:
    """(first_ord, n, preview): captions that agree after normalisation, blank ones left out."""
    norm = T.normal(F.col("caption"))
    preview = F.when(F.length("norm") <= 60, F.col("norm")).otherwise(F.concat(F.left("norm", F.lit(57)), F.lit("…")))
    # Texts are told apart by 128 bits of a digest; only these and the previews are shuffled.
    keyed = pairs.select("ord", norm.alias("norm")).where("norm <> ''").select("ord", F.unhex(F.left(F.sha2(F.col("norm").cast("binary"), 256), F.lit(32))).alias("key"), preview.alias("preview"))
    got = keyed.groupBy("key").agg(F.min("ord").alias("first_ord"), F.count(F.lit(1)).alias("n"), F.min("preview").alias("preview")).where("n > 1")
    return got.select("first_ord", "n", "preview")


def summary(pairs: DataFrame, **options) -> DataFrame:
    """One row of counts."""
    flagged = flags(pairs, **options)
    counts = flagged.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(c).alias(f"n_{c}") for c in CHECKS))
    groups = duplicate_groups(pairs).agg(F.count(F.lit(1)).alias("n_dup_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_dup_rows"))
    return counts.join(groups).withColumn("clean", F.expr(" + ".join([*(f"n_{c}" for c in CHECKS), "n_dup_groups"]) + " = 0"))


def segment_stats(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whether captions are tags: three words or fewer for a comma segment on average; a row per group."""
    parts = F.filter(F.transform(F.split(T.empty(F.col("caption")), ","), lambda x: F.size(T.words(x))), lambda n: n > 0)
    each = pairs.select(*(by or []), F.size(parts).cast("long").alias("segments"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("words"))
    got = each.groupBy(*(by or [])).agg(F.sum("segments").alias("segments"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"))
    tags = F.coalesce(F.when(F.col("segments") > 0, F.col("words") / F.col("segments") <= 3.0), F.lit(False))
    return got.select(*(by or []), "n", "segments", "words", tags.alias("tags"), F.when(F.coalesce("segments", F.lit(0)) == 0, "").when(tags, "tags").otherwise("prose").alias("kind"))


def tag_frequency(pairs: DataFrame, trigger: str = "") -> DataFrame:
    """(tag, n): in how many captions each tag is; ties are ordered by tag where an order is asked for."""
    lead = " ".join(trigger.split()).lower()
    tags = F.array_distinct(F.filter(F.transform(F.split(T.empty(F.col("caption")), ","), T.normal), lambda x: (x != "") & (x != lead)))
    return pairs.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def ubiquitous_tags(pairs: DataFrame, trigger: str = "", share: float = 0.9, least: int = 4) -> DataFrame:
    total = pairs.agg(F.count(F.lit(1)).alias("total"))
    counts = tag_frequency(pairs, trigger).join(F.broadcast(total))  # one row
    return counts.where((F.col("total") >= least) & (F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("total") * F.lit(float(share)))))).select("tag", "n")


def gated(pairs: DataFrame, trigger: str = "") -> DataFrame:
    """The summary, its token check and the ubiquitous tags only where the set holds tags."""
    captioned = pairs.where(T.squeeze(F.col("caption")) != "")
    kind = segment_stats(captioned).select("tags")
    base = flags(pairs, trigger, clip_limit=CLIP_LIMIT).join(F.broadcast(kind))  # one row
    counts = base.agg(F.count(F.lit(1)).alias("total"), F.count_if("empty").alias("n_empty"), F.count_if("short").alias("n_short"), F.count_if("missing_trigger").alias("n_missing_trigger"), F.count_if(F.col("too_long") & F.col("tags")).alias("n_too_long"))
    tags = ubiquitous_tags(captioned, trigger).join(F.broadcast(kind)).where("tags").agg(F.count(F.lit(1)).alias("n_ubiquitous"))
    return counts.join(tags).join(kind)
