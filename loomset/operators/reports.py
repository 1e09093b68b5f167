"""Reports as Markdown text, written by the driver from a few rows of aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.functions import messages
from loomset.operators import lint, stats

SHOWN_NAMES, SHOWN_GROUPS, SHOWN_ASPECTS = 8, 5, 4
TITLES = {"empty": "empty", "missing_trigger": "without the trigger", "short": "very short", "too_long": f"likely over {lint.CLIP_LIMIT} tokens"}


def _more(total: int, shown: int) -> str:
    return f" (+{total - shown} more)" if total > shown else ""


def lint_report(pairs: DataFrame, trigger: str = "") -> str:
    """Findings with their first names, the first groups of equal captions, and tags on nearly every image.

    Only the names that are shown come to the driver: ranks and totals are found by window functions.
    """
    captioned = pairs.where(F.trim("caption") != "").select("caption")
    tagged = bool(lint.segment_stats(captioned).first().tags)
    found = lint.findings(pairs, trigger=trigger, clip_limit=lint.CLIP_LIMIT if tagged else 0)
    totals = {r["check"]: r["count"] for r in found.groupBy("check").count().collect()}
    ranked = found.withColumn("place", F.row_number().over(W.partitionBy("check").orderBy("ord"))).where(F.col("place") <= SHOWN_NAMES)
    names: dict[str, list[str]] = {}
    for r in ranked.orderBy("check", "ord").collect():
        names.setdefault(r["check"], []).append(r["image"])
    lines = [f"- **{totals[c]} {title}:** {', '.join(names[c])}{_more(totals[c], SHOWN_NAMES)}" for c, title in TITLES.items() if c in totals]
    groups = lint.duplicate_groups(pairs)
    n_groups = groups.count()
    if n_groups:
        first = [f"{r.n} × “{r.preview}”" for r in groups.orderBy("first_ord").limit(SHOWN_GROUPS).collect()]
        lines.append(f"- **{n_groups} group(s) of equal captions:** {'; '.join(first)}{_more(n_groups, SHOWN_GROUPS)}")
    total = pairs.count()
    out = [f"**Captions** ({total}):", *lines] if lines else [f"**Captions:** {total}, no findings."]
    if tagged:
        tags = lint.ubiquitous_tags(captioned, trigger)
        n_tags = tags.count()
        first = [f"`{r.tag}` ×{r.n}" for r in tags.orderBy(F.desc("n"), "tag").limit(SHOWN_NAMES).collect()]
        if first:
            out.append(f"**Tags on nearly every image:** {', '.join(first)}{_more(n_tags, SHOWN_NAMES)}")
    return "\n".join(out)


def failure_report(results: DataFrame, kind: str = "images") -> str:
    """What went through and what didn't (``name``, ``error``; an empty or null error is none), the first failures with a hint; "" for no results."""
    failed = results.where(F.coalesce("error", F.lit("")) != "")
    n, total = failed.count(), results.count()
    if not total:
        return ""
    lines = [f"**{total - n} of {total} {kind}** done" + (f", {n} failed:" if n else ".")]
    shown = failed.select("name", messages.shortened(messages.plain(F.col("error"))).alias("error"), messages.failure_hint(F.col("error")).alias("hint")).orderBy("name").limit(SHOWN_NAMES)
    lines += [f"- **{r.name}:** {r.error} ({r.hint})" for r in shown.collect()]
    return "\n".join([*lines, *([_more(n, SHOWN_NAMES).strip()] if n > SHOWN_NAMES else [])])


def check_report(checks: DataFrame, title: str) -> str:
    """Checks (``name``, ``ok``, ``detail``) line by line, and what they come to; a check that doesn't apply (null) is neither right nor wrong."""
    rows = checks.select("name", "ok", F.coalesce("detail", F.lit("")).alias("detail")).orderBy("name").collect()  # a line for each
    marks = {True: "[ok]  ", False: "[FAIL]", None: "[--]  "}
    wrong = sum(r.ok is False for r in rows)
    return "\n".join([title, "", *(f"  {marks[r.ok]} {r.name:<14} {r.detail}".rstrip() for r in rows), "", f"{wrong} to be mended" if wrong else "all right"])


def stats_report(images: DataFrame) -> str:
    s = stats.dataset_stats(images).first()
    if not s.n_images:
        return "No images."
    shapes = stats.aspect_histogram(images).orderBy(F.desc("n"), "aspect").limit(SHOWN_ASPECTS).collect()
    lines = [f"**{s.n_images} images** ({s.n_captioned} with captions)", f"Long side: {s.min_long_side}–{s.max_long_side}px", "Aspect ratios: " + ", ".join(f"{r.aspect} ×{r.n}" for r in shapes), f"Suggested steps: **{s.suggested_steps}**"]
    if s.n_captioned < s.n_images:
        lines.append(f"{s.n_images - s.n_captioned} image(s) without a caption file train with an empty caption.")
    return "  \n".join(lines)
