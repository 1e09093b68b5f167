"""Caption and tag text as column expressions; no Python runs for any row.

White space follows Unicode and includes the ASCII separators U+001C to U+001F.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)[\s\x1c-\x1f]"
#: Emoticons whose underscores stay.
KAOMOJI = ["0_0", "(o)_(o)", "+_+", "+_-", "._.", "<o>_<o>", "<|>_<|>", "=_=", ">_<", "3_3", "6_9", ">_o", "@_@", "^_^", "o_o", "u_u", "x_x", "|_|", "||_||"]

#: What a model says before its answer, as patterns.
LEAD_INS = ["here is", "here's", "caption:", "tags:", "sure[,!.]?"]


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(empty(c), SPACE + "+"), lambda x: x != "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.array_join(words(c), " ")


def normal(c: Column) -> Column:
    return F.lower(squeeze(c))


def clip_tokens(c: Column) -> Column:
    """An estimate: 1.3 for a word, rounded up, 1 for a comma, 2 for the ends."""
    commas = F.length(empty(c)) - F.length(F.replace(empty(c), F.lit(","), F.lit("")))
    return (F.ceil(F.size(words(c)) * F.lit(1.3)) + commas + 2).cast("long")


def clean_output(c: Column) -> Column:
    """A model's raw answer without its thoughts, one lead-in and the quotes around it."""
    t = F.regexp_replace(empty(c), r"(?s)<think>.*?</think>", "")
    t = F.regexp_replace(squeeze(t), rf"^(?i)(?:{'|'.join(LEAD_INS)})\s*", "")
    return F.btrim(F.trim(t), F.lit('"'))


def tag_list(c: Column) -> Column:
    parts = F.transform(F.split(empty(c), "[,\n]"), lambda x: F.lower(squeeze(F.regexp_replace(squeeze(x), r"^\.+|\.+$", ""))))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def finalize_tags(c: Column, trigger: str) -> Column:
    """The trigger, then the other tags."""
    if not trigger:
        return F.array_join(tag_list(c), ", ")
    rest = F.filter(tag_list(c), lambda x: x != trigger.lower())
    return F.array_join(F.concat(F.array(F.lit(trigger)), rest), ", ")


def finalize_prose(c: Column, trigger: str, name: str = "", aliases: tuple[str, ...] = (), kind: str = "character") -> Column:
    """Aliases become the name; the trigger leads; the old first letter is lowered unless it starts the name."""
    named = kind == "character" and name.strip() != ""
    text = empty(c)
    for alias in aliases if named else ():
        text = F.regexp_replace(text, rf"(?i)\bthe {re.escape(alias)}\b", re.sub(r"([\\$])", r"\\\1", name))
    if not trigger:
        return text
    lowered = F.concat(F.lower(F.left(text, F.lit(1))), F.substring(text, 2, 1 << 30))
    body = F.when(text.startswith(name.split()[0]), text).otherwise(lowered) if named else lowered
    return F.when(F.lower(text).startswith(trigger.lower()), text).when(text == "", trigger).otherwise(F.concat(F.lit(f"{trigger}, "), body))


def affixes(c: Column, prefix: str, suffix: str, style: str) -> Column:
    """Fixed text before and after, by commas for tags and spaces for prose; what is empty is left out."""
    before, after = (x.strip().strip(",") for x in (prefix, suffix))
    if not before and not after:
        return empty(c)
    return F.concat_ws(", " if style in ("tags", "e621") else " ", *(F.nullif(p, F.lit("")) for p in (F.lit(before), empty(c), F.lit(after))))


def parse_drop_list(text: str) -> list[str]:
    found = (" ".join(x.split()).strip(".").lower().replace("_", " ") for x in re.split(r"[,\n]", text or ""))
    return list(dict.fromkeys(x for x in found if x))


def drop_tags(c: Column, drop: list[str], style: str) -> Column:
    """Without the listed tags; the first tag always stays; prose and an empty list change nothing."""
    if not drop or style not in ("tags", "e621"):
        return empty(c)
    parts = F.filter(F.transform(F.split(empty(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    kept = F.filter(parts, lambda x, i: (i == 0) | ~F.replace(F.lower(x), F.lit("_"), F.lit(" ")).isin(drop))
    return F.array_join(kept, ", ")


def format_tag(c: Column, keep_underscores: bool = False) -> Column:
    if keep_underscores:
        return c
    return F.when(c.isin(KAOMOJI), c).otherwise(F.replace(c, F.lit("_"), F.lit(" ")))


def slugify(c: Column, default: str = "character") -> Column:
    slug = F.btrim(F.regexp_replace(F.lower(empty(c)), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def normalize_suffix(c: Column) -> Column:
    low = F.lower(empty(c))
    return F.when(low == "", ".png").when(low == ".jpeg", ".jpg").otherwise(low)


def terms(c: Column) -> Column:
    return F.filter(F.transform(F.split(empty(c), ","), lambda x: F.trim(x)), lambda x: x != "")


def mask(c: Column) -> Column:
    return F.when(F.length(c) < 12, "********").otherwise(F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4))))


def article(c: Column) -> Column:
    return F.when(F.lower(F.left(F.trim(c), F.lit(1))).isin("a", "e", "i", "o", "u"), "an").otherwise("a")


def subject_phrase(c: Column) -> Column:
    text = F.coalesce(F.nullif(F.trim(empty(c)), F.lit("")), F.lit("subject"))
    return F.when(F.lower(F.left(text, F.lit(4))) == "the ", F.substring(text, 5, 1 << 30)).otherwise(text)


def lower_first(c: Column) -> Column:
    """With a small first letter, unless the first word has several capitals."""
    first = F.split(empty(c), " ")[0]
    return F.when(F.regexp_count(first, F.lit(r"\p{Lu}")) > 1, c).otherwise(F.concat(F.lower(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30)))
