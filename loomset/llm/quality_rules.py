"""Quality rules: how far a document's histograms are from its language's.

All of it is DataFrame expressions. A document's character classes and common words are counted; the
reference of each language is the sum over its other documents that pass the base rules; the verdict compares both
histograms with the reference by Jensen-Shannon distance, from a minimum length on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import WORD, materialize, table

#: Common function words of English, French, German and Spanish, by language.
COMMON_WORDS = list(dict.fromkeys(
    "the of and to in is that it for on with was as by at this from are be or have not "
    "la les des et une que le un est pour dans qui sur pas par du au se plus ne avec ce "
    "der die und das nicht mit den von zu ist ein eine auf dem im sich auch als an wie werden aus "
    "el los las del por con en y para su lo es al como pero sus entre cuando todo esta son sin".split()
))
#: Limits of the distances, and words that a language's other documents must hold to be a reference.
CHAR_LIMIT, WORD_LIMIT, MIN_REFERENCE = 0.25, 0.28, 2000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Character classes in the order in which they are taken out of the text; what is left is the last class.
CLASSES = {"lower": "abcdefghijklmnopqrstuvwxyz", "space": SPACES, "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "symbol": SYMBOLS, "digit": "0123456789", "punct": ".,;:!?'\"()-[]{}/\\_@+=~^`"}


def js_distance(p: Column, q: Column) -> Column:
    """The square root of the Jensen-Shannon divergence in bits, 0 to 1, of two arrays of shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    total = F.aggregate(F.zip_with(p, q, lambda a, b: term(a, b) + term(b, a)), F.lit(0.0), lambda x, y: x + y)
    return F.sqrt(F.greatest(F.lit(0.0), total / 2))


def shares(counts: Column, n: Column, rest: bool) -> Column:
    """Counts as shares of ``n``, with what they leave as one more share if ``rest``."""
    out = F.transform(counts, lambda c: c / F.greatest(F.lit(1), n))
    left = F.aggregate(counts, F.lit(0).cast("long"), lambda x, y: x + y)
    return F.concat(out, F.array(F.greatest(F.lit(0), n - left) / F.greatest(F.lit(1), n))) if rest else out


def base_counts(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row per document: the base measures, and its character-class and common-word counts."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    step = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD))
    step = step.select("id", "lang", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"), lines.alias("lines"))
    size = F.size("words")
    # A key holds the hash of a 3-word window above the window's place, so that one sort of longs brings equal windows together.
    bits = F.greatest(F.lit(1), F.ceil(F.log2(size + 1.0))).cast("int")
    word = lambda i: F.get("words", i)
    step = step.withColumn("bits", bits)
    key = lambda i: F.shiftleft(F.xxhash64(word(i), word(i + 1), word(i + 2)), 1).bitwiseAND(F.expr("shiftleft(-1L, bits)")).bitwiseOR(i.cast("long"))
    step = step.withColumn("keys", F.when(size >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), size - 3), key))).otherwise(F.expr("array(CAST(NULL AS BIGINT))")))
    step = step.withColumn(
        "again",
        F.expr(
            """CASE WHEN size(words) < 3 THEN array(CAST(NULL AS INT)) ELSE sort_array(transform(filter(keys, (k, j) ->
            coalesce(shiftright(k, bits) = shiftright(get(keys, j - 1), bits), false) OR coalesce(shiftright(k, bits) = shiftright(get(keys, j + 1), bits), false)),
            k -> CAST(k & ~shiftleft(-1L, bits) AS INT))) END"""
        ),
    )
    # Windows that share a hash by chance are told apart by their words; this runs only where windows meet at all.
    same = "struct(get(words, {0}), get(words, {0} + 1), get(words, {0} + 2))"
    step = step.withColumn("met", F.expr(f"CASE WHEN get(again, 0) IS NULL THEN array(CAST(NULL AS STRUCT<a: STRING, b: STRING, c: STRING, i: INT>)) ELSE array_sort(transform(again, i -> named_struct('a', get(words, i), 'b', get(words, i + 1), 'c', get(words, i + 2), 'i', i))) END"))
    step = step.withColumn(
        "spots",
        F.expr(
            """CASE WHEN get(met, 0) IS NULL THEN array(CAST(NULL AS INT)) ELSE sort_array(transform(filter(met, (m, j) ->
            coalesce(m.a = get(met, j - 1).a AND m.b = get(met, j - 1).b AND m.c = get(met, j - 1).c, false)
            OR coalesce(m.a = get(met, j + 1).a AND m.b = get(met, j + 1).b AND m.c = get(met, j + 1).c, false)), m -> m.i)) END"""
        ),
    )
    repeated = F.expr("CASE WHEN size(spots) = 0 OR get(spots, 0) IS NULL THEN 0L ELSE aggregate(transform(spots, (p, j) -> least(3, coalesce(get(spots, j + 1) - p, 3))), 0L, (t, x) -> t + x) END")
    found = F.filter(F.transform("words", F.lower), lambda x: x.isin(COMMON_WORDS))
    step = step.select(
        "id",
        "lang",
        "text",
        size.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"),
        # Each between spaces of its own, so that a word's count is what its removal leaves out.
        F.concat(F.lit(" "), F.array_join(found, "  "), F.lit(" ")).alias("common"),
    )
    rest = "text"
    for name, members in CLASSES.items():
        step = step.withColumn(f"rest_{name}", F.translate(rest, members, "")).withColumn(f"c_{name}", (F.length(rest) - F.length(f"rest_{name}")).cast("long"))
        rest = f"rest_{name}"
    step = step.withColumn("c_other", F.length(rest).cast("long")).withColumn("n_chars", F.length("text").cast("long"))
    counts = [((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in COMMON_WORDS]
    step = step.select("id", "lang", "n_chars", "n_words", (F.col("n_chars") - F.col("c_space")).alias("word_chars"), F.col("c_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", F.array(*(f"c_{c}" for c in [*CLASSES, "other"])).alias("chars"), F.array(*counts).alias("commons"))
    return step


def quality_rules(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 50,
    char_limit: float = CHAR_LIMIT,
    word_limit: float = WORD_LIMIT,
    min_reference: int = MIN_REFERENCE,
) -> DataFrame:
    """One row per input row: the base measures, ``base_failed``, both distances and ``kept``.

    A null text has no words and fails the base rules. A document shorter than ``min_words`` fails
    them too and gets no distance. A null language is a language of its own. A document is compared
    with the sums over the other documents of its language that pass the base rules, so that junk is no
    reference; where these hold fewer than ``min_reference`` words there is no distance, and the base rules decide. An empty table gives an
    empty result. Repeated rows count each, as references of each other too. Only the three named
    columns are read. Each document is one row throughout: nothing is exploded, and only the
    languages' histograms are aggregated.
    """
    counts = materialize(base_counts(df, id_col, text_col, lang_col), "quality-counts")
    sum_up = lambda c, k: F.array(*(F.sum(F.get(c, F.lit(i))) for i in range(k)))
    counts = counts.withColumn("failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    sums = counts.where("NOT failed").groupBy("lang").agg(sum_up("chars", len(CLASSES) + 1).alias("ref_chars"), sum_up("commons", len(COMMON_WORDS)).alias("ref_commons"), F.sum("n_words").alias("ref_words"), F.sum("n_chars").alias("ref_n"))
    joined = counts.join(sums.withColumnRenamed("lang", "ref_lang"), F.col("lang").eqNullSafe(F.col("ref_lang")), "left")
    # A language of which all documents fail has a reference of nothing.
    joined = joined.withColumns({c: F.coalesce(c, F.array_repeat(F.lit(0).cast("long"), k)) for c, k in (("ref_chars", len(CLASSES) + 1), ("ref_commons", len(COMMON_WORDS)))}).fillna(0, ["ref_words", "ref_n"])
    own = F.when(F.col("failed"), 0).otherwise(1)  # a document is in the reference, or isn't
    others = lambda ref, mine: F.zip_with(ref, mine, lambda a, b: a - own * b)
    n, words = F.col("ref_n") - own * F.col("n_chars"), F.col("ref_words") - own * F.col("n_words")
    by_char = js_distance(shares(F.col("chars"), F.col("n_chars"), False), shares(others("ref_chars", "chars"), n, False))
    by_word = js_distance(shares(F.col("commons"), F.col("n_words"), True), shares(others("ref_commons", "commons"), words, True))
    told = (F.col("n_words") >= min_words) & (words >= min_reference)
    out = joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failed").alias("base_failed"),
        F.when(told, by_char).alias("char_distance"), F.when(told, by_word).alias("word_distance"),
    )
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce((F.col("char_distance") <= char_limit) & (F.col("word_distance") <= word_limit), F.lit(True)))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op6_sql() -> str:
    """The base measures, both distances and the verdict in DuckDB SQL."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    space = r"[^\x20\x09-\x0D]"
    inner = "t"
    takes = []
    for name, members in CLASSES.items():
        chars = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)" if name == "space" else quoted(members)
        outer = f"translate({inner}, {chars}, '')"
        takes.append(f"length({inner}) - length({outer}) AS c_{name}")
        inner = outer
    names = [*CLASSES, "other"]
    chars = [f"c_{c}" for c in names]
    commons = [f"m_{i}" for i in range(len(COMMON_WORDS))]
    counts = ", ".join(f"len(list_filter(low, lambda x: x = {quoted(w)})) AS m_{i}" for i, w in enumerate(COMMON_WORDS))
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

    def distance(bins: list[str], own: str, total: str, rest: bool) -> str:
        pairs = [(f"({c} / greatest(1, {own}))", f"((s_{c} - own * {c}) / greatest(1, {total} - own * {own}))") for c in bins]
        if rest:
            used, all_used = " + ".join(bins), " + ".join(f"(s_{c} - own * {c})" for c in bins)
            pairs.append((f"(greatest(0, {own} - ({used})) / greatest(1, {own}))", f"(greatest(0, {total} - own * {own} - ({all_used})) / greatest(1, {total} - own * {own}))"))
        return "sqrt(greatest(0, (" + " + ".join(f"{term(a, b)} + {term(b, a)}" for a, b in pairs) + ") / 2))"

    sums = ", ".join(f"sum(own * {c}) OVER l AS s_{c}" for c in [*chars, *commons])
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{space}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{space}')) AS ls FROM d),
v AS (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
x AS (SELECT k, i, count(*) OVER (PARTITION BY k, ws[i], ws[i + 1], ws[i + 2]) AS n FROM v),
r AS (SELECT k, count(DISTINCT p) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM x WHERE n > 1) GROUP BY k),
c AS (SELECT k, doc_id, lang, len(ws) AS n_words, length(t) AS n, len(ls) - len(list_distinct(ls)) AS n_dup_lines, list_transform(ws, lambda x: lower(x)) AS low, {", ".join(takes)}, length({inner}) AS c_other FROM w),
b AS (SELECT * EXCLUDE (low), {counts} FROM c),
f AS (SELECT b.*, coalesce(r.n, 0) AS rep, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed, CASE WHEN n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words THEN 0 ELSE 1 END AS own FROM b LEFT JOIN r ON b.k = r.k),
s AS (SELECT *, sum(own * n) OVER l AS s_n, sum(own * n_words) OVER l AS s_words, {sums} FROM f WINDOW l AS (PARTITION BY lang)),
q AS (SELECT s.*, n_words >= 50 AND s_words - own * n_words >= {MIN_REFERENCE} AS told FROM s),
j AS (SELECT *, CASE WHEN told THEN {distance(chars, "n", "s_n", False)} END AS cd, CASE WHEN told THEN {distance(commons, "n_words", "s_words", True)} END AS wd FROM q)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words, base_failed,
round(CAST(cd AS DOUBLE), 6) AS char_distance, round(CAST(wd AS DOUBLE), 6) AS word_distance, NOT base_failed AND coalesce(cd <= {CHAR_LIMIT} AND wd <= {WORD_LIMIT}, true) AS kept
FROM j"""
