"""The queries of the captioned-dataset operators on the driver's tables, and their SQL.

Stand-ins: documents are prose captions, parts are tag captions, labels are sidecars, embeddings are
scored labels and 8 x 8 grids of luminance, parts' numbers are image sizes.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import messages
from loomset.functions import text as T
from loomset.operators import answers, asof, captioning, choices, dedupe, export, lint, masks, quality, selection, stats, tags
from loomset.plans import files as plan_files
from loomset.plans import generation, shots
from loomset.streaming.incremental import caption_stream

QUERIES: dict = {}
SQL: dict[str, str] = {}
TRIGGER = "the"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("image"), F.col("text").alias("caption"), "lang")


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("image"), F.concat_ws(", ", "p_name", "p_brand", "p_type").alias("caption"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    category = F.when(F.col("idx") % 8 == 7, 9).when(F.col("idx") % 4 == 1, 4).when(F.col("idx") % 16 == 2, 7).otherwise(0)
    return rows.select(F.col("vec_id").alias("image"), "idx", F.concat(F.lit("tag_"), F.col("idx").cast("string")).alias("name"), category.alias("category"), ((F.col("v").cast("double") + 1) / 2).alias("prob"))


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) * 127.5).alias("grid"))


def _pixels(test) -> Column:
    """``test`` of value and place for each of the 64 pixels of an embedding; a pixel that isn't there is null."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: test(F.get("embedding", i), i))


def _limit(x: float) -> Column:
    """A limit as a float, as SQL's decimal literals become beside floats; a double lies beside the float of the same digits."""
    return F.lit(x).cast("float")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.select("p_partkey", (F.col("p_size") * 32 + 64).cast("int").alias("w"), (F.col("p_partkey") % 37 * 40 + 100).cast("int").alias("h"), (F.col("p_partkey") % 3 > 0).alias("has_caption"))


def _sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id", "left").select("doc_id", "source", F.when(F.col("quality") == 1, "yes").when(F.col("quality") == 0, " ").alias("caption"))


WS = r"[\s\x0b\x0c\x1c-\x1f]+"
WORDS = "list_filter(regexp_split_to_array({c}, '" + WS + "'), lambda x: x <> '')"


def w(c: str) -> str:
    return WORDS.format(c=c)


def norm(c: str) -> str:
    return f"lower(array_to_string({w(c)}, ' '))"


PROSE = "p AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS image, text AS caption, lang FROM documents)"
TAGGED = "p AS (SELECT p_partkey AS ord, CAST(p_partkey AS VARCHAR) AS image, concat_ws(', ', p_name, p_brand, p_type) AS caption FROM part)"
TOKENS = f"(CAST(ceil(len({w('caption')}) * CAST(1.3 AS DOUBLE)) AS BIGINT) + (length(caption) - length(replace(caption, ',', ''))) + 2)"
FLAGS = f"f AS (SELECT *, {norm('caption')} AS norm, len({w('caption')}) AS nw FROM p), g AS (SELECT *, norm = '' AS empty, norm <> '' AND nw < 2 AS short, norm <> '' AND NOT starts_with(norm, '{TRIGGER}') AS missing_trigger FROM f)"
GROUPS = "d AS (SELECT min(ord) AS first_ord, count(*) AS n, norm FROM g WHERE norm <> '' GROUP BY norm HAVING count(*) > 1)"


@query(f"WITH {PROSE}, {FLAGS}, {GROUPS} SELECT count(*) AS total, count(*) FILTER (WHERE empty) AS n_empty, count(*) FILTER (WHERE short) AS n_short, count(*) FILTER (WHERE missing_trigger) AS n_missing_trigger, CAST(0 AS BIGINT) AS n_too_long, (SELECT count(*) FROM d) AS n_dup_groups, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM d) AS n_dup_rows, count(*) FILTER (WHERE empty OR short OR missing_trigger) + (SELECT count(*) FROM d) = 0 AS clean FROM g")
def caption_lint_summary(spark, sf_dir):
    return lint.summary(_prose(spark, sf_dir), trigger=TRIGGER)


@query(f"WITH {PROSE}, {FLAGS} SELECT 'empty' AS \"check\", ord, image FROM g WHERE empty UNION ALL SELECT 'short', ord, image FROM g WHERE short UNION ALL SELECT 'missing_trigger', ord, image FROM g WHERE missing_trigger")
def caption_lint_findings(spark, sf_dir):
    return lint.findings(_prose(spark, sf_dir), trigger=TRIGGER)


@query(f"WITH {PROSE}, {FLAGS}, {GROUPS} SELECT first_ord, n, CASE WHEN length(norm) <= 60 THEN norm ELSE left(norm, 57) || '…' END AS preview FROM d")
def duplicate_caption_groups(spark, sf_dir):
    return lint.duplicate_groups(_prose(spark, sf_dir))


def _kind_sql(source: str, by: str) -> str:
    return f"WITH {source}, s AS (SELECT {by} unnest(string_split(caption, ',')) AS seg FROM p), n AS (SELECT {by} len({w('seg')}) AS k FROM s) SELECT {by} (SELECT count(*) FROM p{' q WHERE q.lang = n.lang' if by else ''}) AS n, count(*) AS segments, CAST(sum(k) AS BIGINT) AS words, avg(k) <= 3.0 AS tags, CASE WHEN avg(k) <= 3.0 THEN 'tags' ELSE 'prose' END AS kind FROM n WHERE k > 0{' GROUP BY lang' if by else ''}"


@query(_kind_sql(PROSE, "lang,"))
def caption_kind(spark, sf_dir):
    return lint.segment_stats(_prose(spark, sf_dir), ["lang"])


@query(_kind_sql(TAGGED, ""))
def caption_kind_of_tags(spark, sf_dir):
    return lint.segment_stats(_tagged(spark, sf_dir))


FREQ = f"t AS (SELECT DISTINCT ord, {norm('seg')} AS tag FROM (SELECT ord, unnest(string_split(caption, ',')) AS seg FROM p)), q AS (SELECT tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY tag)"


@query(f"WITH {TAGGED}, {FREQ} SELECT tag, n FROM q")
def tag_frequency(spark, sf_dir):
    return lint.tag_frequency(_tagged(spark, sf_dir))


@query(f"WITH {TAGGED}, {FREQ} SELECT tag, n FROM q WHERE n >= greatest(2, ceil((SELECT count(*) FROM p) * CAST(0.02 AS DOUBLE)))")
def ubiquitous_tags(spark, sf_dir):
    return lint.ubiquitous_tags(_tagged(spark, sf_dir), share=0.02)


def _gated_sql(source: str) -> str:
    return f"WITH {source}, {FLAGS}, {FREQ}, n AS (SELECT len({w('seg')}) AS k FROM (SELECT unnest(string_split(caption, ',')) AS seg FROM p)), a AS (SELECT avg(k) <= 3.0 AS tags FROM n WHERE k > 0) SELECT count(*) AS total, count(*) FILTER (WHERE empty) AS n_empty, count(*) FILTER (WHERE short) AS n_short, CAST(0 AS BIGINT) AS n_missing_trigger, count(*) FILTER (WHERE {TOKENS} > 77 AND (SELECT tags FROM a)) AS n_too_long, (SELECT count(*) FROM q WHERE (SELECT tags FROM a) AND n >= greatest(2, ceil((SELECT count(*) FROM p) * CAST(0.9 AS DOUBLE)))) AS n_ubiquitous, (SELECT tags FROM a) AS tags FROM g"


@query(_gated_sql(TAGGED))
def analyze_gated_tags(spark, sf_dir):
    return lint.gated(_tagged(spark, sf_dir))


@query(_gated_sql(PROSE))
def analyze_gated_prose(spark, sf_dir):
    return lint.gated(_prose(spark, sf_dir))


@query(f"WITH {PROSE} SELECT ord, {TOKENS} AS tokens FROM p")
def clip_token_estimate(spark, sf_dir):
    return _prose(spark, sf_dir).select("ord", T.clip_tokens(F.col("caption")).alias("tokens"))


def _raw_output() -> Column:
    k = F.col("turn") % 3
    return F.when(k == 0, F.concat(F.lit("<think>a\nb</think> Here is "), F.col("text"))).when(k == 1, F.concat(F.lit('Caption: "'), F.col("text"), F.lit('"'))).otherwise(F.concat(F.lit("Sure,  "), F.col("text")))


@query(
    f"""WITH r AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '<think>a' || chr(10) || 'b</think> Here is ' || text WHEN 1 THEN 'Caption: "' || text || '"' ELSE 'Sure,  ' || text END AS raw FROM conversations),
    a AS (SELECT conv_id, turn, array_to_string({w("regexp_replace(raw, '<think>.*?</think>', '', 'gs')")}, ' ') AS t FROM r)
    SELECT conv_id, turn, trim(trim(regexp_replace(t, '^(here is|here''s|caption:|tags:|sure[,!.]?)\\s*', '', 'i')), '"') AS cleaned FROM a"""
)
def clean_output(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_output(_raw_output()).alias("cleaned"))


TAGLIST = f"list_filter(list_transform(string_split(upper(caption) || '., ' || caption, ','), lambda x: lower(array_to_string({w('trim(array_to_string(' + w('x') + ', chr(32)), chr(46))')}, ' '))), lambda x: x <> '')"
DEDUP = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"


@query(f"WITH {TAGGED}, l AS (SELECT ord, {TAGLIST} AS l FROM p), d AS (SELECT ord, list_filter({DEDUP.format(l='l')}, lambda x: x <> 'brand#1') AS t FROM l) SELECT ord, array_to_string(list_concat(['Brand#1'], t), ', ') AS caption FROM d")
def finalize_tags(spark, sf_dir):
    p = _tagged(spark, sf_dir)
    return p.select("ord", T.finalize_tags(F.concat(F.upper("caption"), F.lit("., "), F.col("caption")), "Brand#1").alias("caption"))


@query("SELECT doc_id, CASE WHEN starts_with(lower(t), 'zq style') THEN t WHEN t = '' THEN 'zq style' ELSE 'zq style, ' || CASE WHEN starts_with(t, 'Ana') THEN t ELSE lower(left(t, 1)) || substr(t, 2) END END AS caption FROM (SELECT doc_id, text AS t FROM documents)")
def finalize_prose(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", T.finalize_prose(F.col("text"), "zq style", "Ana Nova", ("qqzz",)).alias("caption"))


@query(f"WITH {TAGGED} SELECT ord, array_to_string(list_filter(list_filter(list_transform(string_split(caption, ','), lambda x: trim(x)), lambda x: x <> ''), lambda x, i: i = 1 OR replace(lower(x), '_', ' ') NOT IN ('brand#11', 'promo', 'economy')), ', ') AS caption FROM p")
def drop_tags(spark, sf_dir):
    return _tagged(spark, sf_dir).select("ord", T.drop_tags(F.col("caption"), T.parse_drop_list("Brand#11., PROMO\neconomy"), "tags").alias("caption"))


@query(f"WITH {TAGGED} SELECT ord, 'score_9, ' || caption || ', end' AS tags, 'score_9 ' || caption || ' end' AS prose FROM p")
def affixes(spark, sf_dir):
    c = F.col("caption")
    return _tagged(spark, sf_dir).select("ord", T.affixes(c, " score_9,", ",end ", "tags").alias("tags"), T.affixes(c, "score_9", "end", "prose").alias("prose"))


LABELS = "l AS (SELECT vec_id AS image, i - 1 AS idx, 'tag_' || (i - 1) AS name, CASE WHEN (i - 1) % 8 = 7 THEN 9 WHEN (i - 1) % 4 = 1 THEN 4 WHEN (i - 1) % 16 = 2 THEN 7 ELSE 0 END AS category, (CAST(embedding[i] AS DOUBLE) + 1) / 2 AS prob FROM embeddings, range(1, 65) r(i))"


@query(f"WITH {LABELS}, s AS (SELECT *, CASE WHEN category = 0 AND prob >= 0.6 THEN 0 WHEN category = 4 AND prob >= 0.65 THEN 1 END AS rk FROM l) SELECT image, string_agg(name, ',' ORDER BY rk, prob DESC, idx) AS tags FROM s WHERE rk IS NOT NULL GROUP BY image")
def select_tags(spark, sf_dir):
    return tags.select_tags(_labels(spark, sf_dir), 0.6, 0.65).select("image", F.array_join("tags", ",").alias("tags"))


@query(f"WITH {LABELS} SELECT image, name AS rating FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY prob DESC, idx) AS rn FROM l WHERE category = 9) WHERE rn = 1")
def select_rating(spark, sf_dir):
    return tags.select_rating(_labels(spark, sf_dir))


@query(f"WITH {LABELS}, s AS (SELECT *, CASE WHEN category = 0 AND prob >= 0.6 THEN 0 WHEN category = 4 AND prob >= 0.65 THEN 1 END AS rk FROM l), a AS (SELECT image, rk, prob, idx, name FROM s WHERE rk IS NOT NULL UNION ALL SELECT image, 2, 0, 0, name FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY prob DESC, idx) AS rn FROM l WHERE category = 9) WHERE rn = 1) SELECT image, string_agg(replace(name, '_', ' '), ', ' ORDER BY rk, prob DESC, idx) AS caption FROM a GROUP BY image")
def tag_captions(spark, sf_dir):
    return tags.tag_captions(_labels(spark, sf_dir), 0.6, 0.65, rating=True)


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '^_^' ELSE replace(replace(p_name, ' ', '_'), '_', ' ') END AS tag, coalesce(nullif(trim(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'character') AS slug, CASE p_partkey % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.webp' ELSE '.png' END AS suffix FROM part")
def tag_slug_suffix(spark, sf_dir):
    key = F.col("p_partkey")
    raw = F.when(key % 5 == 0, "^_^").otherwise(F.replace("p_name", F.lit(" "), F.lit("_")))
    suffix = F.when(key % 4 == 0, ".JPEG").when(key % 4 == 1, "").when(key % 4 == 2, ".WebP").otherwise(".PNG")
    return _t(spark, sf_dir, "part").select("p_partkey", T.format_tag(raw).alias("tag"), T.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.normalize_suffix(suffix).alias("suffix"))


SIDECARS = "s AS (SELECT d.doc_id, source, CASE quality WHEN 1 THEN 'ready' WHEN 0 THEN 'empty' ELSE 'missing' END AS status FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {SIDECARS} SELECT doc_id, status FROM s")
def sidecar_status(spark, sf_dir):
    return _sidecars(spark, sf_dir).select("doc_id", export.status(F.col("caption")).alias("status"))


@query(f"WITH {SIDECARS} SELECT count(*) FILTER (WHERE status = 'ready') AS n_ready, count(*) FILTER (WHERE status = 'empty') AS n_empty, count(*) FILTER (WHERE status = 'missing') AS n_missing FROM s")
def export_counts(spark, sf_dir):
    return export.counts(sidecar_status(spark, sf_dir))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, sf_dir):
    return export.without_done(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), "doc_id")


@query(f"WITH {SIDECARS}, n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS number FROM s WHERE status = 'ready') SELECT doc_id, number, CASE WHEN number < 10 THEN '0' ELSE '' END || number || '.png' AS file_name FROM n")
def export_numbering(spark, sf_dir):
    ready = _sidecars(spark, sf_dir).where(export.status(F.col("caption")) == "ready").select("doc_id")
    return export.numbered(ready, "doc_id").select("doc_id", "number", export.file_name(F.col("number"), F.lit(".png")).alias("file_name"))


SIZES = "z AS (SELECT p_partkey, CAST(p_size * 32 + 64 AS INT) AS w, CAST(p_partkey % 37 * 40 + 100 AS INT) AS h, p_partkey % 3 > 0 AS has_caption FROM part)"


@query(f"WITH {SIZES} SELECT count(*) AS n_images, count(*) FILTER (WHERE has_caption) AS n_captioned, coalesce(min(greatest(w, h)), 0) AS min_long_side, coalesce(max(greatest(w, h)), 0) AS max_long_side, CAST(greatest(1000, least(4000, count(*) * 75)) AS BIGINT) AS suggested_steps, CAST(greatest(1, round_even(400.0 / count(*), 0)) AS BIGINT) AS num_repeats FROM z")
def dataset_stats(spark, sf_dir):
    return stats.dataset_stats(_sizes(spark, sf_dir))


@query(f"WITH {SIZES}, k(rk, label, r) AS (VALUES (0, '3:2', CAST(1.5 AS DOUBLE)), (1, '4:3', CAST(4 AS DOUBLE) / 3), (2, '16:9', CAST(16 AS DOUBLE) / 9), (3, '2:3', CAST(2 AS DOUBLE) / 3), (4, '3:4', CAST(0.75 AS DOUBLE)), (5, '9:16', CAST(9 AS DOUBLE) / 16)), n AS (SELECT p_partkey, CASE WHEN w = h THEN 'square' ELSE label END AS aspect, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(CAST(w AS DOUBLE) / h - r), rk) AS rn FROM z, k) SELECT aspect, count(*) AS n FROM n WHERE rn = 1 GROUP BY aspect")
def aspect_histogram(spark, sf_dir):
    return stats.aspect_histogram(_sizes(spark, sf_dir))


@query(f"WITH {SIZES} SELECT p_partkey, array_to_string(CASE WHEN len(b) = 0 THEN [896] ELSE list_sort(b) END, ',') AS buckets FROM (SELECT p_partkey, list_filter([512, 768, 896], lambda x: x <= least(896, greatest(w, h))) AS b FROM z)")
def bucket_ladder(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", F.array_join(stats.buckets(F.lit(896), F.greatest("w", "h")), ",").alias("buckets"))


BITS = "h AS (SELECT vec_id, CAST(sum(CASE WHEN embedding[r * 8 + c + 1] < embedding[r * 8 + c + 2] THEN CAST(1 AS BIGINT) << CAST(55 - (r * 7 + c) AS BIGINT) ELSE 0 END) AS BIGINT) AS hash FROM embeddings, range(0, 8) a(r), range(0, 7) b(c) GROUP BY vec_id)"


def _hashes(spark, sf_dir):
    return _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), dedupe.difference_hash(F.col("embedding"), 8, 8).alias("hash"))


@query(f"WITH {BITS} SELECT vec_id AS ord, hash FROM h")
def difference_hash(spark, sf_dir):
    return _hashes(spark, sf_dir)


@query(f"WITH {BITS}, c AS (SELECT hash, min(vec_id) AS ord, count(*) AS n FROM h GROUP BY hash) SELECT a.ord AS a, a.n AS n_a, b.ord AS b, b.n AS n_b, CAST(bit_count(xor(a.hash, b.hash)) AS INT) AS distance FROM c a JOIN c b ON a.ord < b.ord AND bit_count(xor(a.hash, b.hash)) <= 12")
def near_duplicate_pairs(spark, sf_dir):
    return dedupe.near_pairs(_hashes(spark, sf_dir), 12, 56)


@query(
    f"""WITH RECURSIVE {BITS}, near AS (SELECT a.vec_id AS a, list(b.vec_id) AS bs FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 14 GROUP BY a.vec_id),
    every AS (SELECT vec_id AS v, coalesce(bs, []) AS bs FROM h LEFT JOIN near ON vec_id = a),
    greedy AS (SELECT v AS seed, list_concat([v], bs) AS own, list_concat([v], bs) AS taken FROM every WHERE v = (SELECT min(v) FROM every)
    UNION ALL SELECT v, own, list_concat(taken, own) FROM (SELECT e.v, list_filter(list_concat([e.v], e.bs), lambda x: NOT list_contains(g.taken, x)) AS own, g.taken, row_number() OVER (ORDER BY e.v) AS rn FROM greedy g JOIN every e ON NOT list_contains(g.taken, e.v)) WHERE rn = 1)
    SELECT seed, unnest(own) AS member FROM greedy WHERE len(own) > 1"""
)
def near_duplicate_groups(spark, sf_dir):
    return dedupe.near_groups(_hashes(spark, sf_dir), 14, 56)


GRID = "g AS (SELECT vec_id, i, (CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5 AS v FROM embeddings, range(0, 64) r(i))"


@query(f"WITH {GRID}, m AS (SELECT vec_id, avg(v) AS mean, stddev_pop(v) AS std FROM g GROUP BY vec_id) SELECT vec_id, round(mean, 6) AS mean, round(std, 6) AS std, concat_ws(', ', CASE WHEN mean <= 120 THEN 'dark' WHEN mean >= 135 THEN 'bright' END, CASE WHEN std <= 60 THEN 'low contrast' END) AS flags FROM m")
def exposure_flags(spark, sf_dir):
    g = _grid(spark, sf_dir).withColumns({"mean": quality.mean_luminance(F.col("grid")), "std": quality.contrast(F.col("grid"))})
    return g.select("vec_id", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.array_join(quality.exposure_flags(F.col("mean"), F.col("std"), 120, 135, 60), ", ").alias("flags"))


def _laplace(where: str) -> str:
    at = lambda r, c: f"JOIN g {{0}} ON {{0}}.vec_id = x.vec_id AND {{0}}.i = {r} * 8 + {c}"
    near = [("u", at("((x.i // 8 + 7) % 8)", "(x.i % 8)")), ("d", at("((x.i // 8 + 1) % 8)", "(x.i % 8)")), ("l", at("(x.i // 8)", "((x.i % 8 + 7) % 8)")), ("q", at("(x.i // 8)", "((x.i % 8 + 1) % 8)"))]
    return f"WITH {GRID} SELECT x.vec_id, round(var_pop(u.v + d.v + l.v + q.v - 4 * x.v), 4) AS score FROM g x {' '.join(t.format(n) for n, t in near)} {where} GROUP BY x.vec_id"


@query(_laplace("WHERE x.i // 8 BETWEEN 1 AND 6 AND x.i % 8 BETWEEN 1 AND 6"))
def laplacian_valid(spark, sf_dir):
    return _grid(spark, sf_dir).select("vec_id", F.round(quality.laplacian_valid(F.col("grid"), 8, 8), 4).alias("score"))


@query(_laplace(""))
def laplacian_wrap(spark, sf_dir):
    return _grid(spark, sf_dir).select("vec_id", F.round(quality.laplacian_wrap(F.col("grid"), 8, 8), 4).alias("score"))


@query(f"WITH {GRID} SELECT vec_id, CAST(min(i // 8) AS BIGINT) AS top, CAST(min(i % 8) AS BIGINT) AS \"left\", CAST(max(i // 8) + 1 AS BIGINT) AS bottom, CAST(max(i % 8) + 1 AS BIGINT) AS \"right\" FROM g WHERE abs(v - 127.5) > 30 GROUP BY vec_id")
def content_box(spark, sf_dir):
    box = quality.content_box(F.col("grid"), 8, 127.5, 30.0)
    return _grid(spark, sf_dir).select("vec_id", box.alias("box")).where("box IS NOT NULL").select("vec_id", *(F.col(f"box.{c}").cast("long").alias(c) for c in ("top", "left", "bottom", "right")))


@query(f"WITH {SIZES} SELECT p_partkey, CASE WHEN greatest(w, h) < 800 THEN 'long side ' || greatest(w, h) || 'px < target 800px' WHEN p_partkey % 2 = 0 THEN 'lossy source format' WHEN p_partkey % 5 < 2 THEN 'low sharpness (blur/grain)' ELSE '' END AS reason, CAST(round_even(w * (CAST(800 AS DOUBLE) / greatest(w, h)), 0) AS INT) AS new_w, CAST(round_even(h * (CAST(800 AS DOUBLE) / greatest(w, h)), 0) AS INT) AS new_h FROM z")
def restore_and_resize(spark, sf_dir):
    z, key = _sizes(spark, sf_dir), F.col("p_partkey")
    new_w, new_h = quality.resized(F.col("w"), F.col("h"), 800)
    ext, sharp = F.when(key % 2 == 0, ".JPG").otherwise(".png"), F.when(key % 5 < 2, 119.0).otherwise(120.0)
    return z.select("p_partkey", quality.restore_reason(F.greatest("w", "h"), ext, sharp, 800).alias("reason"), new_w.alias("new_w"), new_h.alias("new_h"))


@query("SELECT c.conv_id, c.turn, p.role AS parent_role, CASE WHEN c.turn > 0 THEN 1 ELSE 0 END AS wave FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1")
def chain_lookup(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("/"), t.cast("string"))
    todo = c.select("conv_id", "turn", name(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).otherwise("").alias("chain_from"))
    done = c.select(name(F.col("turn")).alias("id"), F.col("role").alias("path"))
    return shots.chained(todo, done).select("conv_id", "turn", F.col("parent_path").alias("parent_role"), "wave")


@query("SELECT o_orderkey, o_orderstatus, 'old' AS origin FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'R', 'new' FROM orders WHERE o_orderkey % 3 = 0")
def upsert_results(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    redone = orders.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("R").alias("o_orderstatus"), F.lit("new").alias("origin"))
    return export.upsert(orders.withColumn("origin", F.lit("old")), redone, "o_orderkey")


@query("SELECT event_type AS model, count(*) AS n, round(count(*) * CASE event_type WHEN 'click' THEN 0.0007 WHEN 'view' THEN 0.0002 ELSE 0.001 END, 6) AS cost FROM events GROUP BY event_type")
def caption_cost(spark, sf_dir):
    return export.priced(_t(spark, sf_dir, "events"), "event_type", {"click": 0.0007, "view": 0.0002}, 0.001).withColumn("cost", F.round("cost", 6))


@query("WITH b AS (SELECT user_id, 0 AS part, min(event_id) AS spot FROM events WHERE event_type = 'view' GROUP BY user_id UNION ALL SELECT user_id, 1, min(event_id) FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, part, spot FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY part) AS rn FROM b) WHERE rn = 1")
def merge_carry(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return export.ordered_union(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), "user_id", "event_id").withColumnRenamed("at", "spot")


@query("SELECT conv_id, turn, coalesce(lag(turn) OVER w, turn) AS prev, coalesce(lead(turn) OVER w, turn) AS next, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS \"of\" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def prev_next_position(spark, sf_dir):
    return export.neighbours(_t(spark, sf_dir, "conversations"), "conv_id", "turn")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'a pose' ELSE 'wearing ' || p_type END || CASE WHEN p_size % 2 = 0 THEN ', wearing ' || p_type ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ', without any bags or carried accessories' END AS local_prompt, 'A shot, wearing ' || p_type || '. Keep the same face. Show only the character and the clothing worn on their body — do not include any backpacks, bags, straps, held objects, tools, props, or accessories that appear in the reference image.' AS cloud_prompt FROM part")
def shot_prompts(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    plan = part.select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "angle").otherwise("pose").alias("kind"), F.when(F.col("p_size") % 2 == 0, "a pose").otherwise(F.concat(F.lit("wearing "), F.col("p_type"))).alias("local_prompt"), F.lit("A shot. Keep the same face.").alias("cloud_prompt"), F.col("p_type").alias("outfit"))
    done = shots.without_props(shots.with_wardrobe(shots.clean_plan(plan)))
    return done.select(F.col("id").cast("long").alias("p_partkey"), "local_prompt", "cloud_prompt")


@query(
    """WITH q AS (SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'yes' WHEN l.quality = 0 THEN ' ' END AS caption FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, m.mode, CASE m.mode WHEN 'all' THEN true WHEN 'none' THEN false ELSE trim(coalesce(caption, '')) <> '' END AS picked FROM q, (VALUES ('all'), ('none'), ('captioned')) m(mode)"""
)
def pick_modes(spark, sf_dir):
    rows = _sidecars(spark, sf_dir).select("doc_id", "caption")
    every = [selection.ticked(rows, mode).select("doc_id", F.lit(mode).alias("mode"), "picked") for mode in ("all", "none", "captioned")]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN event_id % 5 ELSE 0 END AS n_waiting FROM events")
def queue_lengths(spark, sf_dir):
    e, kind = _t(spark, sf_dir, "events"), F.col("event_type")
    jobs = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("event_id") % 5).cast("int")), lambda i: F.concat(F.lit('["p", '), i.cast("string"), F.lit("]"))), ", ")
    listed = F.regexp_replace(jobs, r'(, )?\["p", 0\](, )?', "")
    body = F.when(kind == "view", F.concat(F.lit('{"queue_running": [1], "queue_pending": ['), listed, F.lit("]}"))).when(kind == "click", "<html>").when(kind == "error", '{"queue_running": [1, 2]}').when(kind == "signup", '{"queue_pending": "?"}')
    return e.select("event_id", messages.waiting(body).alias("n_waiting"))


SHOTS = """s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'angle' WHEN 1 THEN 'emotion' ELSE 'pose' END AS kind, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'neutral' WHEN 2 THEN 'eager' ELSE 'calm' END AS emotion,
    CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS outfit, CASE WHEN p_partkey % 7 > 0 THEN 'on ' || p_brand ELSE '' END AS setting, p_name AS pose, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'subject' ELSE p_name END AS subject FROM part)"""


def _shots(spark, sf_dir):
    key = F.col("p_partkey")
    return _t(spark, sf_dir, "part").select(
        "p_partkey", F.when(key % 4 == 0, "angle").when(key % 4 == 1, "emotion").otherwise("pose").alias("kind"), F.when(key % 5 == 0, "").when(key % 5 == 1, "neutral").when(key % 5 == 2, "eager").otherwise("calm").alias("emotion"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("outfit"), F.when(key % 7 > 0, F.concat(F.lit("on "), "p_brand")).otherwise("").alias("setting"), F.col("p_name").alias("pose"),
        F.when(key % 3 == 0, F.concat(F.lit("The "), "p_brand")).when(key % 3 == 1, " ").otherwise(F.col("p_name")).alias("subject"),
    )


@query(
    f"""WITH {SHOTS}, w AS (SELECT *, CASE WHEN outfit <> '' THEN ', wearing ' || outfit ELSE '' END AS wearing FROM s)
    SELECT p_partkey, CASE WHEN kind = 'angle' THEN '<sks> ' || pose || CASE WHEN emotion NOT IN ('', 'neutral') THEN ', ' || emotion || ' expression' ELSE '' END || wearing
      ELSE 'the same ' || subject || ', ' || pose || wearing || ', ' || setting || ', ' || CASE WHEN emotion <> '' THEN emotion || ' mood, ink, consistent identity' ELSE 'ink, unchanged form' END END AS prompt FROM w"""
)
def local_prompts(spark, sf_dir):
    told = shots.local_prompt(*(F.col(c) for c in ("kind", "pose", "setting", "emotion", "outfit", "subject")), "ink")
    return _shots(spark, sf_dir).select("p_partkey", told.alias("prompt"))


@query(
    f"""WITH {SHOTS} SELECT p_partkey, 'Generate an image of exactly the same ' || subject || ' from the reference image(s), identical in every physical detail, ' || pose
      || CASE WHEN kind <> 'emotion' AND setting <> '' THEN ', ' || setting ELSE '' END
      || CASE WHEN kind <> 'emotion' AND emotion NOT IN ('', 'neutral') THEN ', with ' || CASE WHEN emotion = 'eager' THEN 'an ' ELSE 'a ' END || emotion || ' expression' ELSE '' END
      || CASE WHEN outfit <> '' THEN ', wearing ' || outfit ELSE '' END || '. Ink.' AS prompt FROM s"""
)
def cloud_prompts(spark, sf_dir):
    told = shots.cloud_prompt(*(F.col(c) for c in ("subject", "kind", "pose", "setting", "emotion", "outfit")), "Ink.")
    return _shots(spark, sf_dir).select("p_partkey", told.alias("prompt"))


@query()
def random_outfits(spark, sf_dir):
    return shots.random_outfits(spark, 24, 7)


@query(SQL["finalize_prose"])
def incremental_caption(spark, sf_dir):
    """Captions of all documents by micro-batches; equal to ``finalize_prose`` in one batch."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="loomset-stream-")
    home = f"{base}/captions-{uuid.uuid4().hex[:12]}"
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in _t(spark, sf_dir, "documents").schema)
    step = lambda batch: batch.select("doc_id", T.finalize_prose(F.col("text"), "zq style", "Ana Nova", ("qqzz",)).alias("caption"))
    # A pattern finds the table whether it is one file or a folder of them.
    run = caption_stream(spark, f"{sf_dir}/documents.parquet*", schema, step, f"{home}/out", f"{home}/state")
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out").select("doc_id", "caption")



EVENT_STATUS = {"click": 503, "view": 429, "error": 400}


@query(
    """SELECT event_id, event_type IN ('click', 'view') AS transient,
    CASE event_type WHEN 'click' THEN 'overloaded (503). ' || 'Try again in a minute, or use another model.' WHEN 'view' THEN 'rate limited (429). ' || 'Try again in a minute, or use another model.' ELSE props || ' bad' END AS message,
    CASE event_type WHEN 'error' THEN 'the file is damaged or no image: export it again or drop it' WHEN 'signup' THEN 'name the subject otherwise, or leave isolation off for this image' ELSE 'see the log for the whole message' END AS hint,
    event_type || ' and k' AS bare FROM events"""
)
def error_texts(spark, sf_dir):
    e, kind = _t(spark, sf_dir, "events"), F.col("event_type")
    status = F.try_element_at(F.create_map(*(F.lit(x) for kv in EVENT_STATUS.items() for x in kv)), kind)
    error = F.when(kind == "error", "Cannot IDENTIFY image").when(kind == "signup", "it found no person").otherwise("other")
    return e.select(
        "event_id", messages.is_transient(status).alias("transient"), messages.friendly_error(status, F.concat(F.col("props"), F.lit("  bad "))).alias("message"),
        messages.failure_hint(error).alias("hint"), messages.plain(F.concat(F.lit("**"), kind, F.lit("** and `k`"))).alias("bare"),
    )


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'unknown node ''N' || user_id || ''': update the server or install it' WHEN 'view' THEN 'no — A (node 7) input ''f'': d' || user_id || '; A (node 7): m'
    WHEN 'error' THEN 'job rejected — u' || user_id WHEN 'signup' THEN 'job rejected: <html>' || user_id ELSE 'job rejected' END AS said FROM events"""
)
def rejection_texts(spark, sf_dir):
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    body = F.when(kind == "click", F.format_string('{"error": {"type": "missing_node_type", "extra_info": {"class_type": "N%s"}}}', user))
    body = body.when(kind == "view", F.format_string('{"error": {"message": "no"}, "node_errors": {"7": {"class_type": "A", "errors": [{"details": "d%s", "extra_info": {"input_name": "f"}}, {"message": "m"}]}}}', user))
    body = body.when(kind == "error", F.format_string('{"error": {"details": "u%s"}}', user)).when(kind == "signup", F.concat(F.lit("<html>"), user)).otherwise("{}")
    return _t(spark, sf_dir, "events").select("event_id", messages.rejection(body).alias("said"))


MODELS = "m AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'gemini-x-' WHEN 1 THEN 'gemini-image-' WHEN 2 THEN 'imagen-' WHEN 3 THEN 'gemini-tts-' WHEN 4 THEN 'image-deprecated-' ELSE 'other-image-' END || p_size || CASE WHEN p_size % 2 = 0 THEN '-latest' ELSE '' END AS model_id, p_partkey % 4 <> 0 AS can FROM part)"


def _models(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size")
    kinds = F.array(*map(F.lit, ("gemini-x-", "gemini-image-", "imagen-", "gemini-tts-", "image-deprecated-", "other-image-")))
    name = F.concat(F.get(kinds, (key % 6).cast("int")), size.cast("string"), F.when(size % 2 == 0, "-latest").otherwise(""))
    return _t(spark, sf_dir, "part").select("p_partkey", name.alias("model_id"), F.when(key % 4 != 0, F.array(F.lit("generateContent"))).otherwise(F.array(F.lit("embed"))).alias("actions"))


@query(f"WITH {MODELS} SELECT p_partkey, model_id FROM m WHERE contains(model_id, 'image') AND NOT contains(model_id, 'imagen') AND NOT contains(model_id, 'deprecated')")
def image_models(spark, sf_dir):
    return selection.image_models(_models(spark, sf_dir)).select("p_partkey", "model_id")


@query(f"WITH {MODELS} SELECT p_partkey, model_id, CASE WHEN model_id LIKE '%latest' THEN 0 ELSE 1 END AS late FROM m WHERE can AND starts_with(model_id, 'gemini-x-')")
def caption_models(spark, sf_dir):
    return selection.caption_models(_models(spark, sf_dir), "gemini").select("p_partkey", "model_id", "late")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def picked_rows(spark, sf_dir):
    picks = _t(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return selection.picked(_t(spark, sf_dir, "documents").select("doc_id", "source"), picks, "doc_id")


@query("SELECT doc_id, source FROM documents d WHERE doc_id IN (SELECT doc_id FROM labels) OR NOT EXISTS (SELECT 1 FROM labels l JOIN documents USING (doc_id))")
def carried_or_all(spark, sf_dir):
    return selection.carried_or_all(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH t AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), v AS (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier)
    SELECT c_custkey, s_suppkey, s_name AS outfit FROM t JOIN v USING (n)"""
)
def dealt_outfits(spark, sf_dir):
    targets = _t(spark, sf_dir, "customer").select("c_custkey")
    outfits = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("outfit"))
    return selection.dealt(targets, "c_custkey", outfits, "s_suppkey")


@query("SELECT p_partkey, CASE WHEN n = 1 THEN p_brand ELSE p_brand || '_' || n END AS free_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)")
def unclashing_names(spark, sf_dir):
    return selection.unclashing(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", "p_partkey").select("p_partkey", "free_name")


@query("SELECT p_partkey, p_size > 25 OR (p_size = 25 AND p_partkey % 7 >= 3) AS newer FROM part")
def newer_versions(spark, sf_dir):
    latest = F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(".0rc"))
    return _t(spark, sf_dir, "part").select("p_partkey", selection.is_newer(latest, F.lit("25.3")).alias("newer"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE replace(p_brand, '#', '-') || '/' || p_size END AS repo FROM part")
def repo_ids(spark, sf_dir):
    name = F.concat(F.lit(" "), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("/"), F.col("p_size").cast("string"), F.lit("/ "))
    return _t(spark, sf_dir, "part").select("p_partkey", selection.repo_id(name).alias("repo"))


@query("SELECT DISTINCT p_brand || '\\' || p_size AS value, CASE WHEN p_size % 3 = 0 THEN p_brand || '/' || p_size WHEN p_size % 3 = 1 THEN upper(p_brand || '/' || p_size) END AS found FROM part")
def installed_names(spark, sf_dir):
    parts, size = _t(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("string").alias("size"), (F.col("p_size") % 3).alias("k")).distinct(), F.col("size")
    there = F.concat("p_brand", F.lit("/"), size)
    listed = parts.where("k < 2").select(F.when(F.col("k") == 0, there).otherwise(F.upper(there)).alias("name"))
    return selection.installed_name(parts.select(F.concat("p_brand", F.lit("\\"), size).alias("value")), listed)


@query("SELECT user_id, count(*) FILTER (WHERE event_type <> 'error') AS n_done, count(*) FILTER (WHERE event_type = 'error') AS n_failed FROM events GROUP BY user_id")
def outcome_tallies(spark, sf_dir):
    failed = F.col("event_type") == "error"
    return selection.tallies(_t(spark, sf_dir, "events").select("user_id", F.when(~failed, "out").alias("output"), F.when(failed, "boom").alias("error")), ["user_id"])


@query("SELECT lang, arg_min(text, doc_id) AS sample FROM documents WHERE trim(text) <> '' GROUP BY lang")
def first_captions(spark, sf_dir):
    return selection.first_sample(_t(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("image"), F.col("text").alias("caption")), ["lang"])


@query("SELECT lang, string_agg(DISTINCT source, '/' ORDER BY source) AS joined FROM documents GROUP BY lang")
def source_folders(spark, sf_dir):
    return selection.joined_set(_t(spark, sf_dir, "documents"), "source", ["lang"])


@query(
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'character ' || p_name WHEN 1 THEN p_name ELSE 'the character' END AS subject, CASE WHEN lower(left(p_name, 1)) IN ('a', 'e', 'i', 'o', 'u') THEN 'an' ELSE 'a' END AS art,
    CASE WHEN length(p_name) < 12 THEN '********' ELSE left(p_name, 4) || '...' || right(p_name, 4) END AS secret, CASE WHEN len(regexp_extract_all(split_part(p_type, ' ', 1), '[A-Z]')) > 1 THEN p_type ELSE lower(left(p_type, 1)) || substr(p_type, 2) END AS lowered FROM part"""
)
def name_phrases(spark, sf_dir):
    key, name = F.col("p_partkey"), F.col("p_name")
    kind = F.when(key % 3 == 1, "concept").otherwise("character")
    rows = _t(spark, sf_dir, "part")
    return rows.select("p_partkey", plan_files.plan_subject(F.when(key % 3 < 2, name).otherwise(" "), kind).alias("subject"), T.article(name).alias("art"), T.mask(name).alias("secret"), T.lower_first(F.col("p_type")).alias("lowered"))


@query(
    """WITH g AS (SELECT vec_id, embedding[i] > 0 AS s, embedding[i] > 0.1 OR i % 9 = 0 AS e FROM embeddings, range(1, 65) r(i))
    SELECT vec_id, count(*) FILTER (WHERE s OR e) AS n_union, round(CASE WHEN count(*) FILTER (WHERE e) > 0 THEN CAST(count(*) FILTER (WHERE s AND e) AS DOUBLE) / count(*) FILTER (WHERE e) ELSE 0 END, 6) AS share FROM g GROUP BY vec_id"""
)
def mask_overlap(spark, sf_dir):
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", _pixels(lambda v, i: v > 0).alias("s"), _pixels(lambda v, i: (v > _limit(0.1)) | ((i + 1) % 9 == 0)).alias("e"))
    union = F.size(F.filter(selection.mask_union(F.array("s", "e")), lambda x: x)).cast("long")
    return rows.select("vec_id", union.alias("n_union"), F.round(selection.overlap_share(F.col("s"), F.col("e")), 6).alias("share"))


@query(
    """WITH g AS (SELECT vec_id, i, i % 8 AS x, i // 8 AS y, embedding[i + 1] > 0.05 AS s, embedding[i + 1] > 0.15 OR (vec_id % 3 > 0 AND i % 17 = vec_id % 17 AND embedding[i + 1] < 0) AS e FROM embeddings, range(64) r(i)),
    n AS (SELECT vec_id, count(*) FILTER (WHERE e) AS n_e, count(*) FILTER (WHERE s AND e) AS n_both FROM g GROUP BY vec_id),
    d AS (SELECT a.vec_id, a.i, bool_or(b.e) AS near FROM g a JOIN g b ON a.vec_id = b.vec_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 GROUP BY a.vec_id, a.i)
    SELECT g.vec_id, count(*) FILTER (WHERE s OR e) AS n_union, min(x) FILTER (WHERE s)::INT AS "left", min(y) FILTER (WHERE s)::INT AS "top", (max(x) FILTER (WHERE s) + 1)::INT AS "right", (max(y) FILTER (WHERE s) + 1)::INT AS "bottom",
      CASE WHEN any_value(n_e) = 0 THEN 'absent' WHEN any_value(n_both) / any_value(n_e) < 0.10 THEN 'outside' ELSE 'subtracted' END AS outcome,
      count(*) FILTER (WHERE s AND NOT (near AND n_e > 0 AND n_both / n_e >= 0.10)) AS n_left
    FROM g JOIN n ON g.vec_id = n.vec_id JOIN d ON g.vec_id = d.vec_id AND g.i = d.i GROUP BY g.vec_id"""
)
def mask_runs(spark, sf_dir):
    """Masks of 8 x 8 pixels as runs: union, box, and a prop grown by a pixel and taken out where it is merged into the subject."""
    key, side = F.col("vec_id"), F.lit(8)
    prop = _pixels(lambda v, i: (v > _limit(0.15)) | ((key % 3 > 0) & (i % 17 == key % 17) & (v < 0)))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", masks.of_booleans(_pixels(lambda v, i: v > _limit(0.05))).alias("s"), masks.of_booleans(prop).alias("e"))
    done = rows.select("vec_id", "s", masks.area(masks.union(F.col("s"), F.col("e"))).alias("n_union"), masks.without_prop(F.col("s"), F.col("e"), side, side, 1).alias("left_over"))
    return done.select("vec_id", "n_union", masks.box(F.col("s"), side).alias("box"), "left_over").select("vec_id", "n_union", "box.*", "left_over.outcome", masks.area(F.col("left_over.mask")).alias("n_left"))


@query(
    f"""WITH {TAGGED}, l AS (SELECT ord, {TAGLIST} AS l FROM p), d AS (SELECT ord, list_concat(['Brand#1'], list_filter({DEDUP.format(l='l')}, lambda x: x <> 'brand#1')) AS t FROM l)
    SELECT ord, 'score_9, ' || array_to_string(list_filter(t, lambda x, i: i = 1 OR replace(x, '_', ' ') NOT IN ('brand#11', 'promo')), ', ') || ', end' AS caption FROM d"""
)
def caption_pipeline(spark, sf_dir):
    raw = F.concat(F.upper("caption"), F.lit("., "), F.col("caption"))
    return _tagged(spark, sf_dir).select("ord", choices.caption_steps(raw, "tags", trigger="Brand#1", drop="brand#11, PROMO", prefix="score_9,", suffix=",end").alias("caption"))


@query(
    """WITH k AS (SELECT p_partkey, p_type, CASE p_partkey % 4 WHEN 0 THEN 'custom' WHEN 1 THEN 'anime' WHEN 2 THEN 'nosuch' ELSE 'custom' END AS key, CASE WHEN p_partkey % 4 = 3 THEN '' ELSE p_type END AS own FROM part)
    SELECT p_partkey, CASE WHEN key = 'nosuch' OR (key = 'custom' AND own = '') THEN 'match' ELSE key END AS style, CASE WHEN key = 'custom' AND own <> '' THEN 'Rendered as ' || CASE WHEN len(regexp_extract_all(split_part(own, ' ', 1), '[A-Z]')) > 1 THEN own ELSE lower(left(own, 1)) || substr(own, 2) END || '.' ELSE '' END AS phrase FROM k"""
)
def shot_styles(spark, sf_dir):
    k = F.col("p_partkey") % 4
    key = F.when(k == 1, " ANIME").when(k == 2, "nosuch").otherwise("Custom ")
    own = F.when(k == 3, " . ").otherwise(F.concat(F.lit("  "), F.replace("p_type", F.lit(" "), F.lit("  ")), F.lit("..")))
    return _t(spark, sf_dir, "part").select("p_partkey", choices.shot_style(key, own, ("match", "anime", "custom")).alias("s")).select("p_partkey", "s.*")


@query(
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'style' WHEN 1 THEN 'concept' WHEN 2 THEN 'character' ELSE 'other' END AS kind FROM orders), p AS (SELECT r_regionkey AS shot, CASE WHEN r_regionkey < 2 THEN 'concept' ELSE 'character' END AS plan FROM region)
    SELECT o_orderkey, shot FROM d JOIN p ON plan = CASE kind WHEN 'style' THEN NULL WHEN 'concept' THEN 'concept' ELSE 'character' END"""
)
def plan_choice(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(k == 0, "style").when(k == 1, "concept").when(k == 2, "character").otherwise("other").alias("kind"))
    plans = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("shot"), F.when(F.col("r_regionkey") < 2, "concept").otherwise("character").alias("plan"))
    return choices.planned(rows, "kind", plans).select("o_orderkey", "shot")


@query(
    """WITH p AS (SELECT n_regionkey AS trainer, n_name AS name, n_nationkey AS ord FROM nation), f AS (SELECT trainer, arg_min(name, ord) AS name FROM p GROUP BY trainer),
    w AS (SELECT c_custkey, c_nationkey % 7 AS trainer, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE 'none' END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, coalesce(p.name, f.name) AS preset FROM w LEFT JOIN p ON w.trainer = p.trainer AND w.name = p.name LEFT JOIN f ON w.trainer = f.trainer"""
)
def preset_lookup(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    presets = nation.select(F.col("n_regionkey").cast("long").alias("of"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("value"))
    rows = _t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("c_custkey", (F.col("c_nationkey") % 7).cast("long").alias("trainer"), F.when(F.col("c_custkey") % 2 == 0, F.col("n_name")).otherwise("none").alias("key"))
    return choices.preset(rows, "trainer", "key", presets).select("c_custkey", "preset")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS value, '' AS p_type, CASE WHEN p_partkey % 2 = 0 THEN '✅ ' ELSE '⬜ ' END || p_brand AS label, p_partkey % 5 > 1 AS differs FROM part")
def filled_fields(spark, sf_dir):
    key, brand = F.col("p_partkey"), F.col("p_brand")
    recorded = F.when(key % 5 == 0, F.lit(None).cast("string")).when(key % 5 == 1, brand).otherwise("other")
    rows = _t(spark, sf_dir, "part").select("p_partkey", choices.filled(F.when(key % 3 == 0, F.concat(F.lit(" "), "p_name")).when(key % 3 == 1, "  "), brand).alias("value"), "p_type", choices.picker_label(brand, key % 2 == 0).alias("label"), choices.type_differs(recorded, brand).alias("differs"))
    return choices.cleared(rows, "p_type")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'D:\\' || p_name WHEN 1 THEN '/data/' || p_brand END AS folder FROM part")
def output_folders(spark, sf_dir):
    k, name = F.col("p_partkey") % 5, F.col("p_name")
    path = F.when(k == 0, F.concat(F.lit(' "D:\\'), name, F.lit('" '))).when(k == 1, F.concat(F.lit("/data/"), "p_brand")).when(k == 2, F.concat(name, F.lit("?"))).when(k == 3, F.concat(name, F.lit("/a:b"))).otherwise(' "" ')
    return _t(spark, sf_dir, "part").select("p_partkey", choices.output_folder(path).alias("folder"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 AND s_name IS NOT NULL THEN s_name ELSE p_brand END AS outfit FROM part LEFT JOIN supplier ON p_partkey = s_suppkey"""
)
def dressed_shots(spark, sf_dir):
    k = F.col("p_partkey") % 3
    shots_ = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.when(k == 0, "angle").when(k == 1, "pose").otherwise("emotion").alias("kind"), F.col("p_brand").alias("outfit"))
    outfits = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("outfit"))
    return choices.dressed(shots_, outfits).select(F.col("id").alias("p_partkey"), "outfit")


@query("SELECT event_id, event_type FROM events WHERE event_id BETWEEN 30 AND 400")
def range_picks(spark, sf_dir):
    return choices.range_picked(_t(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", 400, 30)


@query("SELECT user_id, bool_and(event_type <> 'error') AS all_ok, count(*) FILTER (WHERE event_type = 'error') AS n_missing FROM events GROUP BY user_id")
def report_checks(spark, sf_dir):
    return choices.report(_t(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("name"), (F.col("event_type") != "error").alias("ok")), ["user_id"])


@query("SELECT DISTINCT p_brand || ' ' || p_size AS name FROM part WHERE p_brand || ' ' || p_size NOT IN (SELECT p_brand || ' ' || p_size FROM part WHERE p_partkey % 3 > 0)")
def missing_dependencies(spark, sf_dir):
    names = _t(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"), "p_partkey")
    return choices.missing(names, names.where("p_partkey % 3 > 0"))


_PIPED = SQL["caption_pipeline"]


def _answering(model, options):
    return lambda caption: f"{caption.upper()}., {caption}"


@query(_PIPED)
def caption_batch(spark, sf_dir):
    """The same captions as ``caption_pipeline``, by a tagger backend that is opened once for a task."""
    rows = _tagged(spark, sf_dir).select("ord", F.col("caption").alias("content"), F.lit("").alias("caption"))
    backend = captioning.configured(captioning.Backend("tagger", _answering))
    log = answers.scratch_log(spark, each=4096)
    done = captioning.caption_images(rows, backend, skip_existing=True, log=log, trigger="Brand#1", drop="brand#11, PROMO", prefix="score_9,", suffix=",end")
    return done.select("ord", "caption")


@query(f"SELECT ord, caption, CAST(1 AS BIGINT) AS n_answers, CASE WHEN ord % 3 = 0 THEN 1 ELSE 2 END AS run FROM ({_PIPED})")
def caption_resumed(spark, sf_dir):
    """A batch that ended after every third image, taken up by its log: nothing is asked twice."""
    rows = _tagged(spark, sf_dir).select("ord", F.col("caption").alias("content"), F.lit("").alias("caption"))
    backend, log = captioning.configured(captioning.Backend("tagger", _answering)), answers.scratch_log(spark, each=4096)
    finish = {"trigger": "Brand#1", "drop": "brand#11, PROMO", "prefix": "score_9,", "suffix": ",end"}
    captioning.caption_images(rows.where("ord % 3 = 0"), backend, log=log, **finish)
    done = captioning.caption_images(rows, backend, log=log, **finish)
    told = log.read(spark, "ord", "bigint").groupBy("ord").agg(F.count(F.lit(1)).alias("n_answers"), F.max("run").alias("run"))
    return done.join(told, "ord").select("ord", "caption", "n_answers", "run")


@query(
    """WITH p AS (SELECT user_id, ts, max(event_id) AS e FROM events WHERE event_type = 'view' AND event_id % 5 <> 0 GROUP BY user_id, ts),
    r AS (SELECT event_id, user_id, ts FROM events WHERE event_type <> 'view')
    SELECT r.event_id, CASE WHEN epoch_us(r.ts) - epoch_us(p.ts) <= 86400000000 THEN 'fresh' WHEN r.event_id % 3 = 0 THEN 'live' WHEN p.e IS NOT NULL THEN 'stale' ELSE 'static' END AS origin,
      CASE WHEN epoch_us(r.ts) - epoch_us(p.ts) <= 86400000000 THEN 'm' || p.e WHEN r.event_id % 3 = 0 THEN 'live' || r.event_id WHEN p.e IS NOT NULL THEN 'm' || p.e ELSE 'a,b' END AS models
    FROM r ASOF LEFT JOIN p ON r.user_id = p.user_id AND r.ts >= p.ts"""
)
def model_lists(spark, sf_dir):
    """Lists of models by their age: users' views are pulls, one in five of which finds nothing, and their other events ask."""
    e = _t(spark, sf_dir, "events")
    name = lambda mark: F.array(F.concat(F.lit(mark), F.col("event_id").cast("string")))
    pulls = e.where("event_type = 'view'").select("user_id", "ts", F.when(F.col("event_id") % 5 == 0, F.array().cast("array<string>")).otherwise(name("m")).alias("found"))
    live = F.when(F.col("event_id") % 3 == 0, name("live")).when(F.col("event_id") % 3 == 1, F.array().cast("array<string>"))
    got = asof.listed(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), pulls, "user_id", "ts", live, "found", F.array(F.lit("a"), F.lit("b")))
    return got.select("event_id", "origin", F.array_join("models", ",").alias("models"))


def _made(shot: dict) -> str:
    """Tells how many shots led to this one."""
    return f"{int((shot['led_by'] or '0-').partition('-')[0]) + 1}-{shot['id']}"


@query(
    """WITH RECURSIVE s AS (SELECT p_partkey AS k, CASE p_partkey % 20 WHEN 18 THEN p_partkey + 1 WHEN 19 THEN p_partkey - 1 WHEN 0 THEN p_partkey - 1 ELSE CASE WHEN p_partkey % 4 <> 1 THEN p_partkey - 1 END END AS up, p_partkey % 7 = 0 AS kept FROM part),
    t AS (SELECT k, up, up IN (SELECT k FROM s WHERE NOT kept) AS waits FROM s WHERE NOT kept),
    w AS (SELECT k, 0 AS wave FROM t WHERE waits IS NOT TRUE UNION ALL SELECT t.k, w.wave + 1 FROM w JOIN t ON t.up = w.k AND t.waits),
    d AS (SELECT t.k, w.wave, w.k IS NULL AS ring, CASE WHEN t.up % 7 = 0 AND t.up IN (SELECT k FROM s) THEN '5-old' END AS old, t.up FROM t LEFT JOIN w ON t.k = w.k),
    m AS (SELECT k, wave, ring, old AS led_by, CASE WHEN old IS NULL THEN 1 ELSE 6 END AS n, up FROM d WHERE wave = 0 OR ring UNION ALL SELECT d.k, d.wave, d.ring, m.n || '-' || m.k, m.n + 1, d.up FROM m JOIN d ON d.up = m.k AND d.wave = m.wave + 1 AND NOT m.ring)
    SELECT k::VARCHAR AS id, n || '-' || k AS path, '' AS error, wave::BIGINT AS wave, ring, led_by FROM m UNION ALL SELECT k::VARCHAR, '5-old', '', NULL, false, NULL FROM s WHERE kept"""
)
def generation_waves(spark, sf_dir):
    """Chains of up to four shots, some in rings, some on results that are kept."""
    key = F.col("p_partkey")
    up = F.when(key % 20 == 18, key + 1).when((key % 20).isin(19, 0) | (key % 4 != 1), key - 1)
    plan = _t(spark, sf_dir, "part").select(key.cast("string").alias("id"), F.lit("pose").alias("kind"), F.col("p_name").alias("local_prompt"), F.col("p_type").alias("cloud_prompt"), up.cast("string").alias("chain_from"), (key % 7 == 0).alias("kept"))
    old = plan.where("kept").select("id", F.lit("5-old").alias("path"), F.lit(1).cast("long").alias("seed"), F.lit("").alias("error"))
    made = generation.generate(plan, lambda: _made, old, plan.where("NOT kept").select("id"), log=answers.scratch_log(spark, each=4096))
    return made.select("id", "path", "error", "wave", "ring", "led_by")


@query(
    """WITH k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tags' WHEN 1 THEN 'prose' WHEN 2 THEN 'odd' END AS s, CASE p_size % 3 WHEN 0 THEN 'style' WHEN 1 THEN 'concept' ELSE 'character' END AS t, p_partkey % 5 = 0 AS sparse FROM part)
    SELECT p_partkey, CASE WHEN t = 'character' THEN CASE WHEN s = 'tags' THEN 'List tags of {subject}.' ELSE 'Describe {subject}.' END
      ELSE CASE WHEN t = 'concept' THEN 'Tell what surrounds it.' WHEN sparse THEN 'Name the content.' ELSE 'Tell the content, not the look.' END || ' Say {subject}. ' || CASE WHEN s = 'tags' THEN 'Tags only.' ELSE 'Sentences.' END END AS said FROM k"""
)
def instructions(spark, sf_dir):
    n = F.col("p_partkey") % 4
    style = F.when(n == 0, "tags").when(n == 1, "prose").when(n == 2, "odd")
    kind = F.when(F.col("p_size") % 3 == 0, "style").when(F.col("p_size") % 3 == 1, "concept").otherwise("character")
    framings = {"concept": "Tell what surrounds it.", "style": "Tell the content, not the look.", "style-sparse": "Name the content."}
    said = captioning.instruction(style, kind, F.col("p_partkey") % 5 == 0, {"prose": "Describe {subject}.", "tags": "List tags of {subject}."}, framings, {"prose": "Sentences.", "tags": "Tags only."}, "Say {subject}.")
    return _t(spark, sf_dir, "part").select("p_partkey", said.alias("said"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS style FROM events")
def known_choices(spark, sf_dir):
    given = F.concat(F.lit(" "), F.initcap("event_type"), F.lit(" "))
    return _t(spark, sf_dir, "events").select("event_id", choices.known(given, ("click", "view")).alias("style"))
