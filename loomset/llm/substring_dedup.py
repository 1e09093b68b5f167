"""Substring dedup by seed and extend: passages of a length of words that occur earlier are cut out.

1. Seeds. Of the grams in each window of ``threshold`` words the one whose hash is least is its anchor
   (leftmost of equals), so equal windows have equal anchors at equal places. Neighbouring windows share
   an anchor and go as one *run*; there is about one anchor for seven words. Documents are joined on
   anchors; those that occur once are dropped. A run that occurs earlier over its whole span is a
   repeat as it is, and only the first run of each span goes on.
2. Extension. The runs of one anchor are a group. Its first run in the corpus leads: each other run is
   extended from the anchor to the left and to the right as far as it agrees with the leader, word by
   word, and the windows within that match are repeats. What a run holds beyond the match can only occur
   earlier in runs that go on with the same word at the same distance, so these make a smaller group,
   with a leader of their own. Each window is in one group of each round, so the work grows with the
   text and not with the square of a group. Groups of more than ``GROUP_RUNS`` runs take their rounds
   over all executors; others are finished in a task.
3. Repeats that overlap or touch are merged to maximal ones and cut out of their text.

Texts are compared by their words. Equal texts are one text with copies, told by narrow rows; texts
themselves move once, to buckets by row in which all later joins find them. Equality of texts and
spans is that of 128-bit digests; extensions compare the words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import bucketed, discard, materialize, numbered, small_batches, table, text_bytes
from loomset.llm.suffix_dedup import Units, digest, runs
from loomset.store import free_shuffles

#: Words of a seed. Windows have at least twice as many.
GRAM = 8
#: Runs of a group that is finished in one task, and bytes of such groups that are held at once.
GROUP_RUNS, HELD_BYTES = 1024, 1 << 21
ROWS = 8192
#: Shares of the anchors that are joined one after the other: bounds what a join moves at once.
SLICES = 4


def record_batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def in_words(df: DataFrame, id_col: str, text_col: str, threshold: int) -> DataFrame:
    """A table in buckets by ``row``: (row, id, n_words, tid, sha, body), the body only of texts of at least a window."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body in batch.column("body"):
                words = body.as_py().split()
                text = b" ".join(words)
                found = sha256(text)
                out.append((len(words), found.digest()[:16], found.hexdigest(), text if len(words) >= threshold else None))
            made = record_batch(out, [("n_words", pa.int64()), ("tid", pa.binary()), ("sha", pa.string()), ("body", pa.binary())])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *made.columns], ["row", "id", *made.schema.names])

    kind = rows.schema["id"].dataType.simpleString()
    return bucketed(rows.mapInArrow(run, f"row long, id {kind}, n_words long, tid binary, sha string, body binary"), "row", "seed-rows")


SEEDS = "key binary, span binary, t long, first int, more int, anchor int"
SEED_FIELDS = [("key", pa.binary()), ("span", pa.binary()), ("t", pa.int64()), ("first", pa.int32()), ("more", pa.int32()), ("anchor", pa.int32())]


def seeds(texts: DataFrame, threshold: int) -> DataFrame:
    """The runs of all texts (t, body): windows ``first`` to ``first + more``, the anchor's gram and place in them, a digest of the whole span.

    A run whose span a text has had before has no key: it is a repeat already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for t, body in zip(batch.column("t"), batch.column("body"), strict=True):
                units, t = Units(body.as_py(), "words"), t.as_py()
                for first, last, anchor, key in runs(units.symbols(), threshold, GRAM):
                    had, keys = set(), key.tobytes()  # for each chunk of a very long text
                    for i, (f, l, a) in enumerate(zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)):
                        span = digest(units.slice(f, l + threshold))
                        rows.append((None if span in had else keys[8 * i : 8 * i + 8], span, t, f, l - f, a - f))
                        had.add(span)
                    while len(rows) > ROWS:
                        yield record_batch(rows[:ROWS], SEED_FIELDS)
                        rows = rows[ROWS:]
            yield record_batch(rows, SEED_FIELDS)

    return texts.select("t", "body").mapInArrow(run, SEEDS)


def joined_on_seeds(parts: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Repeats (t, first, more) told by their whole span, and the first run of each span of the anchors that have several (key, size, t, first, more, anchor).

    Aggregates keep the least and the greatest place of a key, so a hot anchor costs no more than others.
    Anchors are taken in slices, one after the other: all runs move once, but few at a time.
    """
    place = F.xxhash64("t", "first")
    repeats, rest = [materialize(parts.where("key IS NULL").select("t", "first", "more"), "seed-repeats")], []
    for i in range(SLICES):
        one = parts.where(F.pmod(F.xxhash64("key"), F.lit(SLICES)) == i)  # null is no anchor
        twice = one.groupBy("key").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo <> hi").select("key")
        twice = materialize(twice, "seed-twice")  # a table of its own, so that the join can split a hot key
        shared = materialize(one.join(twice, "key", "left_semi"), "seed-shared")
        free_shuffles(parts.sparkSession)
        leads = shared.groupBy("span").agg(F.count(F.lit(1)).alias("places"), F.min(F.struct("t", "first", "key", "more", "anchor")).alias("lead"))
        leads = materialize(leads.select("span", "places", "lead.*"), "seed-leads")
        later = shared.select("span", "t", "first", "more").join(leads.where("places > 1").select("span", F.col("t").alias("lead_t"), F.col("first").alias("lead_first")), "span")
        repeats.append(materialize(later.where("t <> lead_t OR first <> lead_first").select("t", "first", "more"), "seed-repeats"))
        sizes = materialize(leads.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "seed-sizes")
        rest.append(materialize(leads.join(sizes, "key").select("key", "size", "t", "first", "more", "anchor"), "seed-rest"))
        discard(twice, shared, leads, sizes)
    return repeats, rest


def by_text(marks: DataFrame, order: DataFrame) -> DataFrame:
    """(row, t, marks) of each text that has any; their number is bounded by the text's own length."""
    return marks.groupBy("t").agg(F.collect_list(F.struct(*(c for c in marks.columns if c != "t"))).alias("marks")).join(order.select("t", "row"), "t")


#: A run in its group: the seed's place, how many words before the seed its windows can begin (lo to hi), and the words on both sides.
ITEMS = "key binary, size long, t long, at int, lo int, hi int, left binary, right binary"
ITEM_FIELDS = [("key", pa.binary()), ("size", pa.int64()), ("t", pa.int64()), ("at", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("left", pa.binary()), ("right", pa.binary())]


def with_words(rows: DataFrame, rest: DataFrame, order: DataFrame, threshold: int) -> DataFrame:
    """The runs with the words around their seeds, cut out of their texts."""
    joined = rows.select("row", "body").join(by_text(rest, order).hint("shuffle_hash"), "row").select("t", "body", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for t, body, marks in zip(*batch.columns, strict=True):
                units, t = Units(body.as_py(), "words"), t.as_py()
                for m in marks.as_py():
                    at, end = m["first"] + m["anchor"], m["first"] + m["more"] + threshold
                    left = units.slice(m["first"], at) if m["anchor"] else b""
                    right = units.slice(at + GRAM, end) if at + GRAM < end else b""
                    out.append((m["key"], m["size"], t, at, m["anchor"] - m["more"], m["anchor"], left, right))
                    if len(out) >= ROWS:
                        yield record_batch(out, ITEM_FIELDS)
                        out = []
            yield record_batch(out, ITEM_FIELDS)

    return joined.mapInArrow(run, ITEMS)


def common(a: list[bytes], b: list[bytes]) -> int:
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def extend(lead: tuple[list[bytes], list[bytes]], own: tuple[list[bytes], list[bytes]], lo: int, hi: int, need: int) -> tuple[tuple[int, int] | None, list[tuple[bytes, int, int]]]:
    """Extends a run against its leader: the windows within the match, and what is open, by the word that it goes on with.

    Both have their words by distance from the seed, left and right. Windows are told by how many of the
    ``need`` words beside the seed stand before it, ``lo`` to ``hi``.
    """
    l, r = common(lead[0], own[0]), common(lead[1], own[1])
    first, last = max(lo, need - r), min(hi, l)
    match, left_from, right_to = (first, last) if first <= last else None, max(lo, l + 1), min(hi, l, need - r - 1)
    further = []
    if left_from <= hi:
        further.append((b"l%d " % l + own[0][l], left_from, hi))
    if lo <= right_to:
        further.append((b"r%d " % r + own[1][r], lo, right_to))
    return match, further


def sides(left: bytes, right: bytes) -> tuple[list[bytes], list[bytes]]:
    return left.split()[::-1], right.split()


def finish(group: list[tuple], need: int) -> Iterator[tuple[int, int, int]]:
    """All repeats (t, first, more) of a group of items (t, at, lo, hi, left, right)."""
    open_ = [[(t, at, lo, hi, sides(left, right)) for t, at, lo, hi, left, right in group]]
    while open_:
        items = open_.pop()
        lead = min(items, key=lambda x: x[:3])
        parts = defaultdict(list)
        for item in items:
            if item is not lead:
                t, at, lo, hi, words = item
                match, further = extend(lead[4], words, lo, hi, need)
                if match:
                    yield t, at - match[1], match[1] - match[0]
                for word, low, high in further:
                    parts[word].append((t, at, low, high, words))
        open_ += [p for p in parts.values() if len(p) > 1]


REPEATS = "t long, first int, more int"
REPEAT_FIELDS = [("t", pa.int64()), ("first", pa.int32()), ("more", pa.int32())]


def finished(items: DataFrame, need: int) -> DataFrame:
    """The repeats of whole groups, one group after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    out += finish(group, need) if len(group) > 1 else []
                    key, group = row[0], []
                    if len(out) >= ROWS:
                        yield record_batch(out, REPEAT_FIELDS)
                        out = []
                group.append(row[1:])
        out += finish(group, need) if len(group) > 1 else []
        yield record_batch(out, REPEAT_FIELDS)

    return items.select("key", "t", "at", "lo", "hi", "left", "right").repartition("key").sortWithinPartitions("key").mapInArrow(run, REPEATS)


def led(hot: DataFrame, need: int) -> DataFrame:
    """One round of hot groups over all executors: matches with the leaders (key null), and the items of smaller groups."""
    least = materialize(hot.groupBy("key").agg(F.min(F.struct("t", "at", "lo")).alias("lead")).select("key", "lead.*"), "seed-least")
    lead = materialize(hot.join(least, ["key", "t", "at", "lo"]).select("key", F.struct("t", "at", "lo").alias("lead"), F.col("left").alias("lead_left"), F.col("right").alias("lead_right")), "seed-lead")
    joined = hot.join(lead, "key").where(F.struct("t", "at", "lo") != F.col("lead")).select("key", "t", "at", "lo", "hi", "left", "right", "lead_left", "lead_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, t, at, lo, hi, left, right, *of_lead in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                match, further = extend(sides(*of_lead), sides(left, right), lo, hi, need)
                if match:
                    out.append((None, 0, t, at, *match, None, None))
                out += [(digest(key + word), 0, t, at, low, high, left, right) for word, low, high in further]
            yield record_batch(out, ITEM_FIELDS)

    out = materialize(joined.mapInArrow(run, ITEMS), "seed-led")
    discard(least, lead)
    return out


def extended(items: DataFrame, need: int) -> list[DataFrame]:
    """Tables of the repeats (t, first, more) that extension finds in all groups of ``items``."""
    found, spent = [], []
    while True:
        found.append(materialize(finished(items.where(F.col("size") <= GROUP_RUNS), need), "seed-finished"))
        hot = items.where(F.col("size") > GROUP_RUNS)
        if hot.isEmpty():
            break
        split = led(hot, need)
        found.append(materialize(split.where("key IS NULL").select("t", (F.col("at") - F.col("hi")).alias("first"), (F.col("hi") - F.col("lo")).alias("more")), "seed-matched"))
        sizes = materialize(split.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "seed-sizes")
        items = materialize(split.drop("size").join(sizes, "key").select("key", "size", "t", "at", "lo", "hi", "left", "right"), "seed-items")
        discard(split, sizes)
        spent.append(items)
    discard(*spent)
    return found


def cut_out(rows: DataFrame, repeats: DataFrame, order: DataFrame, threshold: int) -> DataFrame:
    """(row, n_removed, sha, kept) of each text with repeats."""
    joined = rows.select("row", "body").join(by_text(repeats, order).hint("shuffle_hash"), "row").select("row", "body", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row, body, marks in zip(*batch.columns, strict=True):
                words, kept, end, removed = body.as_py().split(), [], 0, 0
                for first, last in sorted((m["first"], m["first"] + m["more"] + threshold) for m in marks.as_py()):
                    if last > end:
                        kept += words[end:first]
                        removed += last - max(first, end)
                        end = last
                left = b" ".join(kept + words[end:])
                out.append((row.as_py(), removed, sha256(left).hexdigest(), left))
            yield record_batch(out, [("row", pa.int64()), ("n_removed", pa.int64()), ("sha", pa.string()), ("kept", pa.binary())])

    return joined.mapInArrow(run, "row long, n_removed long, sha string, kept binary")


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 20) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept`` (the kept words joined by a space; null where nothing was removed).

    A word is removed where a window of ``threshold`` words that covers it also starts earlier: in a row of
    a lesser id, or before in its own text. Null ids come last; rows with one id are ordered by a digest of
    their words, and of rows that agree in both, one comes first. A null or empty text has no words and
    keeps none; a text shorter than a window keeps all. Only the two named columns are read. An empty
    table gives an empty result. ``threshold`` must be at least 16.
    """
    if threshold < 2 * GRAM:
        raise ValueError(f"a window of {threshold} words is shorter than two seeds of {GRAM}")
    small_batches(df.sparkSession)
    need = threshold - GRAM
    rows = in_words(df, id_col, text_col, threshold)
    firsts = rows.where(F.col("n_words") >= threshold).groupBy("tid").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    order = numbered(firsts.select("tid", "first.none", "first.id", "first.row"), [F.col("none"), F.col("id"), F.col("tid")], "seed-order").select(F.col("number").alias("t"), "row")
    order = materialize(order, "seed-texts")
    texts = rows.select("row", "body").join(order.hint("shuffle_hash"), "row")
    parts = materialize(seeds(texts, threshold), "seed-runs")
    repeats, rest = joined_on_seeds(parts)
    discard(parts)
    items = materialize(with_words(rows, reduce(DataFrame.unionByName, rest), order, threshold), "seed-words")
    discard(*rest)
    found = extended(items, need)
    discard(items)
    cut = materialize(cut_out(rows, reduce(DataFrame.unionByName, [*repeats, *found]), order, threshold), "seed-cut")
    discard(*repeats, *found)
    state = order.select("row").join(cut.withColumnRenamed("sha", "cut_sha"), "row", "left").withColumn("first", F.lit(True))
    out = rows.select("row", "id", "n_words", "sha").join(state, "row", "left")
    copy = (F.col("n_words") >= threshold) & F.col("first").isNull()
    nothing = sha256(b"").hexdigest()
    return out.select(
        F.col("id").alias(id_col), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"), F.when(copy, F.lit("")).otherwise(F.col("kept").cast("string")).alias("kept"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept")


def op13_sql() -> str:
    return r"""
    WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
    starts AS (SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS win FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM texts)),
    later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS place FROM starts) WHERE place > 1),
    placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM texts),
    marked AS (SELECT p.doc_id, p.i, p.word, max(CASE WHEN l.i IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM placed p LEFT JOIN later l ON p.doc_id = l.doc_id AND p.i = l.i),
    kept AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY doc_id)
    SELECT t.doc_id, len(t.words)::BIGINT AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id"""
