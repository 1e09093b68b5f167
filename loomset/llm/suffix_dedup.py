"""Suffix-array dedup by a depth-limited radix sort.

Every position of every text starts a suffix; only its first ``threshold`` units (bytes or words) are
ordered, and the groups that are equal through them are exactly the windows that occur more than once.

1. Suffixes are dealt to buckets by the gram whose hash is least in their window (the anchor, leftmost
   of equals): equal windows have equal anchors at equal places. Neighbouring windows share an anchor,
   so they move as one *run*, about one run for half a window of text. Buckets of one run are dropped.
   A run found again over its whole span is repeated without any sorting, and stands once in its bucket.
2. The suffixes of a bucket are ordered by most-significant-digit passes from their leading unit on: a
   pass splits each group by its next digit (8 bytes, or 2 words) and drops groups of one. What is left
   after ``threshold`` units is repeated.
3. A bucket of more than ``BUCKET_RUNS`` different runs is not brought to one task: passes over all
   executors deal it by further digits, dropping groups of one, until its parts are small enough; what
   is still together after all units is equal, and repeated.

Groups of any size are found by aggregates that keep two numbers for a key. Texts that are equal are
one text with copies, from the first step on. What a text repeats within itself, such as a line, is one
row with all its places before anything is shuffled. Equality of whole spans and of the digits of large
buckets is that of 128-bit digests; within a bucket units themselves are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import bucketed, discard, materialize, small_batches, table, text_bytes

#: Windows in a sub-run, and units in a digit, of buckets that are dealt over several tasks.
STEP, DIGIT = 16, 256
#: Runs of a bucket that is ordered in one task, and bytes of such buckets that are ordered at once.
BUCKET_RUNS, ORDERED_BYTES = 1024, 1 << 21
#: Windows handled at once: bounds the memory for a text of any length. Places within take PLACE_BITS.
CHUNK, PLACE_BITS = 1 << 19, 20
GRAM = {"bytes": 32, "words": 8}
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Units:
    """A text as a sequence of units: symbols to hash, and the bytes of any range of units."""

    def __init__(self, body: bytes, unit: str) -> None:
        self.body, self.unit = body, unit
        if unit == "bytes":
            self.n, self.buffer, self.at = len(body), body, None
        else:
            words = body.split()
            self.words, self.n, self.buffer = words, len(words), b" ".join(words)
            self.at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]) if words else np.zeros(1, int)

    def symbols(self) -> np.ndarray:
        if self.unit == "bytes":
            return np.frombuffer(self.body, np.uint8).astype(np.uint64)
        from xxhash import xxh3_64_intdigest as h

        return np.fromiter((h(w) for w in self.words), np.uint64, self.n)

    def slice(self, i: int, j: int) -> bytes:
        if self.at is None:
            return self.buffer[i:j]
        return self.buffer[self.at[i] : self.at[j] - 1]

    def edges(self, i: int, j: int) -> tuple[int, int]:
        """The bytes of the text that go with units i to j: up to the next unit's start, or to the end."""
        if self.at is None:
            return i, j
        starts = self._starts()
        return int(starts[i]), int(starts[j]) if j < self.n else len(self.body)

    def _starts(self) -> np.ndarray:
        if not hasattr(self, "starts"):
            raw = np.frombuffer(self.body, np.uint8)
            space = (raw == 32) | ((raw >= 9) & (raw <= 13))
            self.starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        return self.starts


def gram_hashes(symbols: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams; ``gram`` is a power of two, and each pass doubles the length."""
    h, size = (symbols + np.uint64(1)) * _A, 1
    while size < gram:
        h = (h[:-size] * _A) ^ ((h[size:] + _B) * _B)
        h ^= h >> np.uint64(29)
        size *= 2
    h *= _B
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span, least = 1, x
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    return least if span == width else np.minimum(least[: len(x) - width + 1], least[width - span :])


def runs(symbols: np.ndarray, threshold: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First window, last window, anchor and the anchor's hash of each run, chunk by chunk."""
    mask = np.uint64((1 << PLACE_BITS) - 1)
    for base in range(0, max(0, len(symbols) - threshold + 1), CHUNK):
        hashes = gram_hashes(symbols[base : base + CHUNK + threshold - 1], gram)
        keyed = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (sliding_min(keyed, threshold - gram + 1) & mask).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
        yield first + base, last + base, anchor[first] + base, hashes[anchor[first]].view(np.int64)


def digest(data: bytes, salt: int = 0) -> bytes:
    return blake2b(data, digest_size=16, key=salt.to_bytes(8, "little") if salt else b"").digest()


PARTS = "key binary, span binary, tid binary, firsts array<int>, more int, anchor int"


def emit(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.int32(), pa.int32())
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "span", "tid", "firsts", "more", "anchor"])


class Places:
    """The runs of one text; runs that agree over their span, and so in length and anchor, share a row."""

    def __init__(self, tid: bytes) -> None:
        self.tid, self.found = tid, {}

    def add(self, key: bytes, span: bytes, first: int, more: int, anchor: int) -> None:
        self.found.setdefault((key, span, more, anchor), []).append(first)

    def rows(self) -> list[tuple]:
        return [(key, span, self.tid, sorted(set(firsts)), more, anchor) for (key, span, more, anchor), firsts in self.found.items()]


def all_runs(texts: DataFrame, unit: str, threshold: int) -> DataFrame:
    """The runs of all texts, each with its bucket (``key``, the anchor's gram) and a digest of its whole ``span``."""
    gram = GRAM[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tid, body in zip(batch.column(0), batch.column(1), strict=True):
                units = Units(body.as_py(), unit)
                if units.n < threshold:
                    continue
                tid = tid.as_py()
                for first, last, anchor, key in runs(units.symbols(), threshold, gram):
                    keys, places = key.tobytes(), Places(tid)
                    for i, (f, l, a) in enumerate(zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)):
                        places.add(keys[8 * i : 8 * i + 8], digest(units.slice(f, l + threshold)), f, l - f, a - f)
                    rows += places.rows()
                    if len(rows) > 50_000:
                        yield emit(rows)
                        rows = []
            yield emit(rows)

    return texts.select("tid", "body").mapInArrow(run, PARTS)


def divide(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drops buckets of one run; a span found at several places is repeated, all of it.

    Returns the repeated runs (tid, firsts, more), a text's equal runs in one row, and, for the order, one run (key, size, tid, first,
    more, anchor) for each span of the buckets that hold several spans, ``size`` spans each. Aggregates
    keep the least and the greatest place of a key, so a hot key costs no more than others.
    """
    one, other = (F.xxhash64("tid", F.get("firsts", at)) for at in (F.lit(0), F.size("firsts") - 1))
    lo, hi = F.min(F.least(one, other)).alias("lo"), F.max(F.greatest(one, other)).alias("hi")
    twice = parts.groupBy("key").agg(lo, hi).where("lo <> hi").select("key")
    twice = materialize(twice, "suffix-twice")  # a table of its own, so that the join can split a hot key
    shared = materialize(parts.join(twice, "key", "left_semi"), "suffix-shared")
    discard(twice)
    spans = shared.groupBy("span").agg(lo, hi, F.min(F.struct("key", "tid", F.get("firsts", F.lit(0)).alias("first"), "more", "anchor")).alias("part"))
    spans = materialize(spans.select("span", F.expr("lo <> hi").alias("settled"), "part.*"), "suffix-spans")
    repeated = shared.join(spans.where("settled").select("span"), "span", "left_semi")
    repeated = materialize(repeated.select("tid", "firsts", "more"), "suffix-repeated")
    discard(shared)
    mixed = spans.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.every("settled").alias("all_settled")).where("size > 1 AND NOT all_settled").select("key", "size")
    mixed = materialize(mixed, "suffix-mixed")
    rest = materialize(spans.join(mixed, "key").select("key", "size", "tid", "first", "more", "anchor"), "suffix-rest")
    discard(spans, mixed)
    return repeated, rest


@dataclass(frozen=True)
class Texts:
    """Distinct texts: bodies in buckets by the row that holds them, and narrow rows (tid, row, copies)."""

    rows: DataFrame
    firsts: DataFrame

    def all(self) -> DataFrame:
        return self.rows.join(self.firsts.hint("shuffle_hash"), "row").select("tid", "body")

    def beside(self, marks: DataFrame) -> DataFrame:
        """The bodies of the texts (tid) that ``marks`` has rows of: the marks move, the bodies stay."""
        return self.rows.join(marks.join(self.firsts.select("tid", "row"), "tid").hint("shuffle_hash"), "row")


@dataclass(frozen=True)
class Pieces:
    """Runs as texts of their own (tid, body)."""

    rows: DataFrame

    def beside(self, marks: DataFrame) -> DataFrame:
        return self.rows.hint("merge").join(marks, "tid")


def with_units(texts: Texts | Pieces, rest: DataFrame, unit: str, threshold: int) -> DataFrame:
    """The runs with the units of their windows, cut out of their texts."""
    listed = rest.groupBy("tid").agg(F.collect_list(F.struct("key", "size", "first", "more", "anchor")).alias("runs"))  # bounded by the text's own length
    joined = texts.beside(listed).select("tid", "body", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * 7, (pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["key", "size", "tid", "first", "more", "anchor", "units"])
        for batch in batches:
            rows: list[tuple] = []
            for tid, body, parts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                units, tid = Units(body.as_py(), unit), tid.as_py()
                for p in parts.as_py():
                    rows.append((p["key"], p["size"], tid, p["first"], p["more"], p["anchor"], units.slice(p["first"], p["first"] + p["more"] + threshold)))
                    if len(rows) >= 8192:
                        yield pack(rows)
                        rows = []
            yield pack(rows)

    return joined.mapInArrow(run, "key binary, size long, tid binary, first int, more int, anchor int, units binary")


def digits(slices: list[bytes], unit: str) -> tuple[np.ndarray, np.ndarray, int]:
    """All slices' units in one row, as digits that compare like them: a digit at each unit, the
    units' bounds by slice, and how many units a digit holds (8 bytes, or 2 ranks of words)."""
    if unit == "bytes":
        sizes, width = [len(s) for s in slices], 8
        buffer = np.frombuffer(b"".join(slices) + bytes(width), np.uint8)
        at_each = np.ndarray((len(buffer) - width + 1,), ">u8", buffer, strides=(1,))
    else:
        words = [s.split(b" ") for s in slices]
        sizes, width = [len(x) for x in words], 2
        flat = [w for x in words for w in x]
        rank = {w: i for i, w in enumerate(sorted(set(flat)), 1)}
        ranks = np.fromiter((rank[w] for w in flat), np.uint64, len(flat))
        at_each = (ranks << np.uint64(32)) | np.concatenate([ranks[1:], np.zeros(1, np.uint64)])
    return at_each, np.concatenate([[0], np.cumsum(sizes)]), width


def radix_order(at_each: np.ndarray, places: np.ndarray, groups: np.ndarray, width: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes at ``places`` through ``depth`` units by most-significant-digit passes within their groups.

    Each pass sorts the groups whose members differ in the next digit, splits them there, and drops
    groups of one. Returns what is left after the last digit in order, with its group: the suffixes
    that agree with another one of their group through the whole depth.
    """
    order = np.argsort(groups, kind="stable")
    places, groups = places[order], groups[order]
    for at in [*range(0, depth - width, width), depth - width]:  # the last digit may overlap the one before
        if not len(places):
            break
        digit = at_each[places + at].astype(np.uint64)
        same = groups[1:] == groups[:-1]
        uneven = same & (digit[1:] != digit[:-1])
        if uneven.any():
            number = np.concatenate([[0], np.cumsum(~same)])
            split = np.bincount(number[1:][uneven], minlength=number[-1] + 1)[number] > 0
            spot = np.flatnonzero(split)
            spot = spot[np.lexsort((digit[spot], number[spot]))]
            turned = np.arange(len(places))
            turned[split] = spot
            places, groups, digit = places[turned], groups[turned], digit[turned]
        border = np.concatenate([[True], (groups[1:] != groups[:-1]) | (digit[1:] != digit[:-1]), [True]])
        alone = border[1:] & border[:-1]
        groups = np.cumsum(border[:-1])[~alone]
        places = places[~alone]
    return places, groups


def repeated_in(rows: list[tuple], unit: str, threshold: int) -> list[tuple]:
    """(tid, first, more) of the windows that occur again in their bucket; rows are (key, tid, first, more, anchor, units)."""
    at_each, bounds, width = digits([r[5] for r in rows], unit)
    more, anchor = (np.array([r[i] for r in rows], np.int64) for i in (3, 4))
    keys = {}
    bucket = np.array([keys.setdefault(r[0], len(keys)) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), more + 1)
    begins = np.concatenate([[0], np.cumsum(more + 1)])
    step = np.arange(begins[-1]) - begins[owner]
    # Equal windows have their anchor at the same place, so only windows at one distance from it meet.
    groups = bucket[owner] * (1 << PLACE_BITS) + anchor[owner] - step
    left, _ = radix_order(at_each, bounds[owner] + step, groups, width, threshold)
    hit = np.zeros(len(owner) + 1, bool)
    spots = np.searchsorted(bounds, left, "right") - 1
    hit[begins[spots] + left - bounds[spots]] = True
    starts = hit[:-1] & ~np.where(step > 0, np.concatenate([[False], hit[:-2]]), False)
    ends = hit[:-1] & ~np.where(step < more[owner], hit[1:], False)
    return [(rows[owner[a]][1], rows[owner[a]][2] + int(step[a]), int(b - a)) for a, b in zip(np.flatnonzero(starts), np.flatnonzero(ends), strict=True)]


def ordered(buckets: DataFrame, unit: str, threshold: int) -> DataFrame:
    """The repeated windows (tid, first, more) of whole buckets, many of which are ordered at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            found = repeated_in(rows, unit, threshold) if rows else []
            columns = list(zip(*found, strict=True)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["tid", "first", "more"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > ORDERED_BYTES and held[-1][0] != row[0]:
                    yield pack(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        yield pack(held)

    return buckets.repartition("key").sortWithinPartitions("key").mapInArrow(run, "tid binary, first int, more int")


def next_digit(texts: Pieces, hot: DataFrame, unit: str, threshold: int, depth: int) -> DataFrame:
    """A pass over all executors for buckets too large for one: (key, tid, first, more, anchor) by one digit more.

    Runs are cut into sub-runs of ``STEP`` windows at fixed distances from the anchor; the digit is
    the ``DIGIT`` units from ``depth`` on of what all windows of a sub-run hold. Beyond that, each
    window goes by itself, by all its units.
    """
    listed = hot.groupBy("tid").agg(F.collect_list(F.struct("key", "first", "more", "anchor")).alias("runs"))
    joined = texts.beside(listed).select("tid", "body", "runs")
    core = threshold - STEP + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for tid, body, parts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                units, tid = Units(body.as_py(), unit), tid.as_py()
                for p in parts.as_py():
                    a, low, step = p["first"] + p["anchor"], p["anchor"] - p["more"], STEP if depth < core else 1
                    for j in range(low // step, p["anchor"] // step + 1):
                        o1, o2 = max(low, j * step), min(p["anchor"], j * step + step - 1)
                        begin = a - j * step
                        data = units.slice(begin + depth, begin + min(core, depth + DIGIT)) if step > 1 else units.slice(begin, begin + threshold)
                        rows.append((digest(p["key"] + j.to_bytes(4, "little") + data), tid, a - o2, o2 - o1, o2))
                if len(rows) > 50_000:
                    yield emit_runs(rows)
                    rows = []
            yield emit_runs(rows)

    return joined.mapInArrow(run, "key binary, tid binary, first int, more int, anchor int")


def emit_runs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "tid", "first", "more", "anchor"])


def order_all(texts: Texts, rest: DataFrame, unit: str, threshold: int) -> list[DataFrame]:
    """The repeated windows (tid, first, more) of all buckets, as tables; large buckets are first dealt by further digits.

    Passes over large buckets read the units of their runs, not whole texts: each run is a text of its
    own there, named by its text and its place.
    """
    small, large = F.col("size") <= BUCKET_RUNS, F.col("size") > BUCKET_RUNS
    columns = ("key", "tid", "first", "more", "anchor", "units")
    cut = materialize(with_units(texts, rest, unit, threshold), "suffix-units")
    found = [materialize(ordered(cut.where(small).select(*columns), unit, threshold), "suffix-ordered")]
    hot = cut.where(large).withColumn("tid", F.concat("tid", F.unhex(F.lpad(F.hex("first"), 8, "0"))))
    if not hot.isEmpty():
        hot = materialize(hot, "suffix-hot")
        pieces, rest = Pieces(hot.select("tid", F.col("units").alias("body"))), hot.select("key", "size", "tid", F.lit(0).alias("first"), "more", "anchor")
        place = F.conv(F.hex(F.substring("tid", 17, 4)), 16, 10).cast("int")
        own = (F.substring("tid", 1, 16).alias("tid"), (place + F.col("first")).alias("first"), "more")
        spent = [hot]
        for depth in range(0, threshold - STEP + 1 + DIGIT, DIGIT):
            parts = materialize(next_digit(pieces, rest.where(large), unit, threshold, depth), "suffix-digit")
            sizes = materialize(parts.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "suffix-sizes")
            rest = materialize(parts.join(sizes, "key"), "suffix-dealt")
            discard(parts, sizes)
            spent.append(rest)
            if depth >= threshold - STEP + 1:  # windows by all their units: what is left is repeated
                found.append(materialize(rest.select(*own), "suffix-equal"))
                break
            units = with_units(pieces, rest.where(small), unit, threshold)
            found.append(materialize(ordered(units.select(*columns), unit, threshold).select(*own), "suffix-ordered"))
            if rest.where(large).isEmpty():
                break
        discard(*spent)
    discard(cut)
    return found


def cut_out(texts: Texts, covered: DataFrame, unit: str, threshold: int) -> DataFrame:
    """Removes the covered windows (tid, firsts, more) from each text, and all windows from a text with copies."""
    listed = covered.groupBy("tid").agg(F.collect_list(F.struct("firsts", "more")).alias("runs"))  # bounded by the text's own length
    marks = texts.firsts.select("tid", "copies").join(listed, "tid", "left").where("copies > 1 OR runs IS NOT NULL")
    joined = texts.beside(marks).select("tid", "body", "copies", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for tid, body, copies, parts in zip(*batch.columns, strict=True):
                raw = body.as_py()
                units, kept, end, spans = Units(raw, unit), [], 0, 0
                if units.n < threshold:
                    continue
                merged: list[list[int]] = []
                if copies.as_py() > 1:
                    merged.append([0, units.n])
                else:
                    for f, m in sorted((f, p["more"]) for p in parts.as_py() for f in p["firsts"]):
                        if merged and f <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], f + m + threshold)
                        else:
                            merged.append([f, f + m + threshold])
                for i, j in merged:
                    lo, hi = units.edges(i, j)
                    kept.append(raw[end:lo])
                    end, spans = hi, spans + 1
                kept.append(raw[end:])
                left = b"".join(kept)
                for column, value in zip(out, (tid.as_py(), len(raw) - len(left), spans, left), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["tid", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(run, "tid binary, n_removed long, n_spans long, kept binary")


def text_id(text_col: str):
    return F.unhex(F.substring(F.sha2(text_bytes(text_col), 256), 1, 32))


def repeated_windows(df: DataFrame, text_col: str = "text", unit: str = "bytes", threshold: int = 400) -> DataFrame:
    """The texts that hold repeated windows: ``tid`` (``text_id``), ``n_removed`` bytes, ``n_spans`` and ``kept`` bytes.

    A window is ``threshold`` bytes, or words, that also start at another place, in the same text or in
    another; all its places are removed. Words are compared without the white space between them. A null or
    empty text, one shorter than a window and one without repeated windows have no row. Rows that repeat
    are copies of a text, so a text of at least a window goes whole. An empty table gives an empty result.
    ``threshold`` must be at least twice the gram (32 bytes, 8 words).
    """
    if threshold < 2 * GRAM[unit]:
        raise ValueError(f"a window of {threshold} {unit} is shorter than two grams of {GRAM[unit]}")
    small_batches(df.sparkSession)
    docs = df.select(text_id(text_col).alias("tid"), text_bytes(text_col).alias("body"), F.monotonically_increasing_id().alias("row")).where(F.octet_length("body") >= threshold)
    # Texts move once, to buckets in which all later joins find them; copies are told by narrow rows.
    rows = bucketed(docs, "row", "suffix-rows")
    firsts = materialize(rows.groupBy("tid").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies")), "suffix-texts")
    texts = Texts(rows.select("row", "body"), firsts)
    parts = materialize(all_runs(texts.all(), unit, threshold), "suffix-runs")
    repeated, rest = divide(parts)
    discard(parts)
    found = order_all(texts, rest, unit, threshold)
    discard(rest)
    windows = reduce(DataFrame.unionByName, found).distinct().select("tid", F.array("first").alias("firsts"), "more")
    out = materialize(cut_out(texts, repeated.unionByName(windows), unit, threshold), "suffix-cut")
    discard(rows, firsts, repeated, *found)
    return out


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes", threshold: int = 400) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes; null where nothing was removed).

    Null ids and repeated rows pass through, each with its text's values. Only the two named columns are read.
    """
    changed = repeated_windows(df, text_col, unit, threshold)
    rows = df.select(F.col(f"`{id_col}`").alias("id"), text_id(text_col).alias("tid"), F.length(text_bytes(text_col)).cast("long").alias("n_bytes"))
    out = rows.join(changed, "tid", "left")
    return out.select(F.col("id").alias(id_col), "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = repeated_windows(docs).select("tid", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"))
    rows = docs.select("doc_id", text_id("text").alias("tid"), F.length(text_bytes("text")).cast("long").alias("n_bytes"), F.sha2(text_bytes("text"), 256).alias("whole"))
    out = rows.join(changed, "tid", "left")
    return out.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("sha", "whole").alias("kept_sha256"))
