"""Near duplicates by perceptual hash.

Rows with equal hashes are one class with a count, told by its least row. Pairs of classes are found by
multi-index hashing: within a distance, two hashes are within a smaller one in one of a few wide bands,
and meet there half-way, so an equi-join on flipped values of bands finds them all; groups are the greedy cover in input order: each row not yet taken starts a group and takes all later
rows within the distance that are not taken.
"""

from __future__ import annotations

from functools import partial, reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomset.store import discard, materialize

#: Pairs that a key may bring together before its classes meet under further bits.
HOT_PAIRS = 1 << 20
#: Keys of a hash in one band: with more, bands are made narrower.
MOST_KEYS = 512


def difference_hash(grid: Column, rows: int, cols: int) -> Column:
    """Bits left < right for each pair of neighbours in a row, the first bit highest; rows * (cols - 1) bits, 64 at most."""
    spots = [r * cols + c for r in range(rows) for c in range(cols - 1)]
    if len(spots) > 64:
        raise ValueError("more than 64 bits")
    at = F.array(*map(F.lit, spots))
    return F.aggregate(at, F.lit(0).cast("long"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(F.get(grid, i) < F.get(grid, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("long")))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def classes(hashes: DataFrame) -> DataFrame:
    """(hash, ord, n): the least row of each hash, and how many rows have it; null hashes are left out."""
    return hashes.where("hash IS NOT NULL").groupBy("hash").agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def ball(width: int, radius: int) -> list[int]:
    """All numbers of ``width`` bits of which at most ``radius`` are set: what a band's value is flipped by."""
    return [sum(1 << i for i in spots) for k in range(radius + 1) for spots in combinations(range(width), k)]


def plan_bands(spans: list[tuple[int, int]], distance: int, parts: int) -> list[tuple[list[tuple[int, int]], int, int]]:
    """Bands of the bits in ``spans`` (offset, width): (spans, width, radius) each.

    Hashes within the distance are within the radius in one band at least: were they beyond it in all, the
    bands' differences would sum up to more than the distance.
    """
    spots = [o + i for o, w in spans for i in range(w)]
    edges = [round(i * len(spots) / parts) for i in range(parts + 1)]
    low, wider = distance // parts, distance % parts + 1
    bands = []
    for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False)):
        runs: list[tuple[int, int]] = []
        for spot in spots[lo:hi]:
            if runs and sum(runs[-1]) == spot:
                runs[-1] = runs[-1][0], runs[-1][1] + 1
            else:
                runs.append((spot, 1))
        if (radius := low if k < wider else low - 1) >= 0:
            bands.append((runs, hi - lo, min(radius, hi - lo)))
    return bands


def parts_of(bits: int, distance: int, wide: int) -> int:
    """How many bands: as few as keys of ``wide`` bits allow, but enough that no hash has over ``MOST_KEYS`` keys in a band."""
    parts = max(1, min(bits // wide, distance + 1))
    while sum(comb(-(-bits // parts), k) for k in range(-(-(distance // parts) // 2) + 1)) > MOST_KEYS:
        parts += 1
    return parts


def _value(h: Column, spans: list[tuple[int, int]]) -> Column:
    out, at = F.lit(0).cast("long"), 0
    for offset, width in spans:
        mask = -1 if width == 64 else (1 << width) - 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, offset).bitwiseAND(F.lit(mask)), at))
        at += width
    return out


def _flip(band: Column, value: Column, mask: Column) -> Column:
    return F.struct(band.alias("band"), value.bitwiseXOR(mask).alias("value"))


def _keyed(rows: DataFrame, bands: list[tuple[list[tuple[int, int]], int, int]], greater: bool) -> DataFrame:
    """Each row under its keys (band, value). A pair meets half-way: the lesser row flips up to one half of a band's radius, the greater one the rest."""
    every = []
    for i, (spans, width, radius) in enumerate(bands):
        flips = F.from_json(F.lit(str(ball(width, radius // 2 if greater else radius - radius // 2))), "array<bigint>")
        band, value = F.lit(i), _value(F.col("hash"), spans)
        every.append(F.transform(flips, partial(_flip, band, value)))
    return rows.withColumn("key", F.explode(F.concat(*every))).select("*", "key.band", "key.value").drop("key")


def near_candidates(known: DataFrame, distance: int = 5, bits: int = 64, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Pairs (a, n_a, hash_a, b, n_b, hash_b) of classes a < b that meet under a key, some more than once; all within the distance are among them.

    Keys have 20 bits or more and as many as tell the classes apart, fewer where a distance is large for the bits. Where a key brings more than
    ``hot_pairs`` pairs together, as for pictures that share a plain part, its classes meet under the bands of
    their other bits instead, which must be within the distance too.
    """
    wide = max(20, (known.count() + 1).bit_length())
    bands = plan_bands([(0, bits)], distance, parts_of(bits, distance, wide))
    left, right = (materialize(_keyed(known, bands, greater), "dedupe-keys") for greater in (False, True))
    on = ["band", "value"]
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("l")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias("r")), on)
    hot = materialize(sizes.where(F.col("l") * F.col("r") > hot_pairs).select(*on), "dedupe-hot")
    name = lambda df, x: df.select(*on, *([c for c in df.columns if c.startswith("inner")]), F.col("ord").alias(x), F.col("n").alias(f"n_{x}"), F.col("hash").alias(f"hash_{x}"))

    def met(one: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
        return name(one, "a").join(name(other, "b"), keys).where("a < b").select("a", "n_a", "hash_a", "b", "n_b", "hash_b")

    if hot.isEmpty():
        return met(left, right, on)
    out = met(left.join(hot, on, "left_anti"), right.join(hot, on, "left_anti"), on)
    for i, (spans, width, _) in enumerate(bands):
        rest = [(0, bits)]
        for o, w in spans:
            rest = [piece for ro, rw in rest for piece in ((ro, min(rw, o - ro)), (max(ro, o + w), ro + rw - max(ro, o + w))) if piece[1] > 0]
        inner = plan_bands(rest, distance, parts_of(bits - width, distance, 20))
        sides = (_keyed(side.join(hot.where(F.col("band") == i), on, "left_semi").withColumnsRenamed({"band": "outer", "value": "outer_value"}), inner, greater) for side, greater in ((left, False), (right, True)))
        one, other = (s.withColumnsRenamed({"band": "inner_band", "value": "inner_value", "outer": "band", "outer_value": "value"}) for s in sides)
        out = out.unionByName(met(one, other, [*on, "inner_band", "inner_value"]))
    return out


def near_pairs(hashes: DataFrame, distance: int = 5, bits: int = 64, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b, distance) for classes a < b of (ord, hash) within the distance.

    Each class is told by its least row, with the number of its rows: copies are never expanded into
    pairs. Null hashes are left out.
    """
    known = materialize(classes(hashes), "dedupe-classes")
    apart = hamming(F.col("hash_a"), F.col("hash_b"))
    near = near_candidates(known, distance, bits, hot_pairs).withColumn("distance", apart).where(F.col("distance") <= distance)
    return near.select("a", "n_a", "b", "n_b", "distance").distinct()


def near_groups(hashes: DataFrame, distance: int = 5, bits: int = 64) -> DataFrame:
    """(seed, member), the seed among its members, for groups of two rows or more.

    All rows of a class share its fate, so the choice is made among classes. Every class with no open
    lesser neighbour is a seed; its neighbours are settled, and the next round looks at what is open.
    Rounds are tables of the shared folder and no component meets in one task. In the end a class goes
    to its least seed, as in the greedy order. Random orders take a number of rounds that grows like
    the logarithm of the classes; a chain in order takes one for two links.
    """
    pairs = materialize(near_pairs(hashes, distance, bits).select("a", "b"), "dedupe-pairs")
    unsettled, settled = pairs, []
    while True:
        found = unsettled.select(F.col("a").alias("seed")).distinct().join(unsettled.select(F.col("b").alias("seed")).distinct(), "seed", "left_anti")
        found = materialize(found, "dedupe-seeds")
        if found.isEmpty():
            discard(found)
            break
        near = materialize(unsettled.join(found, F.col("a") == F.col("seed"), "left_semi").select(F.col("b").alias("seed")).distinct(), "dedupe-settled")
        gone = found.unionByName(near)
        left = unsettled.join(gone, F.col("a") == F.col("seed"), "left_anti").join(gone, F.col("b") == F.col("seed"), "left_anti")
        left = materialize(left, "dedupe-open")
        settled.append(near)
        discard(found, *([unsettled] if unsettled is not pairs else []))
        unsettled = left
    known = materialize(classes(hashes), "dedupe-classes")
    taken = known.select(F.col("ord").alias("b"), F.lit(None).cast("long").alias("seed")).limit(0)
    if settled:
        # Seeds are all classes that no seed settled, those too whose neighbours all went to others.
        seeds = pairs.join(reduce(DataFrame.unionByName, settled), F.col("a") == F.col("seed"), "left_anti")
        taken = seeds.groupBy("b").agg(F.min("a").alias("seed"))
    own = known.join(taken, F.col("ord") == F.col("b"), "left").select("hash", "n", F.coalesce("seed", "ord").alias("seed"))
    sizes = own.groupBy("seed").agg(F.sum("n").alias("size")).where("size > 1").select("seed")
    own = materialize(own.join(sizes, "seed").select("hash", "seed"), "dedupe-groups")
    discard(pairs, known, *settled, *([unsettled] if unsettled is not pairs else []))
    return hashes.join(own, "hash").select("seed", F.col("ord").alias("member"))
