"""Masks as run-length columns: union, difference, overlap, dilation and box by merging runs.

A mask is ``array<struct<start: int, stop: int>>``: runs of masked pixels by their place in row order, in
order, none of them touching. A mask of a large picture is some thousand runs instead of some million
booleans, and all work on it stays in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: a prop of which less lies in the subject is outside of it already.
MERGED_SHARE = 0.10
RUNS = "array<struct<start: int, stop: int>>"


def _run(start: Column, stop: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def _zipped(starts: Column, stops: Column) -> Column:
    return F.filter(F.zip_with(starts, stops, _run), lambda r: r["start"] < r["stop"])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, wherever and however often it is used; lambdas would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _both(a: Column, b: Column, use: Callable[[Column, Column], Column]) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: use(p["a"], p["b"]))


def of_booleans(mask: Column) -> Column:
    """The runs of array<boolean>; nulls aren't masked."""

    def runs(m: Column) -> Column:
        at = lambda i: F.coalesce(F.get(m, i), F.lit(False))
        spots = F.sequence(F.lit(0), F.size(m))
        return _zipped(F.filter(spots, lambda i: at(i) & ~at(i - 1)), F.filter(spots, lambda i: at(i - 1) & ~at(i)))

    return let(mask, runs)


def to_booleans(runs: Column, size: Column) -> Column:
    inside = lambda i: F.exists(runs, lambda r: (r["start"] <= i) & (i < r["stop"]))
    return F.when(size > 0, F.transform(F.sequence(F.lit(0), size - 1), inside)).otherwise(F.array().cast("array<boolean>"))


def runs_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """The runs of a mask as a segmenter gives it."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8).ravel(), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def merged(runs: Column) -> Column:
    """Runs in any order, overlapping or not, as a mask.

    With starts and stops each in order, a merged run begins where a start lies beyond the stop before it:
    so two sorts do, however many runs there are.
    """

    def ends(starts: Column, stops: Column) -> Column:
        begin = F.filter(starts, lambda x, i: (i == 0) | (x > F.get(stops, i - 1)))
        return _zipped(begin, F.filter(stops, lambda x, i: F.coalesce(F.get(starts, i + 1) > x, F.lit(True))))

    return let(runs, lambda r: _both(F.array_sort(F.transform(r, lambda x: x["start"])), F.array_sort(F.transform(r, lambda x: x["stop"])), ends))


def union(*masks: Column) -> Column:
    """Null masks hold nothing."""
    return merged(F.concat(*(F.coalesce(m, F.array().cast(RUNS)) for m in masks)))


def union_of(rows: DataFrame, by: str, mask: str = "mask") -> DataFrame:
    """(by, mask): one mask of all instances and all terms of an image; null masks hold nothing."""
    return rows.groupBy(by).agg(merged(F.flatten(F.collect_list(mask))).alias("mask"))  # bounded by an image's instances


def complement(mask: Column, size: Column) -> Column:
    return let(mask, lambda m: _zipped(F.concat(F.array(F.lit(0)), F.transform(m, lambda r: r["stop"])), F.concat(F.transform(m, lambda r: r["start"]), F.array(size.cast("int")))))


def minus(mask: Column, other: Column, size: Column) -> Column:
    return complement(union(complement(mask, size), other), size)


def area(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"])


def overlap_share(subject: Column, exclude: Column) -> Column:
    """How much of the excluded part lies in the subject; 0 where nothing is excluded."""

    def share(s: Column, e: Column) -> Column:
        return let(area(e), lambda n: F.when(n > 0, (area(s) + n - area(union(s, e))) / n).otherwise(0.0))

    return _both(subject, exclude, share)


def _in_rows(mask: Column, width: Column) -> Column:
    """Runs cut at the ends of rows."""
    rows = lambda r: F.sequence(F.floor(r["start"] / width), F.floor((r["stop"] - 1) / width))
    return F.flatten(F.transform(mask, lambda r: F.transform(rows(r), lambda y: _run(F.greatest(r["start"], y * width), F.least(r["stop"], (y + 1) * width)))))


def dilated(mask: Column, width: Column, height: Column, px: int) -> Column:
    """Grown by ``px`` in both directions, within the picture; 0 or less changes nothing."""
    if px <= 0:
        return mask
    around = F.sequence(F.lit(-px), F.lit(px))

    def grown(r: Column) -> Column:
        y = F.floor(r["start"] / width)
        left, right = F.greatest(F.lit(0), r["start"] - y * width - px), F.least(width, r["stop"] - y * width + px)
        return F.transform(F.filter(around, lambda d: (y + d >= 0) & (y + d < height)), lambda d: _run((y + d) * width + left, (y + d) * width + right))

    return merged(F.flatten(F.transform(_in_rows(mask, width), grown)))


def box(mask: Column, width: Column) -> Column:
    """struct<left, top, right, bottom>, the last two beyond the box; null for an empty mask."""

    def bounds(rows: Column) -> Column:
        x = lambda at: F.transform(rows, lambda r: r[at] - F.floor(r["start"] / width) * width)
        y = F.transform(rows, lambda r: F.floor(r["start"] / width))
        return F.when(F.size(rows) > 0, F.struct(F.array_min(x("start")).cast("int").alias("left"), F.array_min(y).cast("int").alias("top"), F.array_max(x("stop")).cast("int").alias("right"), (F.array_max(y) + 1).cast("int").alias("bottom")))

    return let(_in_rows(mask, width), bounds)


def without_prop(subject: Column, exclude: Column, width: Column, height: Column, px: int = 0, share: float = MERGED_SHARE) -> Column:
    """struct<mask, share, outcome>: the subject without a prop that is merged into it.

    A prop that wasn't found is "absent"; one of which less than ``share`` lies in the subject is "outside", and
    taking it away could only take the subject's own pixels; else it is "subtracted", grown by ``px``.
    """

    def left(s: Column, e: Column) -> Column:
        def told(p: Column) -> Column:
            taken = F.when(p["outcome"] == "subtracted", minus(s, dilated(e, width, height, px), width * height)).otherwise(s)
            return F.struct(taken.alias("mask"), p["share"].alias("share"), p["outcome"].alias("outcome"))

        outcome = lambda x: F.when(F.size(e) == 0, "absent").when(x < share, "outside").otherwise("subtracted")
        return let(let(overlap_share(s, e), lambda x: F.struct(x.alias("share"), outcome(x).alias("outcome"))), told)

    return _both(subject, exclude, left)
