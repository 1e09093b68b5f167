"""Image measures on grids of luminance: arrays of rows x columns values, row-major."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)


def _variance(values: Column) -> Column:
    """Population variance in two passes; 0 for no values."""
    spread = F.transform(F.array(_mean(values)), lambda m: F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(values))
    return F.when(F.size(values) > 0, spread[0]).otherwise(F.lit(0.0))


def mean_luminance(grid: Column) -> Column:
    return _mean(grid)


def contrast(grid: Column) -> Column:
    return F.sqrt(_variance(grid))


def exposure_flags(mean: Column, std: Column, dark: float = 40, bright: float = 220, flat: float = 25) -> Column:
    return F.array_compact(F.array(F.when(mean <= dark, "dark").when(mean >= bright, "bright"), F.when(std <= flat, "low contrast")))


def laplacian_valid(grid: Column, rows: int, cols: int) -> Column:
    """Variance of the 4-neighbour Laplacian inside the borders; below 3 x 3 it is 0."""
    if rows < 3 or cols < 3:
        return F.lit(0.0)
    at = F.filter(F.sequence(F.lit(cols), F.lit(cols * (rows - 1) - 1)), lambda i: (i % cols != 0) & (i % cols != cols - 1))
    return _variance(F.transform(at, lambda i: F.get(grid, i - cols) + F.get(grid, i + cols) + F.get(grid, i - 1) + F.get(grid, i + 1) - 4.0 * F.get(grid, i)))


def laplacian_wrap(grid: Column, rows: int, cols: int) -> Column:
    """The same with edges that wrap around."""
    n = rows * cols
    left = lambda i: F.when(i % cols == 0, i + cols - 1).otherwise(i - 1)
    right = lambda i: F.when(i % cols == cols - 1, i - cols + 1).otherwise(i + 1)
    value = lambda i: F.get(grid, F.pmod(i - cols, F.lit(n)).cast("int")) + F.get(grid, F.pmod(i + cols, F.lit(n)).cast("int")) + F.get(grid, left(i)) + F.get(grid, right(i)) - 4.0 * F.get(grid, i)
    return _variance(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value))


def is_blurry(score: Column, limit: float = 100.0) -> Column:
    return score < limit


def restore_reason(long_side: Column, ext: Column, sharpness: Column, target: int, limit: float = 120.0) -> Column:
    """The first that holds: too small, a lossy format, soft."""
    return F.when(
        long_side < target, F.concat(F.lit("long side "), long_side.cast("string"), F.lit(f"px < target {target}px"))
    ).when(F.lower(ext).isin(".jpg", ".jpeg", ".webp"), "lossy source format").when(sharpness < limit, "low sharpness (blur/grain)").otherwise("")


def resized(w: Column, h: Column, target: int) -> tuple[Column, Column]:
    """Sides when the long one becomes ``target``, rounded half to even."""
    long_side = F.greatest(w, h)
    side = lambda s: F.bround(s * (F.lit(float(target)) / long_side)).cast("int")
    return side(w), side(h)


def content_box(grid: Column, cols: int, background: float, tolerance: float) -> Column:
    """struct<top, left, bottom, right> of values off the background, null for none; ends are exclusive."""
    at = F.filter(F.transform(grid, lambda x, i: F.when(F.abs(x - background) > tolerance, i)), lambda i: i.isNotNull())
    row, col = F.transform(at, lambda i: F.floor(i / cols)), F.transform(at, lambda i: i % cols)
    box = F.struct(F.array_min(row).alias("top"), F.array_min(col).alias("left"), (F.array_max(row) + 1).alias("bottom"), (F.array_max(col) + 1).alias("right"))
    return F.when(F.size(at) > 0, box)


def overlap_share(subject: Column, exclude: Column) -> Column:
    """The share of ``exclude`` (array of booleans) inside ``subject``, 0 for an empty mask."""
    both = F.size(F.filter(F.arrays_zip(subject.alias("s"), exclude.alias("e")), lambda x: x["s"] & x["e"]))
    n = F.size(F.filter(exclude, lambda x: x))
    return F.when(n > 0, both / n).otherwise(F.lit(0.0))
