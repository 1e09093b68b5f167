import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import masks, pixels, selection


def pictures(seed, n=40):
    rng = np.random.default_rng(seed)
    for k in range(n):
        h, w = rng.integers(1, 9, 2)
        make = lambda p: rng.random((h, w)) < p
        yield k, make([0, 0.2, 0.6, 1][k % 4]), make([0.1, 0.5, 0][k % 3])


@pytest.mark.parametrize("px", [0, 1, 3])
def test_runs_equal_the_array_form(spark, px):
    every = list(pictures(px))
    rows = spark.createDataFrame([(k, a.ravel().tolist(), b.ravel().tolist(), masks.runs_of(a), masks.runs_of(b), a.shape[1], a.shape[0]) for k, a, b in every], f"k int, a array<boolean>, b array<boolean>, ra {masks.RUNS}, rb {masks.RUNS}, w int, h int")
    a, b, w, h = F.col("ra"), F.col("rb"), F.col("w"), F.col("h")
    got = rows.select(
        "k", (masks.of_booleans(F.col("a")) == a).alias("same"), (masks.to_booleans(a, w * h) == F.col("a")).alias("back"), masks.to_booleans(masks.union(a, b), w * h).alias("union"),
        masks.to_booleans(masks.minus(a, b, w * h), w * h).alias("minus"), masks.overlap_share(a, b).alias("share"), selection.overlap_share(F.col("a"), F.col("b")).alias("share_by_arrays"),
        masks.to_booleans(masks.dilated(a, w, h, px), w * h).alias("dilated"), masks.box(a, w).alias("box"), masks.without_prop(a, b, w, h, px).alias("left"), masks.area(a).alias("area"), w.alias("w"), h.alias("h"),
    ).withColumn("kept", masks.to_booleans(F.col("left.mask"), w * h))
    found = {r.k: r for r in got.collect()}
    for k, x, y in every:
        r = found[k]
        assert r.same and r.back and r.area == x.sum() and r.share == r.share_by_arrays
        assert r.union == (x | y).ravel().tolist() and r.minus == (x & ~y).ravel().tolist() and r.dilated == pixels.dilate(x, px).ravel().tolist()
        kept, share = pixels.without_prop(x, y, px)
        assert r.kept == kept.ravel().tolist() and r.left.share == share and r.left.outcome == ("absent" if not y.any() else "outside" if share < 0.1 else "subtracted")
        ys, xs = np.nonzero(x)
        assert r.box is None if not len(ys) else tuple(r.box) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)


def test_instances_and_terms_of_an_image(spark):
    rows = spark.createDataFrame([(1, [(0, 4), (9, 12)]), (1, [(4, 6)]), (1, []), (2, None), (3, [(5, 7), (6, 9), (1, 2)])], f"image int, mask {masks.RUNS}")
    got = {r.image: [tuple(x) for x in r.mask] for r in masks.union_of(rows, "image").collect()}
    assert got == {1: [(0, 6), (9, 12)], 2: [], 3: [(1, 2), (5, 9)]}
    assert masks.union_of(rows.limit(0), "image").collect() == []


def test_the_merge_rule_at_its_limit(spark):
    rows = spark.createDataFrame([([(0, 10)], [(9, 19)]), ([(0, 10)], [(9, 20)])], f"s {masks.RUNS}, e {masks.RUNS}")
    left = masks.without_prop(F.col("s"), F.col("e"), F.lit(20), F.lit(1))
    assert [r.outcome for r in rows.select(left.alias("x")).select("x.*").collect()] == ["subtracted", "outside"]
