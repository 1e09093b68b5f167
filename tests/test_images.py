import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset.operators import dedupe, export, quality, stats
from loomset.plans import shots
from loomset.sources import files


def test_quality_measures_agree_with_numpy(spark):
    grid = np.random.default_rng(5).uniform(0, 255, (6, 7))
    df = spark.createDataFrame([(grid.ravel().tolist(),)], "g array<double>")
    valid = grid[:-2, 1:-1] + grid[2:, 1:-1] + grid[1:-1, :-2] + grid[1:-1, 2:] - 4 * grid[1:-1, 1:-1]
    wrap = sum(np.roll(grid, s, a) for s in (1, -1) for a in (0, 1)) - 4 * grid
    got = df.select(quality.laplacian_valid(F.col("g"), 6, 7).alias("v"), quality.laplacian_wrap(F.col("g"), 6, 7).alias("w"), quality.contrast(F.col("g")).alias("s"), quality.laplacian_valid(F.col("g"), 2, 21).alias("z")).first()
    assert got.v == pytest.approx(valid.var()) and got.w == pytest.approx(wrap.var()) and got.s == pytest.approx(grid.std()) and got.z == 0.0


def test_flags_and_reasons(spark):
    rows = spark.createDataFrame([(5.0, 5.0), (250.0, 30.0), (128.0, 128.0)], "m double, s double")
    assert [r.f for r in rows.select(quality.exposure_flags(F.col("m"), F.col("s")).alias("f")).collect()] == [["dark", "low contrast"], ["bright"], []]
    reason = quality.restore_reason(F.lit(2000), F.lit(".JPG"), F.lit(1.0), 1024)
    assert spark.range(1).select(reason.alias("r")).first().r == "lossy source format"


def test_near_groups_are_greedy_not_components(spark):
    rows = spark.createDataFrame([(0, 0b0), (1, 0b111), (2, 0b111111), (3, 0b0), (4, -1)], "ord long, hash long")
    # Pairs are those of classes of equal hashes: rows 0 and 3 are one class of two.
    assert {tuple(r) for r in dedupe.near_pairs(rows, 3).collect()} == {(0, 2, 1, 1, 3), (1, 1, 2, 1, 3)}
    assert {(r.seed, r.member) for r in dedupe.near_groups(rows, 3).collect()} == {(0, 0), (0, 1), (0, 3)}


def test_stats(spark):
    images = spark.createDataFrame([(1536, 1024, True), (1001, 1000, True), (64, 64, False)], "w int, h int, has_caption boolean")
    got = stats.dataset_stats(images).first()
    assert (got.n_images, got.n_captioned, got.min_long_side, got.max_long_side, got.suggested_steps, got.num_repeats) == (3, 2, 64, 1536, 1000, 133)
    assert {r.aspect: r.n for r in stats.aspect_histogram(images).collect()} == {"3:2": 1, "3:4": 1, "square": 1}
    empty = stats.dataset_stats(images.limit(0)).first()
    assert (empty.n_images, empty.max_long_side, empty.suggested_steps) == (0, 0, 1000)
    bucket = lambda r, m: spark.range(1).select(stats.buckets(F.lit(r), F.lit(m)).alias("b")).first().b
    assert bucket(1024, 800) == [512, 768] and bucket(640, 2000) == [512, 640] and bucket(1024, 100) == [1024]


def test_export(spark):
    rows = spark.createDataFrame([(3, "c"), (1, " "), (2, None)], "ord long, caption string")
    assert [r.s for r in rows.select(export.status(F.col("caption")).alias("s")).collect()] == ["ready", "empty", "missing"]
    many = spark.range(0, 230).select((F.col("id") * 7 % 230).alias("ord"))
    assert all(r.number == r.ord + 1 for r in export.numbered(many).collect())
    assert [r.f for r in spark.createDataFrame([(1,), (100,)], "n long").select(export.file_name(F.col("n"), F.lit(".png")).alias("f")).collect()] == ["01.png", "100.png"]


def test_plans(spark):
    plan = spark.createDataFrame([("a", "angle", "x", "y. Keep the same face", "red coat"), ("", "pose", "x", "y", ""), ("b", "pose", "x, wearing A HAT", "y", "a hat")], "id string, kind string, local_prompt string, cloud_prompt string, outfit string")
    done = {r.id: r for r in shots.without_props(shots.with_wardrobe(shots.clean_plan(plan))).collect()}
    assert set(done) == {"a", "b"} and done["a"].local_prompt == "x, wearing red coat"
    assert done["a"].cloud_prompt.startswith("y, wearing red coat. Keep the same face") and done["b"].local_prompt == "x, wearing A HAT" + shots.LOCAL_NO_PROPS
    again = shots.without_props(shots.with_wardrobe(shots.without_props(shots.with_wardrobe(shots.clean_plan(plan)))))
    assert {r.id: r.cloud_prompt for r in again.collect()} == {k: r.cloud_prompt for k, r in done.items()}
    assert len({r.outfit for r in shots.random_outfits(spark, 30, 1).collect()}) == 30


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def test_folder_with_sidecars(spark, tmp_path):
    for name in ("a.png", "b.PNG", "c.Png"):
        (tmp_path / name).write_bytes(png(3, 2))
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf  caf\xe9 \n")
    (tmp_path / "b.txt").write_bytes(b"  ")
    (tmp_path / "notes.md").write_text("x")
    got = [(r.ord, r.image, r.caption) for r in files.pairs(spark, str(tmp_path)).orderBy("ord").collect()]
    assert got == [(1, "a.png", "caf�"), (2, "b.PNG", ""), (3, "c.Png", None)]
    size = files.files(spark, str(tmp_path)).where("name = 'a.png'").select(files.png_size(F.col("content")).alias("s")).first().s
    assert (size.w, size.h) == (3, 2)
    (tmp_path / "tags.csv").write_text("id,name,category,post_count\n1,wolf,5,999\n")
    assert [(r.name, r.category) for r in files.tag_vocabulary(spark, str(tmp_path / "tags.csv")).collect()] == [("wolf", 5)]
