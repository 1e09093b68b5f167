import io
import os
import random
import stat
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from loomset import cli
from loomset.operators import pixels, stats
from loomset.sources import files, headers, packages, sinks
from tests.test_files_and_models import folder, noise  # noqa: F401


def padded_jpeg(w, h, pad):
    """Comments of the longest kind before the frame, and a long body behind it."""
    comments = b"".join(b"\xff\xfe" + (65535).to_bytes(2, "big") + b"c" * 65533 for _ in range(pad))
    frame = b"\xff\xc0" + (11).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + comments + frame + b"\x00" * 300_000


def far_tiff(w, h):
    body = b"\0" * 500_000
    tags = b"".join(struct.pack("<HHII", tag, 4, 1, v) for tag, v in ((256, w), (257, h)))
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", 2) + tags


def test_headers_take_a_few_bytes_of_each_image(spark, tmp_path):
    (tmp_path / "a.PNG").write_bytes(pixels.write_png(noise(1, 90, 120)))
    (tmp_path / "b.jpg").write_bytes(padded_jpeg(640, 480, 9))
    (tmp_path / "c.tiff").write_bytes(far_tiff(70, 50))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 100_000)
    (tmp_path / "empty.webp").write_bytes(b"")
    (tmp_path / "a.txt").write_text("has one")
    (tmp_path / "huge.raw").write_bytes(b"\0" * 1_000_000)
    (tmp_path / "gone.png").symlink_to(tmp_path / "nowhere")
    os.mkdir(tmp_path / "sub.png")
    got = {r.name: r for r in headers.image_headers(spark, str(tmp_path), files_per_task="2").collect()}
    assert {k: (r.w, r.h) for k, r in got.items() if r.w} == {"a.PNG": (120, 90), "b.jpg": (640, 480), "c.tiff": (70, 50)}
    assert got.keys() - {"gone.png"} == {"a.PNG", "b.jpg", "c.tiff", "bad.png", "empty.webp"} and got["a.PNG"].stem == "a" and got["a.PNG"].ext == "png"
    assert got["b.jpg"].length > 800_000 and max(r.bytes_read for r in got.values()) <= 12 * 2 * headers.BLOCK
    assert got["c.tiff"].bytes_read <= 3 * headers.BLOCK and got["a.PNG"].bytes_read == headers.BLOCK
    only = headers.image_headers(spark, str(tmp_path), extensions="jpg").collect()
    assert [r.name for r in only] == ["b.jpg"]
    found = stats.dataset_stats(headers.sized_pairs(spark, str(tmp_path))).first()
    assert (found.n_images, found.n_captioned, found.min_long_side, found.max_long_side) == (3, 1, 70, 640)
    assert "3 images" in cli.run(cli.parser().parse_args(["stats", str(tmp_path)]))
    assert headers.image_sizes(spark, str(tmp_path / "sub.png")).collect() == []


def test_peeked_bytes_are_those_of_the_file():
    data, rnd = bytes(random.Random(1).randrange(256) for _ in range(1000)), random.Random(2)
    for _ in range(200):
        head, (i, j) = headers.Peeked(io.BytesIO(data), len(data)), sorted((rnd.randint(0, 1000), rnd.randint(0, 1010)))
        assert head[i:j] == data[i:j] and head[min(i, 999)] == data[min(i, 999)] and len(head) == 1000


def rows_of(spark, n, parts=5):
    return spark.createDataFrame([(f"f{i:05d}.txt", f"text {i} é " * (i % 40)) for i in range(n)], "name string, content string").repartition(parts)


def test_archives_are_joined_from_the_tasks_parts(spark, tmp_path):
    path = tmp_path / "all.zip"
    sinks.write_joined(rows_of(spark, 700), str(path), F.col("name"), "archive")
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [f"f{i:05d}.txt" for i in range(700)]
        assert z.read("f00039.txt").decode() == "text 39 é " * 39
    with pytest.raises(FileExistsError):
        sinks.write_joined(rows_of(spark, 3), str(path), F.col("name"), "archive")
    assert zipfile.ZipFile(path).namelist()[-1] == "f00699.txt" and os.listdir(tmp_path) == ["all.zip"]
    sinks.write_joined(rows_of(spark, 3).limit(0), str(tmp_path / "none.zip"), F.col("name"), "archive")
    assert zipfile.ZipFile(tmp_path / "none.zip").namelist() == []
    sinks.write_joined(rows_of(spark, 50), str(tmp_path / "lines"), F.col("name").desc())
    assert (tmp_path / "lines").read_text().startswith("text 39 é " * 2) is False and (tmp_path / "lines").read_text() == "".join(f"text {i} é " * (i % 40) for i in range(49, -1, -1))


def test_directories_of_large_archives(tmp_path):
    """Members beyond 4 GiB and 65,535 entries, with a hole for the bytes before them."""
    far, data = (1 << 32) + 10, b"content"
    entry, body = sinks.member(b"far.txt", data, far)
    many = [(b"%05d" % i, 0, 2, 0, 0) for i in range(70_000)]
    with open(tmp_path / "large.zip", "wb") as out:
        out.seek(far)
        out.write(body)
        out.write(sinks.directory(iter([*many, entry]), far + len(body)))
    with zipfile.ZipFile(tmp_path / "large.zip") as z:
        assert len(z.namelist()) == 70_001 and z.read("far.txt") == data


@pytest.mark.parametrize("form", ["folder", "lines", "archive", "package"])
def test_a_failed_job_leaves_nothing(spark, tmp_path, form):
    (tmp_path / "home").mkdir()
    (tmp_path / "home" / "f00001.txt").write_text("before")
    rows = rows_of(spark, 40).withColumn("content", F.when(F.col("name") == "f00033.txt", F.raise_error(F.lit("torn"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="torn|No such file"):
        if form == "folder":
            sinks.write_folder(rows, str(tmp_path / "home"))
        elif form == "package":
            packages.package(spark.createDataFrame([(1, "/nowhere/a.png", "x")], "ord long, path string, caption string"), str(tmp_path), "set")
        else:
            sinks.write_joined(rows, str(tmp_path / "out"), F.col("name"), form)
    assert os.listdir(tmp_path) == ["home"] and os.listdir(tmp_path / "home") == ["f00001.txt"] and (tmp_path / "home" / "f00001.txt").read_text() == "before"


def test_folders_and_sidecars(spark, tmp_path):
    sinks.write_folder(rows_of(spark, 30), str(tmp_path / "new"))
    assert len(os.listdir(tmp_path / "new")) == 30 and os.listdir(tmp_path) == ["new"]
    sinks.write_folder(spark.createDataFrame([("f00001.txt", b"\0again")], "name string, content binary"), str(tmp_path / "new"))
    assert (tmp_path / "new" / "f00001.txt").read_bytes() == b"\0again" and len(os.listdir(tmp_path / "new")) == 30
    sinks.write_sidecars(spark.createDataFrame([("a.b.png", "x é"), ("c.jpg", ""), ("d.jpg", None)], "name string, caption string"), str(tmp_path / "new"))
    assert (tmp_path / "new" / "a.b.txt").read_text() == "x é" and (tmp_path / "new" / "c.txt").read_text() == "" and not (tmp_path / "new" / "d.txt").exists()
    assert stat.S_ISREG(os.stat(tmp_path / "new" / "c.txt").st_mode)


def test_packages_zipped_by_tasks(spark, folder, tmp_path):  # noqa: F811
    one = packages.package(files.pairs(spark, str(folder)), str(tmp_path / "out"), "My Set!", "trig é")
    with zipfile.ZipFile(packages.zipped(one, spark)) as z, zipfile.ZipFile(packages.zipped(one)) as same:
        assert z.namelist() == same.namelist() == sorted(z.namelist()) and all(z.read(n) == same.read(n) for n in z.namelist())
    assert sorted(os.listdir(tmp_path / "out")) == ["my-set-dataset", "my-set-dataset-2.zip", "my-set-dataset.zip"]
