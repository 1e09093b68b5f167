import os
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomset import build
from loomset.operators import asof, captioning, pixels
from loomset.operators.answers import AnswerLog
from loomset.sources import files
from tests.test_answers import calls
from tests.test_files_and_models import folder, noise  # noqa: F401
from tests.test_generation import PLAN, shot


@pytest.mark.parametrize("parts", [1, 7])
def test_as_of_against_brute_force(spark, parts):
    day = datetime(2024, 1, 1)
    rows = [(i, (i * 7) % 3 or None, day + timedelta(hours=(i * 13) % 29) if i % 11 else None) for i in range(120)]
    past = [((i * 5) % 4 or None, day + timedelta(hours=(i * 3) % 31) if i % 9 else None, i) for i in range(60)]
    left, right = spark.createDataFrame(rows, "id int, k int, at timestamp"), spark.createDataFrame(past, "k int, at timestamp, value int")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.id: r.last and (r.last.k, r.last.at, r.last.value) for r in asof.as_of(left, right, "k", "at").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i, k, at in rows:
        want = max((p for p in past if p[0] == k and at and p[1] and p[1] <= at), key=lambda p: (p[1], p[2]), default=None)
        assert got[i] == want
    assert asof.as_of(left.limit(0), right, "k", "at").collect() == []
    assert {r.last for r in asof.as_of(left, right.limit(0), "k", "at").collect()} == {None}


def test_lists_by_age(spark):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    pulls = spark.createDataFrame([("x", at(0), ["p"]), ("x", at(30), []), ("y", at(100), ["q"])], "name string, at timestamp, found array<string>")
    asked = spark.createDataFrame([("x", at(24), None), ("x", at(25), ["l"]), ("x", at(40), None), ("y", at(1), []), ("y", at(2), ["l2"])], "name string, at timestamp, live array<string>")
    got = {(r.name, r.at): (r.origin, r.models) for r in asof.listed(asked, pulls, "name", "at", F.col("live"), "found", F.array(F.lit("s"))).collect()}
    assert got == {("x", at(24)): ("fresh", ["p"]), ("x", at(25)): ("live", ["l"]), ("x", at(40)): ("stale", ["p"]), ("y", at(1)): ("static", ["s"]), ("y", at(2)): ("live", ["l2"])}


def seeing(home, kind="cloud"):
    def opened(model, options):
        def answer(content):
            os.close(os.open(f"{home}/c-{os.urandom(6).hex()}", os.O_CREAT | os.O_EXCL))
            if not content.startswith(b"\x89PNG"):
                raise ValueError("no image")
            return f"a picture of {len(content)} bytes."

        return answer

    return captioning.Backend(kind, opened, "m")


def test_a_folder_is_captioned_in_one_call(spark, folder, tmp_path):  # noqa: F811
    asked = tmp_path / "asked"
    asked.mkdir()
    done = build.caption_folder(spark, str(folder), seeing(asked), skip_existing=True, trigger="zq", log=AnswerLog(str(tmp_path / "log")))
    assert [(r.name, r.error) for r in done.collect()] == [("b.png", ""), ("bad.png", "no image"), ("c.png", "")] and calls(asked) == {"c": 3}
    assert (folder / "a.txt").read_text() == "trig, standing" and (folder / "c.txt").read_text().startswith("zq, a picture") and not (folder / "bad.txt").exists()
    some = build.caption_folder(spark, str(folder), seeing(asked), only=["a.png"])
    assert some.count() == 1 and (folder / "a.txt").read_text().startswith("a picture")
    with pytest.raises(ValueError):
        build.caption_folder(spark, str(asked), seeing(asked))


def test_preview_takes_one_scan(spark, folder):  # noqa: F811
    seen = folder.parent / "seen"
    seen.mkdir()

    def decode(data):
        os.close(os.open(f"{seen}/d-{os.urandom(6).hex()}", os.O_CREAT | os.O_EXCL))
        return pixels.read_png(data)

    images = pixels.measured(files.files(spark, str(folder)).where("ext = 'png'"), decode)
    got = build.preview(files.pairs(spark, str(folder)), images, trigger="trig")
    assert calls(seen) == {"d": 4}, "each image is read once, bad.png too"
    assert {k: got.counts[k] for k in ("n", "n_ready", "n_empty", "n_missing", "n_unreadable", "n_missing_trigger", "min_long_side", "kind")} == {"n": 4, "n_ready": 1, "n_empty": 1, "n_missing": 2, "n_unreadable": 1, "n_missing_trigger": 0, "min_long_side": 64, "kind": "tags"}
    assert got.groups.count() == 2 and got.duplicate_captions.count() == 0 and got.rows.where("picked").count() == 1 and calls(seen) == {"d": 4}


def test_a_second_build_runs_no_stage(spark, folder, tmp_path):  # noqa: F811
    asked, made, home = tmp_path / "asked", tmp_path / "made", str(tmp_path / "run")
    asked.mkdir()
    made.mkdir()
    plan = spark.createDataFrame([shot("front"), shot("side", "front")], PLAN)

    def opened():
        def make(s):
            path = f"{made}/{s['id']}.png"
            with open(path, "wb") as out:
                out.write(pixels.write_png(noise(len(s["id"]))))
            return path

        return make

    recipe = build.Recipe("My Set", "zq", target=48, zipped=True)
    run = lambda r=recipe, p=plan: build.build(spark, str(folder), home, r, seeing(asked), p, opened)
    first = run()
    assert first.ran == ["preprocess", "generate", "caption", "export", "train"] and calls(asked) == {"c": 5}
    assert (first.done["preprocess"]["n"], first.done["preprocess"]["failed"], first.done["caption"]["n"]) == (3, 1, 5)
    package = first.done["export"]["out"]
    assert len([n for n in os.listdir(package) if n.endswith(".png")]) == 5 and open(f"{package}/05.txt").read().startswith("zq, a picture") and os.path.exists(first.done["export"]["archive"])
    assert run().ran == [] and calls(asked) == {"c": 5}
    shutil.rmtree(package)
    assert run().ran == ["export", "train"] and calls(asked) == {"c": 5}
    assert run(build.Recipe("My Set", "other", target=48)).ran == ["caption", "export", "train"] and calls(asked) == {"c": 5}, "the answers are those in the log"
    (folder / "d.png").write_bytes(pixels.write_png(noise(4)))
    assert run().ran == ["preprocess", "generate", "caption", "export", "train"]
    style = build.build(spark, str(folder), str(tmp_path / "style"), build.Recipe("s", dataset_type="style", target=48), seeing(asked), plan, opened)
    assert style.ran == ["preprocess", "caption", "export", "train"] and style.done["caption"]["n"] == 4
    with pytest.raises(ValueError):
        build.build(spark, str(tmp_path / "asked"), str(tmp_path / "none"), recipe, seeing(asked))
