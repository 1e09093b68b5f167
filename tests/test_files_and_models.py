import json
import zipfile

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from loomset import cli, settings
from loomset.functions import messages
from loomset.operators import batch, pixels, reports, selection
from loomset.plans import files as plan_files
from loomset.plans import training
from loomset.sources import files, packages


def noise(seed, h=64, w=64, c=3):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), np.uint8)


@pytest.fixture
def folder(tmp_path):
    home = tmp_path / "images"
    home.mkdir()
    for name, seed in (("a", 1), ("b", 1), ("c", 999)):
        (home / f"{name}.png").write_bytes(pixels.write_png(noise(seed)))
    (home / "bad.png").write_bytes(b"no image")
    (home / "a.txt").write_text("trig, standing")
    (home / "b.txt").write_text(" ")
    return home


def test_png_round_trip_and_filters():
    import zlib

    for c in (1, 3, 4):
        assert (pixels.read_png(pixels.write_png(noise(3, 5, 7, c))) == noise(3, 5, 7, c)).all()
    image = noise(4, 6, 5).reshape(6, 15).astype(int)
    lines, above = [], np.zeros(15, int)
    for y in range(6):  # the filters by their definition, one kind after the other
        left, corner = np.r_[0, 0, 0, image[y][:-3]], np.r_[0, 0, 0, above[:-3]]
        p = left + above - corner
        d = np.stack([abs(p - left), abs(p - above), abs(p - corner)])
        paeth = np.choose(d.argmin(0), [left, above, corner])
        guess = [0 * p, left, above, (left + above) // 2, paeth][y % 5]
        lines.append(bytes([y % 5]) + ((image[y] - guess) % 256).astype(np.uint8).tobytes())
        above = image[y]
    head = (5).to_bytes(4, "big") + (6).to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    data = pixels.SIGNATURE + pixels._chunk(b"IHDR", head) + pixels._chunk(b"IDAT", zlib.compress(b"".join(lines)))
    assert (pixels.read_png(data).reshape(6, 15) == image).all()
    with pytest.raises(ValueError, match="truncated"):
        pixels.read_png(data[:-20])


def test_masks_crops_and_sizes():
    image = np.full((100, 100, 3), 255, np.uint8)
    assert pixels.crop_to_content(image) is image
    image[40:60, 30:70] = 0
    assert pixels.crop_to_content(image, margin=0).shape == (20, 40, 3) and pixels.crop_to_content(image, margin=0.05).shape == (30, 50, 3)
    subject, prop = np.zeros((40, 40), bool), np.zeros((40, 40), bool)
    subject[:20] = True
    prop[30:] = True
    assert (pixels.without_prop(subject, prop)[0] == subject).all()
    prop[:] = False
    prop[15:20, :10] = True
    kept, share = pixels.without_prop(subject, prop, 1)
    assert share == 1.0 and kept.sum() == 800 - 6 * 11
    assert pixels.cut_out(image, np.ones((100, 100), bool), alpha=True).shape == (100, 100, 4)
    assert pixels.to_long_side(noise(1, 30, 60), 40).shape == (20, 40, 3)
    assert (pixels.resample(np.full((9, 5, 3), 77, np.uint8), 12, 3) == 77).all()
    assert pixels.difference_bits(noise(1)) == pixels.difference_bits(noise(1))
    assert (pixels.difference_bits(noise(1)) ^ pixels.difference_bits(noise(999))).bit_count() > 5


def test_prepared_images_fail_one_by_one(spark, folder):
    how = pixels.Preparation(32, segment=lambda image, term: image[..., 0] > (300 if term == "none" else 20), subject="x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in pixels.prepared(files.files(spark, str(folder)).where("ext = 'png'"), how).collect()}
    assert rows["bad.png"].content is None and "cannot identify" in rows["bad.png"].error
    assert max(rows["a.png"].w, rows["a.png"].h) == 32 and rows["a.png"].error == "" and pixels.read_png(rows["a.png"].content).shape[2] == 3
    none = pixels.prepared(files.files(spark, str(folder)).where("ext = 'png'"), pixels.Preparation(32, segment=how.segment, subject="none"))
    assert none.where("error LIKE 'found no%'").count() == 3


def test_backend_retries_and_reports(spark):
    class Busy(Exception):
        code = 503

    def opened():
        seen = {}

        def answer(text):
            seen[text] = seen.get(text, 0) + 1
            if text == "busy" and seen[text] < 3:
                raise Busy("later")
            if text == "bad":
                raise ValueError("refused")
            return text.upper()

        return answer

    rows = spark.createDataFrame([(1, "busy"), (2, "bad"), (3, "fine")], "id long, text string").coalesce(1)
    out = batch.run_backend(rows, "id", "text", opened, batch.Retries(3, 0.01))
    assert [tuple(r) for r in out.orderBy("id").collect()] == [(1, "BUSY", None, ""), (2, None, None, "refused"), (3, "FINE", None, "")]
    assert tuple(selection.tallies(out).first()) == (2, 1)


def test_package_and_zip(spark, folder, tmp_path):
    one = packages.package(files.pairs(spark, str(folder)), str(tmp_path / "out"), "My Set!", "trig")
    two = packages.package(files.pairs(spark, str(folder)), str(tmp_path / "out"), "My Set!", "trig", {"caption_style": "given"})
    assert one.endswith("my-set-dataset") and two.endswith("my-set-dataset-2")
    lines = [json.loads(x) for x in open(f"{one}/metadata.jsonl", encoding="utf-8")]
    assert lines == [{"file_name": "01.png", "text": "trig, standing"}, {"file_name": "02.png", "text": ""}]
    assert open(f"{one}/01.png", "rb").read() == (folder / "a.png").read_bytes() and open(f"{one}/02.txt").read() == ""
    assert json.load(open(f"{one}/metadata.json"))["caption_style"] == "tags" and json.load(open(f"{two}/metadata.json"))["caption_style"] == "given"
    packages.zipped(one)
    with zipfile.ZipFile(packages.zipped(one)) as z:
        assert z.namelist() == sorted(z.namelist()) and "my-set-dataset/01.png" in z.namelist() and z.filename.endswith("-2.zip")


def test_settings(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# A=1\nexport B = 'x y'\nnot a pair\nC=\"q\"\n")
    assert settings.read_env(path) == {"B": "x y", "C": "q"} and settings.read_env(tmp_path / "none") == {}
    settings.set_key(path, "B", "z")
    settings.set_key(path, "D", "new")
    assert settings.read_env(path) == {"B": "z", "C": "q", "D": "new"} and path.read_text().startswith("# A=1\n") and path.stat().st_mode & 0o777 == 0o600
    assert settings.unset_key(path, "C") and not settings.unset_key(path, "C")
    assert settings.masked("abcdefghijkl") == "abcd...ijkl" and settings.masked("short") == "********"
    choices = tmp_path / "c.json"
    choices.write_text("{broken")
    assert settings.load_choices(choices) == {} and settings.save_choices(choices, {"a": 1}) == {"a": 1} and settings.save_choices(choices, {"b": 2}) == {"a": 1, "b": 2}


def test_training_files_can_be_read(tmp_path):
    import tomllib

    model = {"name_or_path": 'C:\\m "x"', "arch": "sdxl", "noise_scheduler": "ddpm"}
    t = training.Training("n: 1", str(tmp_path), "trig", model=model, buckets=(512, 768))
    job = yaml.safe_load(open(training.write_config(t, "job")))
    process = job["config"]["process"][0]
    assert job["config"]["name"] == "n: 1" and process["model"] == {"name_or_path": 'C:\\m "x"', "arch": "sdxl", "quantize": True}
    assert process["datasets"][0]["resolution"] == [512, 768] and process["sample"]["prompts"] == ["a photo of trig, standing outdoors in daylight"]
    one, two = training.write_config(t, "subsets"), training.write_config(t, "subsets")
    assert one != two and two.endswith("subsets.2.toml")
    assert tomllib.load(open(one, "rb"))["datasets"][0]["subsets"] == [{"image_dir": str(tmp_path), "num_repeats": 1}]
    assert tomllib.load(open(training.write_config(t, "dataset"), "rb"))["general"]["bucket_no_upscale"] is True


def test_plan_files(spark, tmp_path):
    rows = [("s1", "pose", "a: \"b\"", "c\nd", "", "", "", ""), ("s0", "angle", "x", "é", "s1", "calm", "", "")]
    plan = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in plan_files.PLAN_COLUMNS)).coalesce(1)
    path = plan_files.save_plan(plan, str(tmp_path / "plan.txt"))
    back = plan_files.load_plan(spark, path)
    assert path.endswith("plan.yaml") and [tuple(r)[1:] for r in plan_files.first_shots(back).collect()] == rows
    assert [r.id for r in plan_files.in_turn(back).collect()] == ["s1", "s0"] and plan_files.first_shots(back, 1).count() == 1
    (tmp_path / "no.yaml").write_text("a: 1")
    with pytest.raises(ValueError, match="no list"):
        plan_files.load_plan(spark, str(tmp_path / "no.yaml"))


def test_reports_and_command_line(spark, folder, tmp_path, capsys):
    pairs = spark.createDataFrame([(i, f"{i}.png", f"trig, solo, x{i}" if i else "") for i in range(12)], "ord long, image string, caption string")
    text = reports.lint_report(pairs, "trig")
    assert "**1 empty:** 0.png" in text and "`solo` ×11" in text
    assert "no findings" in reports.lint_report(pairs.where("ord BETWEEN 1 AND 3"), "trig")
    done = lambda *a: cli.run(cli.parser().parse_args([*map(str, a)]))
    assert "empty:** b.png, bad.png, c.png" in done("lint", folder, "--trigger", "trig")
    assert done("stats", folder).startswith("**3 images** (2 with captions)")
    assert len(done("duplicates", folder).splitlines()) == 2 and len(done("quality", folder).splitlines()) == 3
    (tmp_path / "prepared").mkdir()
    assert done("preprocess", folder, tmp_path / "prepared", "--target", 32).startswith("3 written") and (tmp_path / "prepared" / "a_prepped.png").exists()
    assert done("export", folder, tmp_path / "made", "--name", "n", "--zip").endswith("n-dataset.zip")
    assert done("keys", "set", "K_1", "secret-value-1", "--file", tmp_path / "e") == "K_1 set" and done("keys", "list", "--file", tmp_path / "e") == "K_1=secr...ue-1"


def test_selection_edges(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k long, path string")
    none = rows.limit(0)
    assert selection.carried_or_all(rows, none, "k").count() == 2 and selection.carried_or_all(none, rows, "k").count() == 0
    assert [r.k for r in selection.present(rows, none).collect()] == [2] and selection.to_redo(rows, none, "k").count() == 2
    one = spark.range(1).select(messages.missing_nodes(F.array(F.lit("b"), F.lit("a"), F.lit(None)), F.array(F.lit("b"))).alias("x"), messages.friendly_error(F.lit(None), F.lit(" "), "Boom").alias("e"), messages.rejection(F.lit(None).cast("string")).alias("r"), selection.version(F.lit("v1.x.2b")).alias("v")).first()
    assert one.x == ["a"] and one.e == "Boom" and one.r == "job rejected: " and one.v == [1, 0, 2]
    assert selection.closest("sub\\modle.bin", ["sub/model.bin", "zzz"]) == ["sub/model.bin"]
