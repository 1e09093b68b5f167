import os

import pytest
from pyspark.sql import functions as F

from loomset import cli
from loomset.functions import messages
from loomset.operators import reports, selection
from tests.test_files_and_models import folder  # noqa: F401


def test_ticked(spark):
    rows = spark.createDataFrame([(1, "x"), (2, " "), (3, None)], "ord int, caption string")
    got = {mode: [r.picked for r in selection.ticked(rows, mode).orderBy("ord").collect()] for mode in ("all", "none", "captioned")}
    assert got == {"all": [True] * 3, "none": [False] * 3, "captioned": [True, False, False]}
    with pytest.raises(ValueError):
        selection.ticked(rows, "some")


def test_waiting(spark):
    bodies = ['{"queue_pending": [[1, {}], [2, {}]]}', '{"queue_pending": []}', "{}", "<html>", None, '{"queue_pending": 7}']
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    assert [r.n for r in rows.select("i", messages.waiting(F.col("body")).alias("n")).orderBy("i").collect()] == [2, 0, 0, 0, 0, 0]


def test_failure_and_check_reports(spark):
    rows = spark.createDataFrame([(f"{i:02d}.png", "**bad** file" if i < 10 else "" if i % 2 else None) for i in range(14)], "name string, error string")
    said = reports.failure_report(rows).splitlines()
    assert said[0] == "**4 of 14 images** done, 10 failed:" and said[1].startswith("- **00.png:** bad file (") and said[-1] == "(+2 more)" and len(said) == 10
    assert reports.failure_report(rows.where("name > '12'")) == "**2 of 2 images** done." and reports.failure_report(rows.limit(0)) == ""
    checks = spark.createDataFrame([("python", True, "3.13"), ("key", False, "none set"), ("server", None, None)], "name string, ok boolean, detail string")
    assert reports.check_report(checks, "State").splitlines() == ["State", "", "  [FAIL] key            none set", "  [ok]   python         3.13", "  [--]   server", "", "1 to be mended"]


def stand_in(model, options):
    return lambda content: f"seen by {model}."


def test_caption_and_preview_by_command(spark, folder, tmp_path):  # noqa: F811
    run = lambda *args: cli.run(cli.parser().parse_args(list(args)))
    said = run("caption", str(folder), "--backend", "tests.test_small_operators:stand_in", "--model", "m1", "--log", str(tmp_path / "log"), "--trigger", "zq", "--skip-captioned")
    assert said == "**3 of 3 images** done." and (folder / "c.txt").read_text() == "zq, seen by m1." and (folder / "a.txt").read_text() == "trig, standing"
    told = dict(line.split(": ") for line in run("preview", str(folder), "--trigger", "zq").splitlines())
    assert (told["n"], told["n ready"], told["n unreadable"], told["near duplicates"], told["groups of equal captions"]) == ("4", "4", "1", "2", "1")
    assert os.path.exists(tmp_path / "log")
