import os

import pytest

from loomset.operators.answers import AnswerLog
from loomset.operators.captioning import Stop
from loomset.plans import generation


def test_waves_of_long_chains_and_rings(spark):
    rows = [(f"s{i}", f"s{i - 1}" if i else "") for i in range(51)] + [("a", "b"), ("b", "c"), ("c", "a"), ("hangs", "a"), ("further", "hangs"), ("self", "self"), ("lone", None), ("odd", "unknown"), (None, "s1")]
    got = {r.id: (r.parent, r.wave, r.ring) for r in generation.waves(spark.createDataFrame(rows, "id string, chain_from string")).collect()}
    assert [got[f"s{i}"] for i in range(51)] == [(f"s{i - 1}" if i else None, i, False) for i in range(51)]
    assert all(got[x][1:] == (None, True) for x in ("a", "b", "c", "hangs", "further", "self")) and got["lone"] == got["odd"] == (None, 0, False) and None not in got
    assert generation.waves(spark.createDataFrame([], "id string, chain_from string")).collect() == []


def test_many_shots_on_one(spark):
    rows = spark.createDataFrame([("root", "")] + [(f"s{i}", "root") for i in range(500)], "id string, chain_from string")
    assert generation.waves(rows).where("wave = 1 AND parent = 'root'").count() == 500


PLAN = "id string, kind string, local_prompt string, cloud_prompt string, chain_from string, outfit string"


def shot(id_, chain="", outfit=""):
    return id_, "pose", f"p {id_}", "c. Keep the same face.", chain, outfit


def maker(folder, fails=(), stop=None):
    def opened():
        def make(s):
            open(f"{folder}/{s['id']}-{os.urandom(4).hex()}", "x").close()
            if stop and s["id"] == "side":
                stop.request()
            if s["id"] in fails:
                raise ValueError("no picture")
            return f"{s['id']}.png<{s['led_by'] or ''}"

        return make

    return opened


def test_generate_failures_redone_and_kept(spark, tmp_path):
    plan = spark.createDataFrame([shot("front", outfit="a hat"), shot("side", "front"), shot("back", "side"), shot("alone"), shot(" ")], PLAN)
    first = generation.generate(plan, maker(tmp_path, fails=("side",))).collect()
    got = {r.id: r for r in first}
    assert got.keys() == {"front", "side", "back", "alone"}
    assert (got["side"].path, got["side"].error, got["side"].led_by) == (None, "no picture", "front.png<")
    assert (got["back"].path, got["back"].wave) == ("back.png<", 2), "the references alone have to do"
    old = spark.createDataFrame([(r.id, r.path, r.seed, r.error) for r in first], "id string, path string, seed long, error string")
    redo = spark.createDataFrame([("side",), ("back",)], "id string")
    again = {r.id: r for r in generation.generate(plan, maker(tmp_path), old, redo).collect()}
    assert again["back"].path == "back.png<side.png<front.png<" and again["alone"].path == "alone.png<" and again["side"].wave == 0
    assert again["side"].seed == got["side"].seed < generation.SEEDS
    names = sorted(n.split("-")[0] for n in os.listdir(tmp_path))
    assert names == ["alone", "back", "back", "front", "side", "side"]


@pytest.mark.parametrize("props", [True, False])
def test_a_stopped_run_is_taken_up_by_its_log(spark, tmp_path, props):
    (tmp_path / "made").mkdir()
    plan = spark.createDataFrame([shot("front"), shot("side", "front"), shot("back", "side"), shot("top", "back")], PLAN)
    stop, log = Stop(str(tmp_path / "stop")), AnswerLog(str(tmp_path / "log"), parallel=1)
    some = generation.generate(plan, maker(tmp_path / "made", stop=stop), log=log, stop=stop, exclude_props=props).collect()
    assert sorted(r.id for r in some) == ["front", "side"]
    stop.start()
    rest = {r.id: r.path for r in generation.generate(plan, maker(tmp_path / "made"), log=log, stop=stop, exclude_props=props).collect()}
    assert rest["top"] == "top.png<back.png<side.png<front.png<"
    assert sorted(n.split("-")[0] for n in os.listdir(tmp_path / "made")) == ["back", "front", "side", "top"]
