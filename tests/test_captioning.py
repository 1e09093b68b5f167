import numpy as np
import pytest
from pyspark.sql import functions as F

from loomset import settings
from loomset.operators import captioning, pixels
from loomset.operators.answers import AnswerLog
from loomset.plans import training
from loomset.sources import files, headers


def chunk(kind, body):
    return kind + len(body).to_bytes(4, "little") + body


def webp(kind, body):
    return b"RIFF" + (len(body) + 12).to_bytes(4, "little") + b"WEBP" + chunk(kind, body)


def jpeg(w, h, before=b""):
    frame = b"\xff\xc2" + (11).to_bytes(2, "big") + b"\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
    return b"\xff\xd8" + before + frame + b"\xff\xd9"


def tiff(order, w, h):
    n = lambda x, size: x.to_bytes(size, order)
    entry = lambda tag, kind, v: n(tag, 2) + n(kind, 2) + n(1, 4) + (n(v, 2) + b"\0\0" if kind == 3 else n(v, 4))
    return (b"II" if order == "little" else b"MM") + n(42, 2) + n(8, 4) + n(2, 2) + entry(256, 3, w) + entry(257, 4, h) + n(0, 4)


SIZED = {
    "gif": b"GIF89a" + (9).to_bytes(2, "little") + (8).to_bytes(2, "little"),
    "down": b"BM" + bytes(16) + (9).to_bytes(4, "little") + (-8).to_bytes(4, "little", signed=True),
    "tables first": jpeg(9, 8, b"\xff\xe0\x00\x04ab\xff\xc4\x00\x05\x00\x01\x02\xff"),
    "lossy": webp(b"VP8 ", b"abc\x9d\x01\x2a" + (9).to_bytes(2, "little") + (8 | 1 << 14).to_bytes(2, "little") + b"\0"),
    "lossless": webp(b"VP8L", b"\x2f" + (8 | 7 << 14).to_bytes(4, "little")),
    "extended": webp(b"VP8X", bytes(4) + (8).to_bytes(3, "little") + (7).to_bytes(3, "little")),
    "little": tiff("little", 9, 8),
    "big": tiff("big", 9, 8),
}


@pytest.mark.parametrize("kind", SIZED)
def test_header_sizes(kind):
    assert headers.image_size(SIZED[kind]) == (9, 8)
    for n in range(len(SIZED[kind])):  # a file cut anywhere is read or isn't, but never fails
        assert headers.image_size(SIZED[kind][:n]) in (None, (9, 8))


def test_sizes_of_a_folder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(pixels.write_png(np.zeros((4, 6, 3), np.uint8)))
    (tmp_path / "b.JPG").write_bytes(jpeg(30, 20))
    (tmp_path / "c.webp").write_bytes(b"nothing")
    (tmp_path / "d.png").write_bytes(b"")
    (tmp_path / "e.txt").write_bytes(jpeg(1, 1))
    got = {r.path.rsplit("/", 1)[1]: (r.w, r.h) for r in headers.image_sizes(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (6, 4), "b.JPG": (30, 20)}


def test_expanded_paths(spark, tmp_path):
    for spot in ("one/b.png", "one/a.png", "one/a.txt"):
        (tmp_path / spot).parent.mkdir(exist_ok=True)
        (tmp_path / spot).write_bytes(b"x")
    (tmp_path / "bare").mkdir()
    names = lambda df: [r["name"] for r in df.collect()]
    assert names(files.expanded(spark, ["/x/z.png", str(tmp_path / "one")])) == ["z.png", "a.png", "b.png"]
    assert names(files.chosen_inputs(spark, ["/x/z.png"], str(tmp_path / "one"))) == ["z.png"]
    assert names(files.chosen_inputs(spark, [], f" {tmp_path / 'one'} ")) == ["a.png", "b.png"]
    for paths, folder in (([], " "), ([], str(tmp_path / "bare"))):
        with pytest.raises(ValueError):
            files.chosen_inputs(spark, paths, folder)


def test_metadata_and_sidecar(tmp_path):
    assert files.type_note(str(tmp_path), "style") == ""
    for text, note in (("{", ""), ("[1]", ""), ("{}", ""), ('{"dataset_type": "style", "caption_style": "tags"}', "metadata.json says: style, captions of tags.")):
        (tmp_path / "metadata.json").write_text(text)
        assert files.type_note(str(tmp_path), "style") == note
    assert "concept" in files.type_note(str(tmp_path), "concept")
    spot = files.save_caption(f" {tmp_path} ", "dog.one.png", "  a dog\n")
    assert spot.endswith("dog.one.txt") and open(spot).read() == "a dog"
    with pytest.raises(ValueError):
        files.save_caption("", "a.png", "x")


def test_settings_by_precedence(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("APP_SIDE=512\nAPP_CHECK=off\nAPP_NAME=file\nOTHER=1\n")
    monkeypatch.setenv("app_name", "shell")
    defaults = {"side": 1024, "check": True, "name": "x", "limit": 2.5}
    assert settings.settled(defaults, "APP_", tmp_path / ".env") == {"side": 512, "check": False, "name": "shell", "limit": 2.5}
    (tmp_path / ".env").write_text("APP_CHECK=perhaps\n")
    with pytest.raises(ValueError):
        settings.settled(defaults, "APP_", tmp_path / ".env")
    monkeypatch.setenv("SOME_KEY", "outer")
    assert settings.key_of("some_key", {"some_key": "inner"}) == "inner"
    assert settings.key_of("some_key", {"some_key": ""}) == "outer" and settings.key_of("no_such_key", {}) == ""


def opened(model, options):
    def answer(x):
        if x == "bad":
            raise ValueError("no image")
        return f"{options.get('say', '')}{x} by {model}."

    return answer


def test_backends():
    every = {"cloud": captioning.Backend("cloud", opened, "m1"), "tagger": captioning.Backend("tagger", opened, "m2", {"general": 0.35, "rating": False}), "own": captioning.Backend("custom", opened)}
    assert captioning.chosen(every, "?", "cloud").model == "m1"
    with pytest.raises(ValueError):
        captioning.chosen(every, "?")
    assert captioning.configured(every["cloud"], " m9 ", general=0.5) == captioning.Backend("cloud", opened, "m9")
    assert captioning.configured(every["cloud"], " ").model == "m1"
    assert captioning.configured(every["tagger"], "m9", general=0.5, rating=None).options == {"general": 0.5, "rating": False}
    assert captioning.configured(every["own"], "m9", {"base_url": "u", "model": "mine"}).model == "mine"
    with pytest.raises(ValueError):
        captioning.configured(every["own"], saved={})
    assert every["tagger"].options["general"] == 0.35
    assert captioning.isolation("", True) == "builtin" and captioning.isolation("remote", False) == "remote"
    with pytest.raises(ValueError):
        captioning.isolation("", True, default="remote")


def test_caption_images(spark, tmp_path):
    rows = spark.createDataFrame([(3, "cat", None), (1, "dog", " "), (2, "bad", ""), (4, "owl", "done")], "ord long, content string, caption string").coalesce(1)
    backend, kept = captioning.Backend("cloud", opened, "m", {"say": "the "}), str(tmp_path)

    def keep(ord_, text):
        with open(f"{kept}/{ord_}", "w") as out:
            out.write(text)

    done = captioning.caption_images(rows, backend, skip_existing=True, keep=keep, prefix="p,").collect()
    assert [r.ord for r in done] == [1, 2, 3]
    assert [(r.output, r.error) for r in done] == [("the dog by m.", ""), (None, "no image"), ("the cat by m.", "")]
    assert done[0].caption.startswith("p") and "dog" in done[0].caption and done[1].caption is None
    assert (tmp_path / "1").read_text() == "the dog by m." and not (tmp_path / "2").exists() and not (tmp_path / "4").exists()


def test_a_batch_stops_between_images_and_starts_anew(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"x{i}", "") for i in range(6)], "ord long, content string, caption string").coalesce(1)
    stop = captioning.Stop(str(tmp_path / "stop"))

    def keep(ord_, text):
        if ord_ == 2:
            stop.request()

    backend = captioning.Backend("tagger", opened, "m")
    one = AnswerLog(str(tmp_path / "log"), parallel=1)
    assert [r.ord for r in captioning.caption_images(rows, backend, stop=stop, keep=keep, log=one).collect()] == [0, 1, 2]
    assert captioning.caption_images(rows, backend, stop=stop).count() == 0
    stop.start()
    assert captioning.caption_images(rows, backend, stop=stop).count() == 6


def test_tagger_input():
    clear = np.zeros((2, 4, 4), np.uint8)
    assert (pixels.tagger_input(clear, 8) == 255).all()
    red = np.zeros((4, 4, 3), np.uint8)
    red[..., 0] = 200
    got = pixels.tagger_input(red, 8)
    assert got.shape == (1, 8, 8, 3) and got.dtype == np.float32 and (got[0, ..., 2] == 200).all() and not got[0, ..., :2].any()
    wide = pixels.tagger_input(np.zeros((2, 4), np.uint8), 4)[0, ..., 0]
    assert (wide[1:3] == 0).all() and (wide[[0, 3]] == 255).all()


def test_run_commands():
    t = training.Training("my set", "/d", rank=8, steps=900, model={"script": "train.py", "name_or_path": "org/base", "flags": {"split_attn": True, "offload": False, "mixed_precision": "bf16"}})
    assert training.run_command(t, "job", "/d/job.yaml", " /t ") == 'cd "/t" && python run.py "/d/job.yaml"'
    line = training.run_command(t, "subsets", "/d/subsets.toml")
    for part in ("<<FILL: where", 'train.py --dataset_config "/d/subsets.toml"', '--pretrained_model_name_or_path "org/base"', "--network_dim 8", "--max_train_steps 900", '--output_name "my set"', "--split_attn --mixed_precision bf16"):
        assert part in line
    assert "offload" not in line and training.run_command(t, "dataset", "/d/x.toml").count("<<FILL") == 4
    with pytest.raises(ValueError):
        training.run_command(t, "other", "x")


def test_instruction(spark):
    rows = spark.createDataFrame([("tags", "character", False), ("odd", "character", True), ("tags", "style", True), ("odd", "concept", True), ("prose", "style", False)], "s string, t string, sparse boolean")
    said = captioning.instruction(F.col("s"), F.col("t"), F.col("sparse"), {"prose": "P", "tags": "T"}, {"style": "S", "style-sparse": "SS", "concept": "C"}, {"prose": "p", "tags": "t"}, "refer")
    assert [r.x for r in rows.select(said.alias("x")).collect()] == ["T", "P", "SS refer t", "C refer p", "S refer p"]
