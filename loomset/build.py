"""Whole datasets: folders captioned in one call, the preview before an export, and the build from sources to a package.

A build keeps a manifest: what each stage was made from, as a digest, and what it made. A stage whose
digest is unchanged, and whose results are still there, isn't run again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from hashlib import sha256
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import captioning, dedupe, export, lint, pixels, quality
from loomset.operators.answers import AnswerLog
from loomset.plans import generation, training
from loomset.sources import files, packages, sinks
from loomset.store import materialize


def caption_folder(spark: SparkSession, folder: str, backend: captioning.Backend, only: list[str] | None = None, log: AnswerLog | None = None, **how: Any) -> DataFrame:
    """Captions a folder's images, or those named in ``only``, and writes the sidecars of all that were answered at once.

    ``how`` goes to ``captioning.caption_images``, whose rows come back with the image's name. Images that
    weren't reached or failed get no sidecar, and keep one that they have. A folder without images is an error.
    """
    listed = files.files(spark, folder).where(F.col("ext").isin(files.IMAGE_EXTENSIONS)).select("path", "content")
    rows = files.pairs(spark, folder).join(listed, "path").select("ord", F.col("image").alias("name"), "caption", "content")
    rows = rows.where(F.col("name").isin(only)) if only else rows
    if rows.isEmpty():
        raise ValueError(f"no images in {folder}")
    done = captioning.caption_images(rows, backend, log=log, **how)
    named = materialize(done.join(rows.select("ord", "name"), "ord"), "captioned")
    sinks.write_sidecars(named.where("error = ''").select("name", "caption"), folder)
    return named.orderBy("ord")


@dataclass(frozen=True)
class Preview:
    """``rows`` has a line for each image, ``groups`` the near duplicates (seed, member), ``counts`` all numbers."""

    rows: DataFrame
    groups: DataFrame
    duplicate_captions: DataFrame
    counts: dict[str, Any]


def preview(pairs: DataFrame, images: DataFrame, trigger: str = "", distance: int = 5) -> Preview:
    """What an export would hold, and what is odd about it: from one scan of the images.

    ``pairs`` has (ord, image, path, caption), ``images`` (path, w, h, hash, mean, std, sharpness) as
    ``pixels.measured`` gives them. All counts are observed while the rows are written; duplicates are then
    found from what was written. Images that can't be read are counted and have no measures.
    """
    joined = pairs.select("ord", "image", "path", "caption").join(images.select("path", "w", "h", "hash", "mean", "std", "sharpness"), "path", "left")
    norm, said = T.normal(F.coalesce("caption", F.lit(""))), export.status(F.col("caption"))
    part = F.filter(F.transform(F.split(T.empty(F.col("caption")), ","), lambda x: F.size(T.words(x))), lambda n: n > 0)
    tone = quality.exposure_flags(F.col("mean"), F.col("std"))
    rows = joined.select(
        "ord", "image", "path", "caption", "w", "h", "hash", said.alias("status"), (said == "ready").alias("picked"), tone.alias("exposure"), (F.col("sharpness") < 100.0).alias("blurred"),
        ((norm != "") & (F.size(T.words(F.col("caption"))) < 2)).alias("short"), ((norm != "") & ~F.startswith(norm, F.lit(" ".join(trigger.split()).lower()))).alias("missing_trigger"),
        F.size(part).cast("long").alias("segments"), F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x).alias("words"),
    )
    seen, side = Observation("preview"), F.greatest("w", "h")
    rows = rows.observe(
        seen, F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ready", "empty", "missing")), F.count_if(F.col("w").isNull()).alias("n_unreadable"),
        *(F.count_if(c).alias(f"n_{c}") for c in ("short", "missing_trigger", "blurred")), F.coalesce(F.min(side), F.lit(0)).alias("min_long_side"), F.coalesce(F.max(side), F.lit(0)).alias("max_long_side"),
        F.coalesce(F.sum("segments"), F.lit(0)).alias("segments"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"),
    )
    rows = materialize(rows, "preview")
    counts = dict(seen.get)
    counts["kind"] = "" if not counts["segments"] else "tags" if counts["words"] <= 3.0 * counts["segments"] else "prose"
    return Preview(rows, dedupe.near_groups(rows.select("ord", "hash"), distance), lint.duplicate_groups(rows.where("caption IS NOT NULL")), counts)


def listing_digest(spark: SparkSession, folder: str) -> str:
    """Changes whenever a file of the folder comes, goes or is written: from names, sizes and times, in any order."""
    rows = files.files(spark, folder).select("name", "length", F.col("modificationTime").cast("string").alias("at"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "name", "length", "at")).alias(f"x{k}") for k in (1, 2))).first()
    return f"{got.n}:{got.x1}:{got.x2}"


@dataclass
class Manifest:
    """What the stages of a run folder were made from and what they made; ``ran`` are those of this build."""

    path: Path
    done: dict[str, dict] = field(default_factory=dict)
    ran: list[str] = field(default_factory=list)

    @classmethod
    def of(cls, home: str) -> Manifest:
        path = Path(home) / "manifest.json"
        try:
            found = json.loads(path.read_text(encoding="utf-8"))
        except (OSError, ValueError):  # none yet, or damaged: all is made anew
            found = {}
        return cls(path, found if isinstance(found, dict) else {})

    def stage(self, name: str, made_from: Any, work: Callable[[], dict[str, Any]]) -> dict[str, Any]:
        """The stage's result, from the manifest where nothing has changed. ``out``, if the result has one, is a path that must be there."""
        key = sha256(json.dumps([name, made_from], sort_keys=True, default=str).encode()).hexdigest()
        known = self.done.get(name)
        if known and known["key"] == key and ("out" not in known or os.path.exists(known["out"])):
            return known
        self.ran.append(name)
        self.done[name] = work() | {"key": key}
        sinks.put(str(self.path), json.dumps(self.done, indent=2, default=str).encode())
        return self.done[name]


@dataclass(frozen=True)
class Recipe:
    """How a dataset is built. ``maker`` makes shots as ``generation.generate`` asks for them; a style has none made."""

    name: str
    trigger: str = ""
    dataset_type: str = "character"
    style: str = "prose"
    target: int = 1024
    seed: int = 0
    form: str = "job"
    model: Mapping[str, Any] = field(default_factory=dict)
    zipped: bool = False
    finish: Mapping[str, Any] = field(default_factory=dict)


def build(spark: SparkSession, source: str, home: str, recipe: Recipe, backend: captioning.Backend, plan: DataFrame | None = None, maker: Callable[[], Callable[[dict], str]] | None = None, how: pixels.Preparation | None = None) -> Manifest:
    """From a folder of sources to a packaged dataset with its trainer file, stage by stage, under the run folder ``home``.

    Sources are prepared, shots made from the plan (not for a style), all captioned, packaged (and zipped),
    and a trainer's file written. A second build with nothing changed runs no stage; a changed source, plan
    or option runs what depends on it. Shots that are made and captions that are answered are in logs, so a
    build that was stopped asks for the rest only. No prepared image, or no shot at all, is an error.
    """
    os.makedirs(home, exist_ok=True)
    manifest, prepped = Manifest.of(home), f"{home}/prepped"
    how = how or pixels.Preparation(recipe.target)

    def prepare() -> dict:
        sources = files.files(spark, source).where(F.col("ext").isin(files.IMAGE_EXTENSIONS))
        done = materialize(pixels.prepared(sources, how), "prepared")
        stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
        sinks.write_folder(done.where("content IS NOT NULL").select(F.concat(stem, F.lit("_prepped.png")).alias("name"), "content"), prepped)
        tally = done.agg(F.count("content").alias("n"), F.count_if(F.col("content").isNull()).alias("failed")).first()
        if not tally.n:
            raise ValueError("no source image could be prepared")
        return {"out": prepped, "n": tally.n, "failed": tally.failed}

    first = manifest.stage("preprocess", [listing_digest(spark, source), recipe.target, how.subject, how.exclude, how.alpha], prepare)
    shots = {"key": "", "out": prepped}
    if recipe.dataset_type != "style" and plan is not None and maker is not None:
        told = plan.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*plan.columns)).alias("x")).first()

        def make() -> dict:
            made = generation.generate(plan, maker, exclude_props=recipe.dataset_type == "character", seed=recipe.seed, log=AnswerLog(f"{home}/shots-{first['key'][:12]}"))
            made.write.mode("overwrite").parquet(f"{home}/results")
            made = spark.read.parquet(f"{home}/results")
            tally = made.agg(F.count("path").alias("n"), F.count_if(F.col("path").isNull()).alias("failed")).first()
            if not tally.n:
                raise ValueError("no shot succeeded")
            return {"out": f"{home}/results", "n": tally.n, "failed": tally.failed}

        shots = manifest.stage("generate", [first["key"], told.n, told.x, recipe.seed, recipe.dataset_type], make)
    asked = [first["key"], shots["key"], backend.kind, backend.model, backend.options]

    def caption() -> dict:
        part = lambda rows, n: rows.select(F.concat(F.lit(n), "path").alias("ord"), "path", "content", F.lit("").alias("caption"))
        images = part(files.files(spark, prepped), "0")
        if shots["key"]:
            plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
            made = materialize(spark.read.parquet(shots["out"]).where("path IS NOT NULL").select(plain(F.col("path")).alias("made")), "build-made")
            folders = [r.folder for r in made.select(F.regexp_replace("made", r"/[^/]+$", "").alias("folder")).distinct().collect()]  # a backend writes to one
            images = images.unionByName(part(files.files(spark, folders).join(made, plain(F.col("path")) == F.col("made"), "left_semi"), "1"))
        log = AnswerLog(f"{home}/answers-{sha256(json.dumps(asked, default=str).encode()).hexdigest()[:12]}")
        images = materialize(images, "build-images")
        done = captioning.caption_images(images, backend, style=recipe.style, log=log, trigger=recipe.trigger, **recipe.finish)
        images.select("ord", "path").join(done.select("ord", "caption", "error"), "ord", "left").write.mode("overwrite").parquet(f"{home}/captions")
        tally = spark.read.parquet(f"{home}/captions").agg(F.count("caption").alias("n"), F.count_if(F.col("caption").isNull()).alias("failed")).first()
        return {"out": f"{home}/captions", "n": tally.n, "failed": tally.failed}

    captions = manifest.stage("caption", [*asked, recipe.style, recipe.trigger, dict(recipe.finish)], caption)

    def pack() -> dict:
        about = {"dataset_type": recipe.dataset_type, "caption_style": recipe.style, "trigger": recipe.trigger, "sources": source, "failed": {k: manifest.done[k]["failed"] for k in ("preprocess", "generate", "caption") if k in manifest.done}}
        folder = packages.package(spark.read.parquet(captions["out"]), f"{home}/datasets", recipe.name, recipe.trigger, about)
        return {"out": folder} | ({"archive": packages.zipped(folder, spark)} if recipe.zipped else {})

    package = manifest.stage("export", [captions["key"], recipe.name, recipe.zipped], pack)
    model = {"name_or_path": "", "arch": ""} | dict(recipe.model)
    manifest.stage("train", [package["out"], package["key"], recipe.form, model], lambda: {"out": training.write_config(training.Training(recipe.name, package["out"], recipe.trigger, model=model), recipe.form)})
    return manifest
