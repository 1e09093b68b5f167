"""Packaged datasets: numbered images with captions, their index, metadata and archive.

The folder must be one that driver and executors share, as for any output of a job.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
import zipfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import export, lint, selection
from loomset.sources import sinks


def free_path(path: Path, mark: str = "-") -> Path:
    """``path``, or with the first number from 2 on that is free."""
    stem, suffix = (path.stem, path.suffix) if path.suffix in (".zip", ".yaml", ".toml") else (path.name, "")
    spot, n = path, 1
    while spot.exists():
        n += 1
        spot = path.with_name(f"{stem}{mark}{n}{suffix}")
    return spot


def package(items: DataFrame, root: str, name: str, trigger: str = "", metadata: dict | None = None) -> str:
    """Packages items (ord, path, caption) as 01.png, 01.txt and so on, with metadata.jsonl, metadata.json and README.txt.

    Items without a caption (null) are left out, blank ones stay. An existing dataset is never touched:
    the new folder gets a number. Returns the folder.
    """
    spark = items.sparkSession
    slug = spark.range(1).select(T.slugify(F.lit(name or trigger or "character"))).first()[0]
    os.makedirs(root, exist_ok=True)
    staging = Path(root) / f".loomset-{uuid.uuid4().hex[:12]}"
    ext = F.regexp_extract("path", r"[^/.](\.[^./]*)$", 1)
    kept = export.numbered(items.where("caption IS NOT NULL"), "ord").withColumn("suffix", T.normalize_suffix(ext))
    kept = kept.select("number", "caption", "suffix", F.col("path").alias("source"), export.file_name(F.col("number"), F.col("suffix")).alias("name"), export.file_name(F.col("number"), F.lit(".txt")).alias("text_name"))
    images = kept.select("name", F.lit(None).cast("binary").alias("content"), "source")
    texts = kept.select(F.col("text_name").alias("name"), F.col("caption").cast("binary").alias("content"), F.lit(None).cast("string").alias("source"))
    try:
        sinks.write_folder(images.unionByName(texts), str(staging))
        line = F.concat(F.to_json(F.struct(F.col("name").alias("file_name"), F.col("caption").alias("text")), {"writeNonAsciiCharacterAsCodePoint": "true"}), F.lit("\n"))
        sinks.write_joined(kept.select("number", "name", line.alias("content")), str(staging / "metadata.jsonl"), F.col("number"))
        n = kept.count()
        kinds = lint.segment_stats(kept.where("trim(caption) <> ''").select("caption")).first()
        found = {"caption_style": "tags" if kinds.tags else "prose"} if kinds and kinds.n else {}
        every = {"created": datetime.now().isoformat(timespec="seconds")} | found | (metadata or {})
        (staging / "metadata.json").write_text(json.dumps(every, indent=2, default=str), encoding="utf-8")
        suffixes = selection.joined_set(kept, "suffix").first()[0] or ".png"
        lines = [f"Training dataset: {name or trigger or 'unnamed'}", f"Trigger: {trigger or 'none'}", f"{n} images NN{suffixes}, each with its caption NN.txt; metadata.jsonl has the same captions."]
        (staging / "README.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
        while True:
            folder = free_path(Path(root) / f"{slug}-dataset")
            try:
                folder.mkdir()  # whoever makes it has the number
                break
            except FileExistsError:
                continue
        os.rename(staging, folder)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    return str(folder)


def zipped(folder: str, spark: SparkSession | None = None) -> str:
    """The folder as an archive beside it, entries in order under the folder's name; never over an existing one.

    With a session, files are packed by its tasks, and the driver writes the directory only.
    """
    base = Path(folder)
    if not base.is_dir():
        raise ValueError(f"no dataset folder: {folder}")
    listed = sorted((f"{base.name}/{p.relative_to(base).as_posix()}", str(p)) for p in base.rglob("*") if p.is_file())
    path = free_path(base.parent / f"{base.name}.zip")
    if spark:
        sinks.write_joined(spark.createDataFrame(listed, "name string, source string"), str(path), F.col("name"), "archive")
        return str(path)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for name, file in listed:
            out.write(file, name)
    return str(path)
