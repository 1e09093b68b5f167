"""Image folders with caption sidecars, tag vocabularies, and packaged datasets."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.functions import text as T
from loomset.operators import export

#: Extensions of images.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff"]


def _parts(df: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return df.withColumns({"folder": F.regexp_replace("path", r"/[^/]+$", ""), "name": name, "stem": F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r".\.([^.]*)$", 1))})


def files(spark: SparkSession, folder: str | list[str]) -> DataFrame:
    return _parts(spark.read.format("binaryFile").load(folder))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, folder, name, stem, ext) of the folder's images; the extension's case doesn't matter."""
    return files(spark, folder).where(F.col("ext").isin(IMAGE_EXTENSIONS)).select("path", "folder", "name", "stem", "ext")


def caption_text(content: Column) -> Column:
    """UTF-8 without a byte order mark, bad bytes replaced, stripped."""
    text = F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"^\x{FEFF}", "")
    return F.regexp_replace(text, rf"^{T.SPACE.removeprefix('(?U)')}+|{T.SPACE.removeprefix('(?U)')}+$".replace("^", "(?U)^", 1), "")


def captions(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, stem, caption) of the folder's text files."""
    return files(spark, folder).where("ext = 'txt'").select("folder", "stem", caption_text(F.col("content")).alias("caption"))


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Images with their captions, null where there is no sidecar, numbered by path."""
    joined = list_images(spark, folder).join(captions(spark, folder), ["folder", "stem"], "left")
    listed = export.numbered(joined.select(F.col("name").alias("image"), "path", "ext", "caption"), "path")
    return listed.select(F.col("number").alias("ord"), "image", "path", "ext", "caption")


def tag_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(idx, name, category) by column name, whichever layout the file has; an empty file is an error."""
    lines = spark.read.option("header", True).csv(path)
    rows = lines.select(F.monotonically_increasing_id().alias("idx"), "name", F.col("category").cast("int").alias("category")) if {"name", "category"} <= set(lines.columns) else None
    if rows is None or rows.isEmpty():
        raise ValueError(f"{path} has no tags")
    return rows


def png_size(content: Column) -> Column:
    """struct<w, h> from a PNG header, null for other files."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("w"), number(21).alias("h")))


def expanded(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The images of the folders among ``paths`` and the files among them, in the order given; none at all is an error."""
    # A line for each path that a user names, each with its folder's listing.
    parts = [(list_images(spark, p) if Path(p).is_dir() else _parts(spark.createDataFrame([(p,)], "path string"))).withColumn("place", F.lit(i)) for i, p in enumerate(paths)]
    if not parts or (every := reduce(DataFrame.unionByName, parts)).isEmpty():
        raise ValueError("there are no images in the given paths")
    return every.orderBy("place", "path")


def chosen_inputs(spark: SparkSession, uploads: list[str], folder: str) -> DataFrame:
    """Uploads come before a folder, which has to hold images; neither is an error."""
    if not uploads and not folder.strip():
        raise ValueError("give images, or a folder of images")
    return expanded(spark, uploads or [folder.strip()])


def dataset_metadata(folder: str) -> dict:
    """What a packaged dataset says of itself in metadata.json; {} where that is absent, damaged or no table."""
    try:
        found = json.loads((Path(folder) / "metadata.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def type_note(folder: str, selected: str) -> str:
    """A line on the type that a dataset records, with a warning where it isn't the selected one; "" where it records none."""
    found = dataset_metadata(folder)
    recorded, style = (str(found.get(k) or "") for k in ("dataset_type", "caption_style"))
    if not recorded:
        return ""
    line = f"metadata.json says: {recorded}" + (f", captions of {style}." if style else ".")
    return line if recorded == selected else f"{line} The selected type is {selected}, and sample prompts follow it."


def save_caption(folder: str, name: str, text: str) -> str:
    """Writes one image's sidecar anew, stripped, and returns its path."""
    if not folder.strip() or not name:
        raise ValueError("a folder and an image are needed")
    spot = (Path(folder.strip()) / name).with_suffix(".txt")
    spot.write_text(text.strip(), encoding="utf-8")
    return str(spot)
