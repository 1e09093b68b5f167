"""Sizes of images from the headers of their files, without decoding: PNG, GIF, BMP, JPEG, WebP and TIFF.

The data source seeks: it reads the blocks that hold a header, and passes over what lies between them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomset.session import ship
from loomset.sources import files

Size = tuple[int, int] | None
#: Bytes that are read at once.
BLOCK = 64
#: JPEG's frame markers (those of 0xC0 to 0xCF that aren't tables), and its markers without a body.
FRAMES = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
BARE = frozenset(range(0xD0, 0xD9)) | {0x01}


def _little(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "little")


def _big(data: bytes, at: int, n: int) -> int:
    return int.from_bytes(data[at : at + n], "big")


def _jpeg(data: bytes) -> Size:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind in FRAMES:
            return (_big(data, at + 7, 2), _big(data, at + 5, 2)) if at + 9 <= len(data) else None
        # A marker may be preceded by any number of filling bytes.
        at += 1 if kind == 0xFF else 2 if kind in BARE else 2 + max(2, _big(data, at + 2, 2))
    return None


def _webp(data: bytes) -> Size:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return _little(data, 24, 3) + 1, _little(data, 27, 3) + 1
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = _little(data, 21, 4)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        return _little(data, 26, 2) & 0x3FFF, _little(data, 28, 2) & 0x3FFF
    return None


def _tiff(data: bytes) -> Size:
    number = _little if data[:2] == b"II" else _big
    at, found = number(data, 4, 4), {}
    if at + 2 > len(data):
        return None
    for k in range(number(data, at, 2)):
        spot = at + 2 + 12 * k
        if spot + 12 > len(data):
            return None
        tag, kind = number(data, spot, 2), number(data, spot + 2, 2)
        if tag in (256, 257):
            found[tag] = number(data, spot + 8, 2 if kind == 3 else 4)
    return (found[256], found[257]) if len(found) == 2 else None


def image_size(data: bytes) -> Size:
    """(width, height) by the file's own header, whatever its extension says; None for what can't be read."""
    size: Size = None
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR" and len(data) >= 24:
        size = _big(data, 16, 4), _big(data, 20, 4)
    elif data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        size = _little(data, 6, 2), _little(data, 8, 2)
    elif data[:2] == b"BM" and len(data) >= 26:
        # Rows of a BMP that run from top to bottom are told by a negative height.
        size = _little(data, 18, 4), abs(int.from_bytes(data[22:26], "little", signed=True))
    elif data[:2] == b"\xff\xd8":
        size = _jpeg(data)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        size = _webp(data)
    elif data[:4] in (b"II*\x00", b"MM\x00*"):
        size = _tiff(data)
    return size if size and min(size) > 0 else None


class Peeked:
    """A file as bytes of which only those blocks are read that are looked at."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.blocks = file, size, {}

    def __len__(self) -> int:
        return self.size

    def _block(self, i: int) -> bytes:
        if i not in self.blocks:
            self.file.seek(i * BLOCK)
            self.blocks[i] = self.file.read(BLOCK)
        return self.blocks[i]

    @property
    def taken(self) -> int:
        return sum(map(len, self.blocks.values()))

    def __getitem__(self, at: int | slice) -> int | bytes:
        if isinstance(at, int):
            return self._block(at // BLOCK)[at % BLOCK]
        start, stop, _ = at.indices(self.size)
        data = b"".join(self._block(i) for i in range(start // BLOCK, -(-stop // BLOCK)))
        return data[start % BLOCK : start % BLOCK + max(0, stop - start)]


@dataclass
class Listed(InputPartition):
    """Files that one task looks into: address, path in its file system and size."""

    files: list[tuple[str, str, int]]


class ImageHeaders(DataSource):
    """``spark.read.format("image_headers").load(folder)``: a row per image, from a few bytes of its file.

    Options: ``path``, a folder as any of Arrow's file systems knows it; ``extensions``, of the files that are looked
    into; ``files_per_task``. Other files are never opened. Direct children only, like a folder's listing.
    """

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return "path string, name string, stem string, ext string, length long, w int, h int, bytes_read long"

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader(self.options)


class HeaderReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.extensions = set((options.get("extensions") or ",".join(files.IMAGE_EXTENSIONS)).lower().split(","))
        self.each = int(options.get("files_per_task") or 256)

    def _opened(self):
        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[InputPartition]:
        where, base = self._opened()
        root = self.path.rstrip("/")
        listed = [(f"{root}/{i.base_name}", i.path, i.size) for i in where.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.File and _ending(i.base_name) in self.extensions]
        listed.sort()
        return [Listed(listed[i : i + self.each]) for i in range(0, len(listed), self.each)] or [Listed([])]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        where, _ = self._opened()
        rows: list[list] = [[] for _ in range(8)]
        for address, path, size in partition.files:
            name = path.rsplit("/", 1)[-1]
            try:
                with where.open_input_file(path) as file:
                    head = Peeked(file, size)
                    found = image_size(head) or (None, None)
                    taken = head.taken
            except (OSError, IndexError):  # gone or damaged
                found, taken = (None, None), 0
            for column, value in zip(rows, (address, name, name[: -len(_ending(name)) - 1], _ending(name), size, *found, taken), strict=True):
                column.append(value)
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], ["path", "name", "stem", "ext", "length", "w", "h", "bytes_read"])


def _ending(name: str) -> str:
    """The extension in lower case; a name that begins with its only point has none."""
    stem, point, ext = name.rpartition(".")
    return ext.lower() if point and stem else ""


def image_headers(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(path, name, stem, ext, length, w, h, bytes_read) of the folder's images, w and h null where the header can't be read."""
    ship(spark)
    spark.dataSource.register(ImageHeaders)
    return spark.read.format("image_headers").options(**options).load(folder)


def image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, w, h) of the folder's readable images; those without a readable header are left out."""
    return image_headers(spark, folder).select("path", "w", "h").where("w IS NOT NULL")


def sized_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(path, w, h, has_caption) of the folder's readable images: what a dataset's statistics need, without the images."""
    listed = image_headers(spark, folder).where("w IS NOT NULL")
    return listed.join(files.captions(spark, folder).select("stem", F.lit(True).alias("found")).distinct(), "stem", "left").select("path", "w", "h", F.coalesce("found", F.lit(False)).alias("has_caption"))
