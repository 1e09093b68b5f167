"""Sinks with a commit: folders of files, files joined from parts, and archives.

Tasks write beside the target, in a folder that driver and executors share. The commit puts what was
written in its place, and a job that fails leaves nothing behind. No content passes through the driver:
a joined file is written by tasks too, each at its own offset, and the driver adds an archive's directory.
"""

from __future__ import annotations

import os
import pickle
import shutil
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from loomset.session import ship

#: Fixed values of the archive format: signatures, versions (2.0, and 4.5 for large ones), deflate, UTF-8 names, and 1980-01-01.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
VERSION, VERSION64, DEFLATED, UTF8_NAMES, EPOCH = 20, 45, 8, 0x800, 0x21
MOST, MOST_ENTRIES = 0xFFFFFFFF, 0xFFFF
COPIED = 1 << 22


def local(path: str) -> str:
    return unquote(urlparse(path).path) if path.startswith("file:") else path


def put(path: str, data: bytes) -> None:
    """Whole or not at all: a task that is run again replaces what it wrote."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    try:
        with open(part, "wb") as out:
            out.write(data)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.unlink(part)


def contents(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Names with their contents, which are given or are those of a source file."""
    for name, content, source in zip(*(batch.column(c).to_pylist() for c in ("name", "content", "source")), strict=True):
        yield name, Path(local(source)).read_bytes() if content is None else content


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: how many files, or its part with the entries of an archive's directory."""

    n: int = 0
    order: int = 0
    path: str = ""
    size: int = 0
    entries: list[tuple[bytes, int, int, int, int]] = field(default_factory=list)


class FolderSink(DataSource):
    """Files of rows (name, content, source), into the folder ``path``; ``staging`` is where they wait for the commit."""

    @classmethod
    def name(cls) -> str:
        return "file_folder"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FolderWriter(self.options["path"], self.options["staging"])


@dataclass
class FolderWriter(DataSourceArrowWriter):
    folder: str
    staging: str

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        n = 0
        for batch in iterator:
            for name, data in contents(batch):
                put(os.path.join(self.staging, name), data)
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        """A new folder is put in place at once; into one that is there, files go one by one."""
        if not os.path.exists(self.folder):
            os.rename(self.staging, self.folder)
            return
        for entry in os.scandir(self.staging):
            if not entry.name.endswith(".part"):
                os.replace(entry.path, os.path.join(self.folder, entry.name))
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class PartsSink(DataSource):
    """A part of a joined file for each task, in their order; the commit writes a list of them into ``staging``."""

    @classmethod
    def name(cls) -> str:
        return "file_parts"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return PartsWriter(self.options["staging"], self.options["form"])


@dataclass
class PartsWriter(DataSourceArrowWriter):
    staging: str
    form: str

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        order = TaskContext.get().partitionId()
        done = Written(order=order, path=os.path.join(self.staging, f"{order}-{uuid.uuid4().hex[:8]}"))
        with open(done.path, "wb") as out:
            for batch in iterator:
                for name, data in contents(batch):
                    done.n += 1
                    if self.form == "archive":
                        entry, data = member(name.encode(), data, done.size)
                        done.entries.append(entry)
                    out.write(data)
                    done.size += len(data)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        parts = sorted((m for m in messages if m), key=lambda m: m.order)
        put(os.path.join(self.staging, "parts"), pickle.dumps([(m.path, m.size, m.entries) for m in parts]))

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


def member(name: bytes, data: bytes, at: int) -> tuple[tuple[bytes, int, int, int, int], bytes]:
    """An archive's member: its entry (name, checksum, packed size, size, offset) and its bytes with the header before them."""
    packer = zlib.compressobj(wbits=-15)
    packed, crc = packer.compress(data) + packer.flush(), zlib.crc32(data)
    head = struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8_NAMES, DEFLATED, 0, EPOCH, crc, len(packed), len(data), len(name), 0)
    return (name, crc, len(packed), len(data), at), head + name + packed


def directory(entries: Iterator[tuple[bytes, int, int, int, int]], start: int) -> bytes:
    """The end of an archive whose members take ``start`` bytes; large ones get the fields for large ones."""
    out, n = bytearray(), 0
    for name, crc, packed, size, at in entries:
        extra = struct.pack("<HHQ", 1, 8, at) if at >= MOST else b""
        out += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, VERSION, VERSION64 if extra else VERSION, UTF8_NAMES, DEFLATED, 0, EPOCH, crc, packed, size, len(name), len(extra), 0, 0, 0, 0, min(at, MOST))
        out += name + extra
        n += 1
    size = len(out)
    if n >= MOST_ENTRIES or start >= MOST or size >= MOST:
        out += struct.pack("<IQHHIIQQQQ", END64, 44, VERSION64, VERSION64, 0, 0, n, n, size, start)
        out += struct.pack("<IIQI", LOCATOR, 0, start + size, 1)
    out += struct.pack("<IHHHHIIH", END, 0, 0, min(n, MOST_ENTRIES), min(n, MOST_ENTRIES), min(size, MOST), min(start, MOST), 0)
    return bytes(out)


def filed(rows: DataFrame) -> DataFrame:
    """(name, content, source) of rows that have one of the two."""
    have = set(rows.columns)
    return rows.select("name", (F.col("content").cast("binary") if "content" in have else F.lit(None).cast("binary")).alias("content"), (F.col("source") if "source" in have else F.lit(None).cast("string")).alias("source"))


def _staging(beside: str) -> str:
    path = os.path.join(os.path.dirname(os.path.abspath(beside)), f".loomset-{uuid.uuid4().hex[:12]}")
    os.makedirs(path)
    return path


def _save(rows: DataFrame, sink: type[DataSource], **options: str) -> None:
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(sink)
    try:
        rows.write.format(sink.name()).mode("append").options(**options).save()
    except Exception:
        shutil.rmtree(options["staging"], ignore_errors=True)  # the plan may fail before there is a writer to abort
        raise


def write_folder(rows: DataFrame, folder: str) -> None:
    """Writes rows (name, content) or (name, source): a new folder appears when all is written, in an old one files are replaced then.

    Names are unique; a row without a content and source is an error.
    """
    _save(filed(rows), FolderSink, path=folder, staging=_staging(folder))


def write_joined(rows: DataFrame, path: str, order: Column, form: str = "lines") -> None:
    """Writes rows (name, content) or (name, source) by ``order`` into one file, which appears when it is whole.

    ``form`` is "lines", the contents one after the other, or "archive". Members are packed by the tasks. The
    target must not be there: it isn't written over.
    """
    spark, staging = rows.sparkSession, _staging(path)
    try:
        ordered = rows.repartitionByRange(order).sortWithinPartitions(order)
        _save(filed(ordered), PartsSink, staging=staging, form=form)
        with open(os.path.join(staging, "parts"), "rb") as file:
            parts = pickle.load(file)
        offsets, at = [], 0
        for _, size, _ in parts:
            offsets.append(at)
            at += size
        whole = os.path.join(staging, "whole")
        with open(whole, "wb") as out:
            out.truncate(at)
        if copies := [(p, offset) for (p, size, _), offset in zip(parts, offsets, strict=True) if size]:
            spark.createDataFrame(copies, "path string, offset long").repartition(len(copies)).mapInArrow(_copied(whole), "n long").agg(F.sum("n")).collect()
        if form == "archive":
            entries = ((name, crc, packed, size, offset + spot) for (_, _, listed), offset in zip(parts, offsets, strict=True) for name, crc, packed, size, spot in listed)
            with open(whole, "ab") as out:
                out.write(directory(entries, at))
        os.link(whole, path)  # unlike a rename, it fails where something is
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _copied(whole: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for path, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with open(path, "rb") as part, open(whole, "r+b") as out:
                    out.seek(offset)
                    while data := part.read(COPIED):
                        out.write(data)
                        n += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return run


def write_sidecars(rows: DataFrame, folder: str) -> None:
    """Writes the captions of rows (name, caption) beside their images, as ``stem.txt``, all at once; null captions have none."""
    named = rows.where("caption IS NOT NULL").select(F.concat(F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""), F.lit(".txt")).alias("name"), F.col("caption").alias("content"))
    write_folder(named, folder)
