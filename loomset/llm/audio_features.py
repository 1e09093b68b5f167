"""Media columns: 8-bit PCM in a WAV container, and its audio features.

A payload is stored losslessly as unsigned 8-bit samples of a mono WAV file. Features come from the
samples read back from a table of the shared folder: polyphase resampling by a windowed-sinc filter, overlapped log-mel filterbanks,
and energy segments by hysteresis (a segment opens at a high threshold and ends at a low one), given
as time spans. The log-mel frames are kept as fixed-shape Arrow tensors in a second table, and what
is told of them is computed from the tensors read back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, id_and_bytes, materialize, small_batches, table

#: Payloads are padded with bytes 255 to a positive multiple of this.
UNIT = 576
RATE, UP, DOWN = 16_000, 1, 2
FRAME, HOP, MELS = 256, 128, 16
#: Frames handled at once: bounds the memory for a text of any length.
CHUNK = 4096
#: Taps of the resampling filter for each phase.
TAPS = 16
#: Hysteresis on the frame energy in dB above the median: open, close.
OPEN_DB, CLOSE_DB = 3.0, 1.0


def pad(body: bytes) -> bytes:
    short = -len(body) % UNIT if body else UNIT
    return body + b"\xff" * short


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + (len(payload) & 1)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate, read chunk by chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", media[at + 8 : at + 24])
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + n], rate
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


@lru_cache(4)
def phases(up: int, down: int) -> np.ndarray:
    """The windowed-sinc low-pass filter, one row of taps for each phase."""
    n = TAPS * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    h *= up / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, up).T[:, ::-1], np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: only output samples are computed, each by its phase's taps."""
    bank = phases(up, down)
    padded = np.concatenate([np.zeros(TAPS - 1, np.float32), x.astype(np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    n = -(-len(x) * up // down)
    out = np.empty(n, np.float32)
    for first in range(up):
        at = np.arange(first, n, up)
        source, phase = at * down // up, (first * down) % up
        step = down if len(at) < 2 else int(source[1] - source[0])
        for lo in range(0, len(at), 1 << 18):
            part = windows[source[lo] : source[min(lo + (1 << 18), len(at)) - 1] + 1 : step]
            out[at[lo : lo + (1 << 18)]] = part @ bank[phase]
    return out


@lru_cache(4)
def mel_bank(rate: int, mels: int = MELS, frame: int = FRAME) -> np.ndarray:
    """Triangles evenly spaced on the mel scale, a column each."""
    mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(mel(0.0), mel(rate / 2), mels + 2) / 2595.0) - 1.0)
    f = np.fft.rfftfreq(frame, 1.0 / rate)[:, None]
    rise, fall = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0.0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Frames x mels in dB, and each frame's energy in dB. The last frame is padded with zeros, so every sample is in a frame."""
    short = FRAME - len(x) if len(x) < FRAME else -(len(x) - FRAME) % HOP
    x = np.concatenate([x, np.zeros(short, np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(rate)
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for lo in range(0, len(frames), CHUNK):
        part = frames[lo : lo + CHUNK] * window
        spectrum = np.fft.rfft(part)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[lo : lo + CHUNK] = 10 * np.log10(power @ bank + 1e-6)
        energy[lo : lo + CHUNK] = 10 * np.log10(np.einsum("ij,ij->i", part, part) / FRAME + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [start, end) by hysteresis around the median energy."""
    level = float(np.median(energy))
    strong, weak = energy >= level + OPEN_DB, energy < level + CLOSE_DB
    events = np.flatnonzero(strong | weak)
    if not len(events):
        return []
    state = strong[events]
    turns = np.flatnonzero(np.diff(np.concatenate([[False], state, [False]]).astype(np.int8)))
    bounds = np.concatenate([events, [len(energy)]])
    return [(int(bounds[a]), int(bounds[b])) for a, b in turns.reshape(-1, 2)]


def features(samples: bytes, rate: int) -> dict:
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0) / 128.0
    y, out_rate = resample(x), rate * UP // DOWN
    mels, energy = log_mel(y, out_rate)
    return {"mels": mels, "spans": [(a * HOP / out_rate, min((b - 1) * HOP + FRAME, len(y)) / out_rate) for a, b in segments(energy)]}


def mel_tensor(mels: np.ndarray, rows: int = 16) -> pa.ExtensionArray:
    """Log-mel frames as a fixed-shape Arrow tensor column of [rows, MELS]; the last is filled with the floor value."""
    short = -len(mels) % rows
    full = np.concatenate([mels, np.full((short, MELS), -60.0, np.float32)]).reshape(-1, rows, MELS)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(full))


def tensor_bytes(mels: np.ndarray) -> bytes:
    """The tensor column as an Arrow IPC stream, which keeps its shape and type."""
    column = mel_tensor(mels)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([pa.field("log_mel", column.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([column], ["log_mel"]))
    return sink.getvalue().to_pybytes()


def read_tensors(blob: bytes) -> np.ndarray:
    with pa.ipc.open_stream(pa.BufferReader(blob)) as source:
        return source.read_all().column("log_mel").combine_chunks().to_numpy_ndarray()


SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, tensors binary, spans array<struct<start_s: double, end_s: double>>"
SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes a table with a row per input row and reads it back: the id, ``n_bytes`` of the text and ``media``, the WAV file of its padded payload.

    A null or empty text gives one unit of padding. Repeated rows and null ids pass through; an empty
    table gives an empty result; only the id and the text column are read.
    """
    docs = id_and_bytes(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [b.as_py() for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) for b in bodies], pa.int64()), pa.array([to_wav(pad(b)) for b in bodies], pa.binary())], ["id", "n_bytes", "media"])

    small_batches(df.sparkSession)
    media = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)
    return materialize(media, "media")


def media_features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads each stored file, writes a table and reads it back: the file's checksums, ``n_frames``, log-mel ``tensors`` (an Arrow stream) and ``spans`` in seconds.

    Null media is an error: ``store_media`` never makes it. Repeated rows and null ids pass through.
    """
    kind = media.schema[id_col].dataType.simpleString()
    rows = media.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for blob in batch.column(2):
                raw = blob.as_py()
                samples, rate = from_wav(raw)
                got = features(samples, rate)
                spans = [{"start_s": round(a, 3), "end_s": round(b, 3)} for a, b in got["spans"]]
                row = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), len(got["mels"]), tensor_bytes(got["mels"]), spans)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), SPANS]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_frames", "tensors", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["id", "n_bytes", *names])

    small_batches(media.sparkSession)
    return materialize(rows.mapInArrow(run, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col), "media-features")


def feature_digest(found: DataFrame) -> DataFrame:
    """The rows of ``media_features`` with ``feature`` in place of ``tensors`` and ``spans``.

    It is a digest of shape, values of the stored tensors rounded to 0.1 dB, and spans in milliseconds,
    equal for equal texts.
    """
    kept = [c for c in found.columns if c not in ("tensors", "spans")]
    names = [f"c{i}" for i in range(len(kept))]
    kinds = ", ".join(f"{n} {found.schema[c].dataType.simpleString()}" for n, c in zip(names, kept, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for n, blob, spans in zip(batch.column(len(kept)), batch.column(len(kept) + 1), batch.column(len(kept) + 2).to_pylist(), strict=True):
                mels = read_tensors(blob.as_py()).reshape(-1, MELS)[: n.as_py()]
                spans = [(x["start_s"], x["end_s"]) for x in spans]
                value = hashlib.sha256(np.round(mels * 10).astype("<i2").tobytes() + repr(spans).encode()).hexdigest()[:32]
                told.append(f"{len(mels)}x{MELS};spans={len(spans)};loud={sum(b - a for a, b in spans):.3f};{value}")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(told, pa.string())], [*names, "feature"])

    small_batches(found.sparkSession)
    rows = found.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, kept, strict=True)), F.col("n_frames").alias("n"), "tensors", "spans")
    return rows.mapInArrow(run, f"{kinds}, feature string").toDF(*kept, "feature")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = store_media(table(spark, sf_dir, "documents"))
    found = media_features(media)
    discard(media)
    return feature_digest(found).drop("n_frames")
