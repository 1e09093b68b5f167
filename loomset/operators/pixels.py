"""Pixels in Arrow batches: PNG files, resampling, masks, crops, and the preparation of source images.

An image is an array of height x width x channels (1, 3 or 4) of bytes. PNG files are read and written
with zlib alone; other formats need a ``decode`` function. Models come in as functions, sent to the
executors, so that a batch opens what it needs once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomset.session import ship

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Below this share of a prop in the subject it isn't cut out; below this variance an image is blurred.
MERGED_SHARE, BLURRED = 0.10, 120.0


def _chunk(kind: bytes, body: bytes) -> bytes:
    return len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")


def write_png(image: np.ndarray) -> bytes:
    image = image[..., None] if image.ndim == 2 else image
    h, w, c = image.shape
    head = w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes([8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0])
    lines = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * c)], axis=1)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Eight-bit, non-interlaced PNG with or without palette; raises ValueError for anything else."""
    if data[:8] != SIGNATURE:
        raise ValueError("cannot identify image: no PNG")
    at, packed, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = body
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if head is None or len(head) < 13 or head[8] != 8 or head[12] or head[9] not in (*CHANNELS, 3):
        raise ValueError("cannot identify image: unsupported PNG")
    w, h, c = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), CHANNELS.get(head[9], 1)
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
        lines = raw[: h * (w * c + 1)].reshape(h, w * c + 1)
    except (zlib.error, ValueError) as e:
        raise ValueError("truncated PNG") from e
    out, above = np.zeros((h, w * c), np.uint8), np.zeros(w * c, np.uint8)
    for y in range(h):
        above = out[y] = _unfilter(lines[y, 0], lines[y, 1:], above, c)
    image = out.reshape(h, w, c)
    if palette is not None and head[9] == 3:
        return palette[image[..., 0]]
    return image[..., [0, 0, 0, 1]] if c == 2 else image


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, c: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, c), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("truncated PNG")
    got, up = [0] * c + line.tolist(), [0] * c + above.tolist()
    for i in range(c, len(got)):
        left, over, corner = got[i - c], up[i], up[i - c]
        if kind == 3:
            guess = (left + over) // 2
        else:
            guess = min((left, over, corner), key=lambda v, p=left + over - corner: abs(p - v))
        got[i] = (got[i] + guess) & 255
    return np.array(got[c:], np.uint8)


def luminance(image: np.ndarray) -> np.ndarray:
    if image.shape[2] == 1:
        return image[..., 0]
    return ((image[..., :3].astype(np.int64) @ np.array([19595, 38470, 7471]) + 0x8000) >> 16).astype(np.uint8)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(0, 1 - np.abs(x))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _cubic(x: np.ndarray) -> np.ndarray:
    """The cubic convolution kernel whose slope at 1 is -1/2."""
    x = np.abs(x)
    return np.where(x < 1, 1.5 * x**3 - 2.5 * x**2 + 1, np.where(x < 2, -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2, 0))


#: Kernels of resampling, with how far they reach.
KERNELS = {"lanczos": (_lanczos, 3.0), "bicubic": (_cubic, 2.0), "triangle": (_triangle, 1.0)}


#: Bits behind the point of a coefficient: products with bytes, and their sums, fit 32 bits.
POINT = 22


def _taps(old: int, new: int, kernel: Callable, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For each new place the old places that go into it, and their coefficients as integers; a row's sum is one, but for rounding."""
    scale = old / new
    wide = max(scale, 1.0)
    centre = (np.arange(new) + 0.5) * scale
    first = np.maximum(0, (centre - reach * wide + 0.5).astype(np.int64))
    last = np.minimum(old, (centre + reach * wide + 0.5).astype(np.int64))
    spot = first[:, None] + np.arange(int((last - first).max()))
    inside = spot < last[:, None]
    w = np.where(inside, kernel((spot - centre[:, None] + 0.5) / wide), 0.0)
    w = w * (1.0 / w.sum(1, keepdims=True)) * (1 << POINT)
    return np.minimum(spot, old - 1), np.trunc(w + np.copysign(0.5, w)).astype(np.int64)


def _pass(image: np.ndarray, new: int, kernel: Callable, reach: float) -> np.ndarray:
    """One pass along the rows' places, in whole numbers: the sum of byte times coefficient, rounded at the point and held within a byte."""
    if image.shape[1] == new:
        return image
    spots, weights = _taps(image.shape[1], new, kernel, reach)
    total = np.full((image.shape[0], new, image.shape[2]), 1 << (POINT - 1), np.int64)
    for spot, weight in zip(spots.T, weights.T, strict=True):
        total += image[:, spot] * weight[:, None]
    return np.clip(total >> POINT, 0, 255).astype(np.uint8)


def resample(image: np.ndarray, w: int, h: int, kernel: str = "lanczos") -> np.ndarray:
    """Columns first, then rows, in fixed point, each pass rounded to bytes; a side that stays isn't touched."""
    image = image[..., None] if image.ndim == 2 else image
    fn, reach = KERNELS[kernel]
    across = _pass(image, w, fn, reach)
    return _pass(across.transpose(1, 0, 2), h, fn, reach).transpose(1, 0, 2)


def tagger_input(image: np.ndarray, side: int = 448) -> np.ndarray:
    """float32 (1, side, side, 3), blue first, 0 to 255: what a tagger reads. Transparency becomes white, as do the bars that make a square."""
    image = (image[..., None] if image.ndim == 2 else image).astype(float)
    if image.shape[2] in (2, 4):
        share = image[..., -1:] / 255
        image = np.floor(image[..., :-1] * share + 255 * (1 - share) + 0.5)
    h, w, c = image.shape
    long = max(h, w)
    square = np.full((long, long, 3), 255, np.uint8)
    top, left = (long - h) // 2, (long - w) // 2
    square[top : top + h, left : left + w] = image if c == 3 else np.repeat(image, 3, axis=2)
    return resample(square, side, side, "bicubic")[None, ..., ::-1].astype(np.float32)


def to_long_side(image: np.ndarray, target: int) -> np.ndarray:
    h, w = image.shape[:2]
    if max(h, w) == target:
        return image
    return resample(image, max(1, round(w * target / max(h, w))), max(1, round(h * target / max(h, w))))


def difference_bits(image: np.ndarray, size: int = 8) -> int:
    """The signed 64-bit hash of neighbours in an (size + 1) x size thumbnail."""
    small = resample(luminance(image), size + 1, size, "triangle")[..., 0].astype(int)
    bits = (small[:, :-1] < small[:, 1:]).reshape(-1)
    return int.from_bytes(np.packbits(bits).tobytes()[:8].rjust(8, b"\0"), "big", signed=True)


def laplacian_variance(grey: np.ndarray, wrap: bool) -> float:
    """Variance of the Laplacian, over wrapped edges or over the inner part, 0 below 3 pixels."""
    g = grey.astype(float)
    if wrap:
        return float((sum(np.roll(g, s, a) for s in (1, -1) for a in (0, 1)) - 4 * g).var())
    if min(g.shape) < 3:
        return 0.0
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def dilate(mask: np.ndarray, px: int) -> np.ndarray:
    """Grown by ``px`` in both directions."""
    for axis in (0, 1) if px > 0 else ():
        grown = mask.copy()
        for s in range(1, px + 1):
            ahead = [slice(None)] * 2
            back = [slice(None)] * 2
            ahead[axis], back[axis] = slice(s, None), slice(None, -s)
            grown[tuple(ahead)] |= mask[tuple(back)]
            grown[tuple(back)] |= mask[tuple(ahead)]
        mask = grown
    return mask


def without_prop(subject: np.ndarray, prop: np.ndarray, px: int = 0) -> tuple[np.ndarray, float]:
    """The subject's mask without a prop that is merged into it, and the prop's share in it."""
    share = float((subject & prop).sum() / prop.sum()) if prop.any() else 0.0
    return (subject & ~dilate(prop, px) if share >= MERGED_SHARE else subject), share


def cut_out(image: np.ndarray, mask: np.ndarray, alpha: bool = False) -> np.ndarray:
    """The masked part on white, or the image with the mask as its alpha."""
    rgb = image[..., :3] if image.shape[2] >= 3 else image[..., [0, 0, 0]]
    if alpha:
        return np.dstack([rgb, mask.astype(np.uint8) * np.uint8(255)])
    return np.where(mask[..., None], rgb, np.uint8(255))


def crop_to_content(image: np.ndarray, tolerance: int = 8, margin: float = 0.02) -> np.ndarray:
    """The box of what isn't background and a margin; an empty image stays as it is."""
    content = image[..., 3] > 0 if image.shape[2] == 4 else (255 - image.astype(int) > tolerance).any(-1)
    if not content.any():
        return image
    h, w = content.shape
    add = round(max(h, w) * max(0.0, margin))
    ys, xs = np.flatnonzero(content.any(1)), np.flatnonzero(content.any(0))
    return image[max(0, ys[0] - add) : min(h, ys[-1] + add + 1), max(0, xs[0] - add) : min(w, xs[-1] + add + 1)]


@dataclass(frozen=True)
class Preparation:
    """How source images are prepared. ``restore`` takes and returns an image; ``segment`` gives the mask of a term."""

    target: int = 1024
    force_restore: bool | None = None
    restore: Callable[[np.ndarray], np.ndarray] | None = None
    segment: Callable[[np.ndarray, str], np.ndarray] | None = None
    subject: str = ""
    exclude: tuple[str, ...] = ()
    alpha: bool = False
    dilate_px: int = 0
    decode: Callable[[bytes], np.ndarray] = read_png


def restore_reason(image: np.ndarray, ext: str, target: int) -> str:
    side = max(image.shape[:2])
    if side < target:
        return f"long side {side}px < target {target}px"
    if ext.lower() in ("jpg", "jpeg", "webp"):
        return "lossy source format"
    return "low sharpness (blur/grain)" if laplacian_variance(luminance(image), wrap=True) < BLURRED else ""


def prepare_one(image: np.ndarray, ext: str, how: Preparation) -> tuple[np.ndarray, str]:
    reason = restore_reason(image, ext, how.target)
    if how.restore and (bool(reason) if how.force_restore is None else how.force_restore):
        image = how.restore(image)
    if how.segment and how.subject:
        mask = how.segment(image, how.subject)
        if not mask.any():
            raise ValueError(f"found no '{how.subject}'")
        props = [how.segment(image, term) for term in how.exclude]
        if props:
            mask, _ = without_prop(mask, np.logical_or.reduce(props), how.dilate_px)
        image = crop_to_content(cut_out(image, mask, how.alpha))
    return to_long_side(image, how.target), reason


def _in_batches(files: DataFrame, one: Callable, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """``one(content, ext)`` for each file; a failure fills ``error`` and leaves the other fields null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, ext, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                try:
                    rows.append((path.as_py(), *one(content.as_py() or b"", ext.as_py() or ""), ""))
                except Exception as e:  # the failed image is a row of its own, the batch goes on
                    rows.append((path.as_py(), *[None] * len(fields), str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(fields) + 2)
            kinds = [("path", pa.string()), *fields, ("error", pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])

    ship(files.sparkSession)
    files.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    return files.select("path", "ext", "content").mapInArrow(run, f"path string, {schema}, error string")


def prepared(files: DataFrame, how: Preparation) -> DataFrame:
    """(path, reason, w, h, content, error) for files (path, ext, content); ``content`` is a PNG."""

    def one(content: bytes, ext: str) -> tuple:
        image, reason = prepare_one(how.decode(content), ext, how)
        return reason, image.shape[1], image.shape[0], write_png(image)

    fields = [("reason", pa.string()), ("w", pa.int32()), ("h", pa.int32()), ("content", pa.binary())]
    return _in_batches(files, one, fields, "reason string, w int, h int, content binary")


def measured(files: DataFrame, decode: Callable[[bytes], np.ndarray] = read_png) -> DataFrame:
    """(path, w, h, hash, mean, std, sharpness, error): what near duplicates and quality flags are found from."""

    def one(content: bytes, ext: str) -> tuple:
        image = decode(content)
        grey = luminance(image)
        return image.shape[1], image.shape[0], difference_bits(image), float(grey.mean()), float(grey.std()), laplacian_variance(grey, wrap=False)

    fields = [("w", pa.int32()), ("h", pa.int32()), ("hash", pa.int64()), *((n, pa.float64()) for n in ("mean", "std", "sharpness"))]
    return _in_batches(files, one, fields, "w int, h int, hash long, mean double, std double, sharpness double")
