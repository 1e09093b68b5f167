"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed and rebuilt as a ``tokenizers.Tokenizer``: its normaliser (identity or
a precompiled map), the metaspace marker, byte fallback, and for a unigram model its scores, for a
BPE model the merges that its scores imply. Where nothing merges across the start of a run of markers,
texts are cut there, and each worker encodes a piece, and decodes its ids, when it first meets it, and
keeps the ids as bytes; otherwise whole texts go to the library's threads. Each text's
ids are compared with those of the sentencepiece library (``verify``), and decoded again by the rebuilt decoder.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Callable, Iterator
from sys import getsizeof

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import id_and_bytes, small_batches, table

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
#: Bytes, estimated, of the pieces whose ids a worker keeps.
ROOM = 450_000_000


def known(pieces) -> set[str]:
    """The ASCII characters that never are unknown."""
    own = {p.piece for p in pieces if p.type in (NORMAL, BYTE)}
    return {c for c in map(chr, range(1, 128)) if c in own or f"<0x{ord(c):02X}>" in own}


def apart(pieces) -> re.Pattern[str]:
    """Cuts text, its markers as spaces, where no merge can cross: before runs of markers, around other marks, and once before a head.

    A mark is an ASCII character, not a letter or digit, that stands in no piece beside a character
    other than marks and the marker before it; so no piece holds both sides of a cut. It is in the vocabulary,
    if only as a byte: unknown characters side by side make one id. A head is another such character that
    follows no letter or digit in any piece; nothing is cut behind a tail, which some piece has before a head.
    """
    beside = {pair for p in pieces if p.type == NORMAL for pair in zip(p.piece, p.piece[1:], strict=False)}
    heads = marks = {m for m in known(pieces) if not m.isalnum()} - {" "}
    while wrong := {a for a, b in beside if a in marks and b not in marks} | {b for a, b in beside if b in marks and a not in marks and a != MARK}:
        marks = marks - wrong
    heads = heads - marks - {b for a, b in beside if a.isalpha() or a.isdecimal()}
    tails = {a for a, b in beside if b in heads} - heads - marks - {MARK}
    own, head, tail = ("".join(map(re.escape, sorted(x))) for x in (marks, heads, tails))
    ways = [f" *+[{own}]++"] if own else []
    ways += [f" *+[^ {own}{head}{tail}]++" + (f"(?![{tail}])" if tail else "")] if head else []
    return re.compile("|".join([*ways, f" *+[^ {own}]++", " +"]))


def parse_model(blob: bytes):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(blob)
    return model


def implied_merges(pieces) -> list[tuple[str, str]]:
    """The BPE merges of a score-ranked vocabulary, best score first."""
    ids = {p.piece: i for i, p in enumerate(pieces) if p.type in (NORMAL, USER)}
    found = []
    for i, p in enumerate(pieces):
        if p.type != NORMAL:
            continue
        for cut in range(1, len(p.piece)):
            left, right = p.piece[:cut], p.piece[cut:]
            if left in ids and right in ids:
                found.append((-p.score, ids[left], ids[right], left, right))
    found.sort()
    return [(left, right) for *_, left, right in found]


def build_tokenizer(blob: bytes):
    """A tokenizers.Tokenizer with the model's ids; unigram and BPE models are supported."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = parse_model(blob)
    trainer, norm = model.trainer_spec, model.normalizer_spec
    if trainer.treat_whitespace_as_suffix or any(p.type == USER for p in model.pieces):
        raise ValueError("suffix markers and user-defined pieces are not supported")
    if trainer.model_type == UNIGRAM:
        core = models.Unigram([(p.piece, p.score) for p in model.pieces], unk_id=trainer.unk_id, byte_fallback=trainer.byte_fallback)
    elif trainer.model_type == BPE:
        vocab = {p.piece: i for i, p in enumerate(model.pieces)}
        core = models.BPE(vocab, implied_merges(model.pieces), unk_token=model.pieces[trainer.unk_id].piece, fuse_unk=True, byte_fallback=trainer.byte_fallback, cache_capacity=0)
    else:
        raise ValueError(f"model type {trainer.model_type} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = []
    if norm.precompiled_charsmap:
        steps.append(normalizers.Precompiled(norm.precompiled_charsmap))
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.piece.lstrip(MARK) for p in model.pieces):
        # No piece has a marker after another character, so none spans the start of a run of markers.
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tokenizer.decoder = decoders.Sequence([*piece_decoders(model), decoders.Strip(" ", int(norm.add_dummy_prefix), 0)])
    return tokenizer


def piece_decoders(model) -> list:
    """The decoder's steps but for the first marker: control pieces vanish, the unknown piece has its surface, bytes are fused."""
    from tokenizers import Regex, decoders

    special = [decoders.Replace(Regex(f"^{re.escape(p.piece)}$"), "" if p.type == CONTROL else model.trainer_spec.unk_surface) for p in model.pieces if p.type in (CONTROL, UNKNOWN)]
    return [*special, decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]


class Met(dict):
    """The ids of pieces as bytes of int32; those of a piece that isn't there are learnt when it is asked for."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn, self.held = learn, 0

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.learn(piece)
        self.held += getsizeof(piece) + getsizeof(ids) + 100  # and its place in a table, or in two while the table grows
        return ids


class Codec:
    def __init__(self, blob: bytes, threads: int, verify: bool, room: int = ROOM) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        from tokenizers import decoders

        model = parse_model(blob)
        self.tokenizer, self.reference, self.size = build_tokenizer(blob), None, len(model.pieces)
        norm = model.normalizer_spec
        self.lead = norm.add_dummy_prefix
        self.hidden = {i for i, p in enumerate(model.pieces) if p.type == CONTROL}
        self.marked = {i for i, p in enumerate(model.pieces) if p.type == NORMAL and p.piece.startswith(MARK)}
        self.tokenizer.decoder = decoders.Sequence(piece_decoders(model))
        self.cut = bool(self.tokenizer.pre_tokenizer) and self.lead and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        if self.cut:
            self.cuts, self.room = apart(model.pieces), room
            self.met, self.other = Met(self.learn), {}  # and the texts of pieces that decode to something else
            # Its steps take each id by itself, but for the runs of bytes that one of them fuses.
            self.in_runs = {i for i, p in enumerate(model.pieces) if re.fullmatch("<0x..>", p.piece)}
            self.texts = self.tokenizer.decode_batch([[i] for i in range(self.size)], skip_special_tokens=False)
            self.tokenize = self.tokenizer.model.tokenize
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=blob)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [ids for ids, _ in self.there_and_back(texts)]

    def there_and_back(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """Each text's ids, and what they decode to. A piece that no merge crosses is encoded, and its ids decoded, once."""
        return ((ids.tolist(), text) for ids, text in self.arrays(texts))

    def arrays(self, texts: list[str]) -> Iterator[tuple[np.ndarray, str]]:
        """``there_and_back`` with ids as arrays of int32."""
        if not self.cut:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            back = map(self.unmarked, ids, self.tokenizer.decode_batch(ids, skip_special_tokens=False))
            yield from zip((np.asarray(i, np.int32) for i in ids), back, strict=True)
            return
        for t in texts:
            if self.met.held > self.room:  # between texts: what a text's pieces decode to is needed until its end
                self.met, self.other = Met(self.learn), {}
            pieces = self.cuts.findall(" " + t.replace(MARK, " ")) if t else []
            ids = np.frombuffer(b"".join(map(self.met.__getitem__, pieces)), np.int32)
            same = self.other.keys().isdisjoint(pieces)
            yield ids, self.unmarked(ids, "".join(pieces if same else [self.other.get(p, p) for p in pieces]))

    def learn(self, piece: str) -> bytes:
        """The ids of a new piece. They are decoded, and a text other than the piece is kept."""
        ids = [t.id for t in self.tokenize(piece.replace(" ", MARK))]
        text = "".join(map(self.texts.__getitem__, ids)) if self.in_runs.isdisjoint(ids) else self.tokenizer.decode(ids, skip_special_tokens=False)
        if text != piece:
            self.other[piece] = text
        return array("i", ids).tobytes()

    def decode(self, ids: list[int]) -> str:
        if ids and not 0 <= min(ids) <= max(ids) < self.size:
            raise IndexError(f"an id outside the vocabulary of {self.size}")
        return self.unmarked(ids, self.tokenizer.decode(ids, skip_special_tokens=False))

    def unmarked(self, ids: list[int] | np.ndarray, text: str) -> str:
        """The text without the marker that leads its first piece; a space that isn't a marker stays."""
        first = next((i for i in map(int, ids) if i not in self.hidden), None)
        return text[1:] if self.lead and first in self.marked else text


#: The worker's codec by model, so that the next task of the same worker finds it.
_CODECS: dict[tuple, Codec] = {}


def codec(blob: bytes, threads: int, verify: bool) -> Codec:
    key = (hashlib.sha256(blob).digest(), threads, verify)
    if key not in _CODECS:
        _CODECS[key] = Codec(blob, threads, verify)
    return _CODECS[key]


def sentencepiece_encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, verify: bool = True) -> DataFrame:
    """One row per input row: the id, ``ids`` array<int>, ``decoded`` string, ``same_ids`` and ``round_trip``.

    ``same_ids``: the sentencepiece library gives the same ids (null without ``verify``).
    ``round_trip``: decoding gives the text again, with a literal marker character as a space.
    A null text counts as empty: no ids, decoded to the empty string. Repeated rows and null ids pass
    through. An empty table gives an empty result. Texts are encoded whole, whatever their length.
    Only the id and the text column are read, so other columns can have any name.
    """
    spark = df.sparkSession
    docs = id_and_bytes(df, id_col, text_col)
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, threads, verify)
        for batch in batches:
            texts = [b.as_py().decode("utf-8", "replace") for b in batch.column(1)]
            ids, decoded = map(list, zip(*own.arrays(texts), strict=True)) if texts else ([], [])
            same = [np.array_equal(a, b) for a, b in zip(ids, own.reference.encode(texts, return_type="numpy"), strict=True)] if own.reference else [None] * len(ids)
            trips = [a == b.replace(MARK, " ") for a, b in zip(decoded, texts, strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string()), pa.array(same, pa.bool_()), pa.array(trips, pa.bool_())], ["id", "ids", "decoded", "same_ids", "round_trip"])

    small_batches(spark)
    out = docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, ids array<int>, decoded string, same_ids boolean, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def sentencepiece_decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: the id and ``decoded``. Null ids decode to null; ids outside the vocabulary raise.

    Control pieces decode to nothing and the unknown piece to its surface. Bytes that aren't UTF-8 become
    replacement characters. Repeated rows pass through; an empty table gives an empty result.
    """
    spark = df.sparkSession
    with open(model_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, 1, False)
        for batch in batches:
            out = [None if x is None else own.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "decoded"])

    small_batches(spark)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def digest(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: counts and digests in place of texts."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        "same_ids",
        "round_trip",
    )


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(sentencepiece_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))
