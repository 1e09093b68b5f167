"""Token counts by a map-side two-tier lookup.

Tier one is a broadcast hash table from frequent pre-tokens to their token counts; tier two is a
bounded cache in each Python worker, kept from task to task and filled by encoding what tier one
lacks. The tokenizer merges nothing across pre-tokens, so a text's count is the sum over them; how
texts are cut is read from the tokenizer's file. No pre-token of a counted text is shuffled: the
plan is a scan, a projection and one map. Only the first tier's table takes an aggregate, over the
pre-tokens of a sample of bounded size.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import id_and_bytes, small_batches, table

#: Longer pre-tokens are encoded each time and not kept.
CACHED_BYTES = 64
#: Fixed value: the pattern of byte-level pre-tokenisers that name none.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space beyond ASCII's (and ASCII's separators): a text with any goes to the library whole where white space counts.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

#: The worker's cache by broadcast, so that the next task of the same worker finds it.
_CACHES: dict[int, tuple[Lengths, Cutter]] = {}


def ascii_pattern(pattern: str) -> re.Pattern[bytes]:
    """A pre-tokeniser's pattern for ASCII texts, where letters and digits are ranges."""
    out, inside = [], False
    for part in re.split(r"(\\p\{[A-Z][a-z]?\}|\\.|[\[\]])", pattern):
        if part.startswith("\\p"):
            if part not in (r"\p{L}", r"\p{N}"):
                raise ValueError(f"no two-tier lookup for a pattern with {part}")
            ranges = "A-Za-z" if part == r"\p{L}" else "0-9"
            part = ranges if inside else f"[{ranges}]"
        elif part in ("[", "]"):
            inside = part == "["
        out.append(part)
    return re.compile("".join(out).encode())


class Cutter:
    """The file's pre-tokens as lookup keys: a text's count is the sum of theirs.

    Pieces of white space and a word after it are cut apart first: no pre-token goes beyond them. An
    ASCII one is cut by the file's own pattern; one with other characters, or with a special token's
    string, is a key as it is, so that the library does its normalisation. Files with steps other than
    those listed here raise.
    """

    def __init__(self, data: str) -> None:
        spec = json.loads(data)
        normal, split = _flat(spec.get("normalizer"), "normalizers"), _flat(spec.get("pre_tokenizer"), "pretokenizers")
        self.lower = any(x["type"] == "Lowercase" for x in normal)
        spaces = [x for x in normal if x["type"] == "Replace"]
        cut, byte_level = split[:-1], split[-1] if split else {}
        known = all(x["type"] in ("NFC", "Lowercase", "Replace") for x in normal) and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in spaces)
        known &= byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and spec.get("model", {}).get("dropout") is None
        if byte_level.get("use_regex"):
            known &= not cut
            pattern, self.drops = BYTE_LEVEL, False
        else:
            known &= len(cut) == 1 and cut[0]["type"] == "Split" and "Regex" in cut[0]["pattern"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
            pattern, self.drops = cut[0]["pattern"]["Regex"] if known else "", True
        specials = spec.get("added_tokens", [])
        known &= not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in specials)
        if not known:
            raise ValueError("no two-tier lookup for a file with these normalisers and pre-tokenisers")
        self.pattern = ascii_pattern(pattern)
        if self.drops and self.pattern.search(b" "):
            raise ValueError("no two-tier lookup for a pattern that keeps white space")
        if not self.drops and (normal or specials and any(t["single_word"] for t in specials)):
            raise ValueError("no two-tier lookup where normalisers meet white space that counts")
        self.special = special_strings(data)
        self.parts = re.compile(rb"[^ \t-\r]+" if self.drops else rb"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")

    def __call__(self, body: bytes) -> list[bytes]:
        plain = body.isascii()
        if not self.drops and OTHER_SPACE.search(body.decode("utf-8", "replace")):
            return [body]
        if plain and not self.special.search(body):
            return self.pattern.findall(body.lower() if self.lower else body)
        keys: list[bytes] = []
        for part in self.parts.findall(body):
            if part.isascii() and not self.special.search(part):
                keys += self.pattern.findall(part.lower() if self.lower else part)
            else:
                keys.append(part)
        return keys


def _flat(step: dict | None, inner: str) -> list[dict]:
    if step is None:
        return []
    return [y for x in step[inner] for y in _flat(x, inner)] if step["type"] == "Sequence" else [step]


def load_encoder(data: str, kind: str) -> Callable[[str], int]:
    """The number of tokens of a string by the library for the file, no special tokens added."""
    if kind == "tokenizers":
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return lambda s: len(tokenizer.encode(s, add_special_tokens=False).ids)
    raise ValueError(f"no two-tier lookup for {kind}")


class Lengths(dict):
    """Token counts by pre-token; what is missing is encoded, and kept while the cache has room."""

    def __init__(self, frequent: dict[bytes, int], encode: Callable[[str], int], room: int) -> None:
        super().__init__(frequent)
        self.frequent, self.encode, self.most = frequent, encode, len(frequent) + room

    def __missing__(self, word: bytes) -> int:
        n = self.encode(word.decode("utf-8", "replace"))
        if len(word) <= CACHED_BYTES:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


def special_strings(data: str) -> re.Pattern[bytes]:
    contents = [re.escape(t["content"].encode()) for t in json.loads(data).get("added_tokens", [])]
    return re.compile(b"|".join(contents) or rb"(?!)")


def frequent_lengths(docs: DataFrame, data: str, kind: str, warm_docs: int, table_size: int) -> dict[bytes, int]:
    """The broadcast tier: at most ``table_size`` pre-tokens, the commonest of about ``warm_docs`` documents from all over the table.

    The sample is cut and counted on the executors, and only the table comes to the driver. Both bounds
    are fixed, so the table does not grow with the input. Which words it holds only decides how often
    a worker must encode; it cannot change a count.
    """
    total = docs.count()
    sample = docs.select("body").sample(min(1.0, warm_docs / max(1, total)), 17)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Cutter(data), Counter()
        for batch in batches:
            for body in batch.column(0):
                seen.update(w for w in cut(body.as_py()) if len(w) <= CACHED_BYTES)
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    found = sample.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    encode = load_encoder(data, kind)
    words = [bytes(r.word) for r in found.orderBy(F.desc("n"), "word").limit(table_size).collect()]
    return {w: encode(w.decode("utf-8", "replace")) for w in words}


def token_counts(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    warm_docs: int = 2048,
    table_size: int = 32_768,
    cache_size: int = 1_000_000,
) -> DataFrame:
    """One row per input row: the id, ``n_bytes``, ``n_tokens`` and ``over_limit``.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and null ids pass through as they
    are. An empty table gives an empty result. Texts of any length are counted whole; strings of
    special tokens inside a text are taken as the library takes them by default. A file with steps that
    can't be cut at pre-tokens raises ValueError. Only the id and the text column are read, so other
    columns can have any name.
    """
    spark = df.sparkSession
    docs = id_and_bytes(df, id_col, text_col)
    kind = "tokenizers"
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    Cutter(data)  # raises for a file it can't cut
    small_batches(spark)
    shared = spark.sparkContext.broadcast((data, frequent_lengths(docs, data, kind, warm_docs, table_size)))
    key = uuid.uuid4().int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, frequent = shared.value
        if key not in _CACHES:
            _CACHES.clear()
            _CACHES[key] = Lengths(frequent, load_encoder(text, kind), cache_size), Cutter(text)
        lengths, cut = _CACHES[key]
        for batch in batches:
            bodies = batch.column(1)
            sizes, counts = [], []
            for body in bodies:
                raw = body.as_py()
                sizes.append(len(raw))
                counts.append(sum(map(lengths.__getitem__, cut(raw))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind_of_id = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {kind_of_id}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > F.lit(limit)).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
