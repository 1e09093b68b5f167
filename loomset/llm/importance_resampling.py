"""Resampling by importance: documents are drawn by how much their features are those of a target.

Features are runs of 1 to ``ngram`` words, hashed to buckets. A bucket's gain is the logarithm of its
share in the target over its share in all documents; a document's weight is the mean gain of its
features, and Gumbel noise from a seeded hash of its id turns the highest sums into a weighted draw
without replacement.

Long texts are skewed work, so they are cut into overlapping chunks: between two words, each chunk
followed by the ``ngram - 1`` words after it. A chunk owns the features that start in it, and the words
carried over only complete those; so each feature is counted once, wherever the cuts fall. Chunks of
long texts are dealt over all tasks, other texts stay where they are read. Counts and gains are summed
by document. Texts are read once: what is kept of a chunk is its buckets and their counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, materialize, numbered, small_batches, table, text_bytes

#: Bytes of a chunk's own words: longer texts are cut.
CHUNK_BYTES = 1 << 16
#: Each byte as it counts: A-Z lower-cased, digits, letters and all of other alphabets as they are, the rest as a space.
AS_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SPACED = re.compile(rb"[^ ]+")


def chunks(body: bytes, ngram: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """A text's own words by chunks, each with the words carried over from what follows."""
    text, at = body.translate(AS_WORDS), 0
    while at < len(text):
        cut = text.find(b" ", at + size)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut], b" ".join(m.group() for m in islice(SPACED.finditer(text, cut), ngram - 1))
        at = cut


HISTOGRAM = "row long, id {id}, n_words long, n_features long, buckets array<int>, counts array<int>"


def histogram(own: bytes, carry: bytes, ngram: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words, features, buckets and their counts of what a chunk owns."""
    words = own.split()
    n, ahead = len(words), words + carry.split()
    hashes = [crc32(w) for w in words]
    for k in range(2, ngram + 1):
        hashes += [crc32(b" ".join(ahead[i : i + k])) for i in range(min(n, len(ahead) - k + 1))]
    at, counts = np.unique(np.array(hashes, np.uint32) % np.uint32(buckets), return_counts=True)
    return n, len(hashes), at.astype(np.int32), counts.astype(np.int32)


def lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def histograms(df: DataFrame, id_col: str, text_col: str, ngram: int, buckets: int, chunk_bytes: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Tables (row, id, n_words, n_features, buckets, counts): a row for each shorter text, and one for each chunk of longer ones."""
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), text_bytes(text_col).alias("body"), F.lit(b"").alias("carry"), F.lit(0).alias("chunk"))
    schema = HISTOGRAM.format(id=rows.schema["id"].dataType.simpleString())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                for number, (own, carry) in enumerate(chunks(body.as_py(), ngram, chunk_bytes)):
                    yield pa.RecordBatch.from_arrays([batch.column("row")[i : i + 1], batch.column("id")[i : i + 1], pa.array([own], pa.binary()), pa.array([carry], pa.binary()), pa.array([number], pa.int32())], ["row", "id", "body", "carry", "chunk"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [histogram(b.as_py().translate(AS_WORDS), c.as_py(), ngram, buckets) for b, c in zip(batch.column("body"), batch.column("carry"), strict=True)]
            words, features, at, counts = zip(*found, strict=True) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(words, pa.int64()), pa.array(features, pa.int64()), lists(at), lists(counts)], ["row", "id", "n_words", "n_features", "buckets", "counts"])

    small_batches(df.sparkSession)
    size = F.octet_length("body")
    pieces = rows.where(size > chunk_bytes).mapInArrow(cut, rows.schema).repartition("row", "chunk")
    return materialize(rows.where(size <= chunk_bytes).mapInArrow(count, schema), f"{name}-texts"), materialize(pieces.mapInArrow(count, schema), f"{name}-chunks")


def bucket_sums(*tables: DataFrame) -> DataFrame:
    """(bucket, n): features of all rows by bucket, summed in each task before the shuffle."""
    pairs = reduce(DataFrame.unionByName, tables).select(F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
    return pairs.groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket, in thousandths; what comes to the driver has a row for each bucket at most."""
    found = np.zeros((2, buckets))
    for side, rows in zip(found, (source, target), strict=True):
        for r in rows.collect():
            side[r.bucket] = r.n
    (s, t), (all_s, all_t) = found, found.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def summed_gains(hist: DataFrame, gains: np.ndarray) -> DataFrame:
    """(row, id, n_words, n_features, gain): each row's features weighed by their buckets' gains."""
    shared = hist.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, counts = batch.column("buckets"), batch.column("counts")
            each = shared.value[at.flatten().to_numpy()] * counts.flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(at.value_lengths().to_numpy())])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "n_words", "n_features")), pa.array(np.diff(ends), pa.int64())], ["row", "id", "n_words", "n_features", "gain"])

    return hist.mapInArrow(weigh, f"row long, id {hist.schema['id'].dataType.simpleString()}, n_words long, n_features long, gain long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Standard Gumbel noise from the id alone: reruns agree."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return -F.log(-F.log((h + 0.5) / 4294967296.0))


def importance_resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", ngram: int = 1, buckets: int = 10000, percent: int = 10, least_words: int = 20, seed: int = 2024, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: the id, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    ``weight`` (thousandths) is the floored mean of the gains of a text's features, 0 without features;
    ``score`` adds the id's Gumbel noise. Of the rows with ``least_words`` words, the ``percent`` with the
    highest scores have a rank from 1 on (ties: the lesser id, null ids last, then the lesser weight;
    further ties in any order), all others none. A null or empty text has no features; a null id hashes like an
    empty one, repeated rows are rows of their own. An empty target only makes rare buckets
    gain; an empty table gives an empty result. Only the named columns are read.
    """
    short, long_ = histograms(df, id_col, text_col, ngram, buckets, chunk_bytes, "resample")
    wanted = histograms(target.select(F.lit(0).alias("id"), F.col(f"`{target_col}`").alias("text")), "id", "text", ngram, buckets, chunk_bytes, "target")
    gains = bucket_gains(bucket_sums(short, long_), bucket_sums(*wanted), buckets)
    whole = summed_gains(long_, gains).groupBy("row").agg(F.first("id").alias("id"), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
    rows = summed_gains(short, gains).withColumn("cut", F.lit(False)).unionByName(whole.withColumn("cut", F.lit(True)))
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0).cast("long")
    scored = rows.withColumn("weight", weight).withColumn("score", (F.col("weight") + F.floor(1000 * gumbel(F.col("id"), seed))).cast("long")).drop("gain")
    scored = materialize(scored, "resample-scored")
    discard(short, long_, *wanted)
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("cut"), F.col("row")]
    ranked = numbered(scored.where(enough), order, "resample-ranked")
    rank = F.when(F.col("number") < drawn, F.col("number") + 1).cast("long")
    out = ranked.withColumn("rank", rank).drop("number").unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sql() -> str:
    return r"""
    WITH bits AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) x(i))),
    words AS (
        SELECT doc_id, true AS own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
        UNION ALL SELECT NULL, false, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
    hexed AS (SELECT word, hex(encode(word)) AS x FROM words GROUP BY word),
    hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, bits),
    counted AS (SELECT w.own, w.doc_id, h.bucket, count(*) AS n FROM words w JOIN hashed h ON w.word = h.word GROUP BY ALL),
    sums AS (SELECT b.bucket, coalesce(sum(c.n) FILTER (WHERE c.own), 0)::BIGINT AS s, coalesce(sum(c.n) FILTER (WHERE NOT c.own), 0)::BIGINT AS t FROM range(10000) b(bucket) LEFT JOIN counted c ON b.bucket = c.bucket GROUP BY b.bucket),
    gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums),
    weighed AS (SELECT c.doc_id, sum(c.n)::BIGINT AS n, sum(c.n * g.gain)::BIGINT AS gain FROM counted c JOIN gains g ON c.bucket = g.bucket WHERE c.own GROUP BY c.doc_id),
    scored AS (SELECT d.doc_id, coalesce(w.n, 0) AS n_features, coalesce((w.gain - ((w.gain % w.n) + w.n) % w.n) // w.n, 0) AS weight, ('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id),
    summed AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM scored),
    ranked AS (SELECT *, n_features >= 20 AS enough, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM summed)
    SELECT doc_id, n_features, weight, score, CASE WHEN enough AND place <= (SELECT count(*) * 10 // 100 FROM ranked WHERE enough) THEN place END AS rank FROM ranked"""
