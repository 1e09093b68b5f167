"""A corpus from documents: classified, near duplicates dropped, repeats cut, sources mixed, encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import WORD, discard, materialize, table
from loomset.llm.jaccard_join import jaccard_classes
from loomset.llm.mixing import mix_sources
from loomset.llm.quality_classifier import classify, fit
from loomset.llm.sentencepiece_codec import sentencepiece_encode
from loomset.llm.suffix_dedup import repeated_windows, text_id
from loomset.store import spent_after

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; its labels are the table ``labels``.

    Each row is judged by itself: rows with one id may differ in their fate, equal rows of one site don't.
    A score at the limit of quality is kept, one at the limit of toxicity isn't. Nulls are judged like empty texts.
    """
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs.select(*COLUMNS), model).where("verdict.kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near duplicates, one row of it; rows without an id come last.

    A row is told from its copies by a number of its own, written once so that all readers see the same.
    """
    tie = F.xxhash64("text", "lang", "source")
    keyed = materialize(docs.select(*COLUMNS, tie.alias("tie"), F.monotonically_increasing_id().alias("row_key")), "near-keyed")
    classes = jaccard_classes(keyed, "row_key")
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie", "row_key"))["row_key"]
    ids = keyed.select("row_key", "doc_id", "tie").join(classes.select("row_key", "class_id").hint("merge"), "row_key")
    kept = materialize(ids.groupBy("class_id").agg(least.alias("row_key")).select("row_key"), "near-kept")
    return keyed.join(kept.hint("merge"), "row_key", "left_semi").select(*COLUMNS)


def repeats_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that occur again are cut from every text; documents stay, if emptied too."""
    docs = docs.select(*COLUMNS)
    changed = repeated_windows(docs, "text", unit="words", threshold=50).select("tid", F.col("kept").cast("string").alias("kept"))
    changed = materialize(changed, "repeats-kept")
    out = docs.withColumn("tid", text_id("text")).join(changed.hint("merge"), "tid", "left")
    text = F.coalesce("kept", "text")
    return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time in part where it takes a part.

    A row is told from its copies by a number of its own, written once so that all readers see the same.
    """
    rows = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "mix-rows")
    taken = mix_sources(rows, carry="row_key").where("taken > 0").select("row_key", "size", "taken")
    rows = rows.join(materialize(taken, "mix-taken").hint("merge"), "row_key")
    rows = rows.withColumn("time", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("time") - 1) * F.col("size")
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, left.cast("int")), " ")
    rows = rows.withColumn("text", F.when(left >= F.col("size"), F.col("text")).otherwise(part))
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, with parity and round trip: a row for each row, whether ids are null, repeat or not; a null text has no pieces."""
    import public_tokenizers

    out = sentencepiece_encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "same_ids", "round_trip")


STAGES = [
    ("quality classifier", classified),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats_cut),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", encoded),
]

#: A fitted classifier, a randomised join and a tokenizer: not for SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with spent_after() as kept:
            done = materialize(stage(spark, docs, sf_dir), f"stage-{i + 1}")
            kept.append(done)
        if i:
            discard(docs)  # the stage before
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
