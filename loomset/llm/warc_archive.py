"""A content-addressed WARC archive.

Each page becomes a WARC record. The exact header bytes of every record (WARC and HTTP headers) are
kept in a table of their own; payload bytes are stored once for each SHA-256 digest, from the record
that is the response for it. Reading joins the two and rebuilds the record: header, payload, and the
empty lines that end it; the digests of the bytes read back are then verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, materialize, small_batches, table

CRLF = b"\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(RECORDS, f'page:{page_id}')}>"


def header_bytes(page_id, url: str | None, sha1: str, n: int, refers_to: int | None, date: str = DATE) -> bytes:
    """The WARC header, an empty line and the HTTP header of a record; a revisit has the header block only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(http) + (n if refers_to is None else 0)}")
    return "\r\n".join(lines).encode() + CRLF * 2 + http


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP header block and payload of one WARC record; raises if the lengths don't fit."""
    head, found, rest = raw.partition(CRLF * 2)
    lines = head.decode("utf-8").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF * 2:
        raise ValueError("the record doesn't end where its length says")
    http, _, payload = rest[:n].partition(CRLF * 2)
    return fields, http, payload


def write_archive(df: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, DataFrame]:
    """Writes the archive's two tables and returns them: ``headers`` (a row per input row) and ``payloads`` (a row per digest).

    A null body is an empty payload, a null url leaves the target out. Among records with equal
    payloads of at least ``min_bytes``, the one with the largest id is the response and the others
    revisit it; smaller payloads are all responses, and still stored once. Rows with the same id and
    payload are all responses with one stored payload; a null id sorts below all others. An empty
    table gives empty tables. Only the three named columns are read.
    """
    spark = df.sparkSession
    pages = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # One pass hashes the payloads; all that follows reads its table.
    staged = pages.select("page_id", "url", "payload", F.unhex(F.sha2("payload", 256)).alias("sha256"), F.sha1("payload").alias("sha1_hex"), F.length("payload").cast("long").alias("n"))
    staged = materialize(staged, "warc-staged")
    digests = staged.drop("payload")
    firsts = digests.groupBy("sha256").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("copies"))
    # Digests that occur once need no word from the others: only the repeated ones are joined back.
    repeated = materialize(firsts.where("copies > 1").drop("copies"), "warc-repeated")
    named = digests.join(repeated, "sha256", "left")
    response = F.coalesce("response_id", "page_id")
    named = named.select("page_id", "url", "sha256", "sha1_hex", "n", F.when((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(response), response).alias("refers_to"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True)
            made = [header_bytes(p, u, base64.b32encode(bytes.fromhex(s)).decode(), n, r) for p, u, s, n, r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), batch.column(2), pa.array(made, pa.binary())], ["page_id", "refers_to", "sha256", "header"])

    small_batches(spark)
    headers = materialize(named.mapInArrow(head, f"page_id {kind}, refers_to {kind}, sha256 binary, header binary"), "warc-headers")
    # The scan leaves out what another record stores. The table of repeats is read with a known size:
    # the planner broadcasts it only when it is small, and sorts and merges otherwise.
    once = staged.select("page_id", "sha256", "payload").join(repeated.select("sha256", F.col("response_id").alias("keeper"), F.lit(True).alias("again")), "sha256", "left")
    once = once.where(F.col("again").isNull() | F.col("page_id").eqNullSafe(F.col("keeper")))
    alone = once.where(F.col("again").isNull()).select("sha256", "payload")
    shared = once.where(F.col("again")).select("sha256", "payload").dropDuplicates(["sha256"])  # the same id may come twice
    payloads = materialize(alone.unionByName(shared), "warc-payloads")
    discard(staged, repeated)
    return headers, payloads


def read_records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Original records rebuilt by a join: ``page_id``, ``refers_to``, ``record`` and the ``payload`` it stands for.

    A revisit's record is its header block; its payload is that of the record it refers to.
    """
    joined = headers.join(payloads, "sha256")
    ending = F.lit(bytearray(CRLF * 2))
    body = F.when(F.col("refers_to").isNull(), F.concat("header", "payload", ending)).otherwise(F.concat("header", ending))
    return joined.select("page_id", "refers_to", "sha256", body.alias("record"), "payload")


def verify_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """Reads an archive back: each stored payload against its strong digest, once, and each record rebuilt and parsed.

    Gives ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``target_uri``;
    a mismatch raises. A revisit meets only the digests of its payload, not the payload, however many
    revisits there are. An empty archive gives an empty result.
    """
    kind = headers.schema["page_id"].dataType.simpleString()
    sound = F.when(F.unhex(F.sha2("payload", 256)) == F.col("sha256"), F.sha1("payload")).otherwise(F.raise_error(F.concat(F.lit("a stored payload doesn't match its digest "), F.hex("sha256"))))
    told = materialize(payloads.select("sha256", F.length("payload").cast("long").alias("n"), sound.alias("sha1_hex")), "warc-told")
    known = headers.join(told, "sha256")
    ending = F.lit(bytearray(CRLF * 2))
    whole = known.where("refers_to IS NULL").join(payloads, "sha256").select("page_id", "refers_to", "n", "sha1_hex", F.concat("header", "payload", ending).alias("record"))
    again = known.where("refers_to IS NOT NULL").select("page_id", "refers_to", "n", "sha1_hex", F.concat("header", ending).alias("record"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(3)]
            for target, n, strong, record in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                fields, _, payload = parse_record(record.as_py())
                sha1 = base64.b32encode(bytes.fromhex(strong)).decode()
                revisit = target is not None
                right = fields["WARC-Type"] == ("revisit" if revisit else "response") and fields["WARC-Payload-Digest"] == f"sha1:{sha1}"
                right = right and (fields["WARC-Refers-To"] == record_id(target) and not payload if revisit else len(payload) == n and base32_sha1(payload) == sha1)
                if not right:
                    raise ValueError(f"record {fields['WARC-Record-ID']} doesn't match its digest")
                for column, value in zip(out, (sha1, fields["WARC-Type"], fields.get("WARC-Target-URI")), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.string()) for x in out[:2]), batch.column(1), pa.array(out[2], pa.string())], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])

    small_batches(headers.sparkSession)
    return whole.unionByName(again).mapInArrow(check, f"page_id {kind}, payload_bytes long, payload_digest string, record_type string, refers_to {kind}, target_uri string")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers, payloads = write_archive(table(spark, sf_dir, "pages"))
    return verify_archive(headers, payloads).drop("target_uri")
