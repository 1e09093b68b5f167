import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from loomset.llm import importance_resampling as ir

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, ngram):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORDS.findall(lower)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, ngram + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, ngram=1, buckets=10000, percent=10, least=20):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(d, *features(t, ngram)) for d, t in rows]
    s, t = collections.Counter(at(f) for _, _, fs in found for f in fs), collections.Counter(at(f) for x in target for f in features(x, ngram)[1])
    n_s, n_t, out = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    for d, n, fs in found:
        weight = sum(gain(at(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3]))
    for i, r in enumerate(enough[: len(enough) * percent // 100]):
        r[5] = i + 1
    return collections.Counter(map(tuple, out))


@pytest.mark.parametrize("ngram, chunk, percent", [(1, 64, 10), (3, 20, 55), (2, 1 << 16, 100)])
def test_resampling_against_brute_force(spark, ngram, chunk, percent):
    rnd = random.Random(4)
    word = lambda: rnd.choice(["the", "The", "x9", "ünï", "a_b", "Ж", "\x7f", "q" * rnd.randint(1, 90)]) + rnd.choice([" ", "\n", "--", " " * rnd.randint(1, 99), " "])
    rows = [(i, "".join(word() for _ in range(rnd.choice([0, 5, 19, 20, 40, 200])))) for i in range(60)] + [(None, "same words " * 30), (None, "same words " * 30), (7, "tied id " * 12), (98, None), (99, ""), (100, " \t!? ")]
    target = ["the ünï x9 the", "q", None, "long target text " * 40]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, id string").withColumn("row", F.lit(1)).withColumn("score", F.lit(2))
    got = ir.importance_resample(df, spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram, chunk_bytes=chunk, percent=percent)
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, target, ngram, percent=percent)


def test_chunks_own_each_start_once():
    rnd = random.Random(8)
    for _ in range(300):
        body = bytes(rnd.choice(b"ab  ") for _ in range(rnd.randint(1, 200)))
        for ngram in (1, 2, 4):
            parts = list(ir.chunks(body, ngram, rnd.randint(1, 30)))
            assert b"".join(p for p, _ in parts) == body.translate(ir.AS_WORDS)
            at = 0
            for own, carry in parts:
                at += len(own)
                assert carry.split() == body[at:].split()[: ngram - 1]


def test_empty_tables_and_one_long_text_in_chunks(spark, docs):
    target = spark.createDataFrame([("word7 word8",)], "text string")
    assert ir.importance_resample(docs.limit(0), target).collect() == []
    assert ir.importance_resample(docs, target.limit(0)).count() == docs.count()
    text = "one and the same line of words here\n" * 5000
    short, long_ = ir.histograms(spark.createDataFrame([(1, text)], "doc_id long, text string"), "doc_id", "text", 1, 10000, 1024, "t")
    assert short.count() == 0 and long_.agg(F.sum("n_words")).first()[0] == 40000
    assert long_.count() > 100 and long_.agg(F.max("n_words")).first()[0] < 300
