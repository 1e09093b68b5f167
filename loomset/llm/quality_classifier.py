"""Quality classifier by hierarchical empirical Bayes.

A document classifier (two logistic heads: good quality, toxic) gives each document's evidence. Its
model is fitted on at most ``sample_rows`` labelled documents; everything after it covers all data.
The sums of the documents' probabilities by path, then host, then overall are a hierarchy of priors:
a host's posterior shrinks towards the overall mean, a path's towards its host's, the more the fewer
documents it has, with strengths estimated from the spread of the groups. A document's logit is moved
by the log odds of its path against the overall mean; its own part is left out of its site's sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import materialize, small_batches, table, text_bytes

HEADS = ("quality", "toxic")
_PUNCT = bytes.maketrans(b".,;:!?\"'()[]{}*#$%&|<>_-", b" " * 24)
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def tokens(body: bytes) -> list[bytes]:
    return body.lower().translate(_PUNCT).split()


def shape(body: bytes, words: list[bytes], found: set[bytes]) -> list[float]:
    """Features of form: lengths, shares of characters, repetition."""
    n, raw = max(1, len(body)), body.split()
    share = lambda members: (len(body) - len(body.translate(None, members))) / n
    lines = [x for x in body.split(b"\n") if x.strip()]
    kept = max(1, len(words))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / kept
    return [
        math.log1p(len(raw)), math.log1p(n / max(1, len(raw))), share(b"#*$%&<>"), share(b"|"), share(b"0123456789"), share(_LETTERS), share(bytes(range(128, 256))),
        share(bytes(range(65, 91))), len(found) / kept, len(found) / kept**0.8, same, 1 - len(set(lines)) / max(1, len(lines)), float(len(raw) < 20),
    ]


@dataclass
class Model:
    """Word weights and logistic weights of each head; without labels a head is its prior only."""

    lexicon: dict[bytes, tuple[float, float]] = field(default_factory=dict)
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def row(self, body: bytes) -> list[float]:
        words = tokens(body)
        found = set(words)
        hits = [self.lexicon[w] for w in found & self.lexicon.keys()]
        llr = [max(-12.0, min(12.0, sum(h[k] for h in hits))) for k in range(2)]
        return [*shape(body, words, found), *llr]

    def logits(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.tile([4.0, -4.0], (len(rows), 1))
        x = np.column_stack([np.ones(len(rows)), np.clip((rows - self.center) / self.scale, -8, 8)])
        return np.clip(np.column_stack([x @ self.weights[h] for h in HEADS]), -15, 15)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Newton's method with a ridge; the first column is the intercept."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 8000, lexicon_size: int = 2000) -> Model:
    """Fits on ``sample_rows`` labelled documents, the first by a hash of the id.

    Labels that are null, or whose document is missing, are left out; of repeated labels the largest
    counts, and of documents with one id the least text. Word counts are aggregated on the executors; the driver gets ``lexicon_size`` words at
    most for each head and one short row of features for each sampled document.
    """
    small_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "quality-sample-ids")
    # The sample has sample_rows ids at most: small enough to broadcast, whatever the input.
    picked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_bytes(text_col).alias("body")).join(F.broadcast(known), "doc_id")
    picked = materialize(picked.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in ("body", "quality", "toxic"))), "quality-sample")
    total = picked.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).first()
    if total.n < 20:
        return Model()

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, q, t) for b, q, t in zip(pdf.body, pdf.quality, pdf.toxic, strict=True) for w in set(tokens(bytes(b))) if len(w) <= 40]
            yield pd.DataFrame(rows, columns=["word", "quality", "toxic"]).astype({"quality": "int64", "toxic": "int64"})

    counts = picked.select("body", "quality", "toxic").mapInPandas(spread, "word binary, quality long, toxic long")
    counts = counts.groupBy("word").agg(F.count(F.lit(1)).alias("df"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")).where("df >= 5")
    lexicon: dict[bytes, list[float]] = {}
    for k, head in enumerate(HEADS):
        pos, n = float(total[head]), float(total.n)
        if not 0 < pos < n:
            continue
        # Pearson's chi-square of the 2 x 2 table of word and label; the limit leaves words that chance can't explain.
        a, df = F.col(head), F.col("df")
        chi = n * F.pow(a * (n - pos) - (df - a) * pos, 2) / (pos * (n - pos) * df * (n - df + 1e-9))
        for r in counts.where(chi > 28).orderBy(chi.desc(), "word").limit(lexicon_size).collect():
            llr = math.log((r[head] + 0.5) / (pos + 1)) - math.log((r.df - r[head] + 0.5) / (n - pos + 1))
            lexicon.setdefault(bytes(r.word), [0.0, 0.0])[k] = llr
    model = Model({w: (v[0], v[1]) for w, v in lexicon.items()})

    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf.doc_id, "quality": pdf.quality.astype("int64"), "toxic": pdf.toxic.astype("int64"), "x": [model.row(bytes(b)) for b in pdf.body]})

    kind = picked.schema["doc_id"].dataType.simpleString()
    got = picked.select("doc_id", "body", "quality", "toxic").mapInPandas(rows_of, f"doc_id {kind}, quality long, toxic long, x array<double>").toPandas().sort_values("doc_id")
    x = np.array(got.x.tolist())
    model.center, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    design = np.column_stack([np.ones(len(x)), np.clip((x - model.center) / model.scale, -8, 8)])
    model.weights = {h: fit_logistic(design, got[h].to_numpy(float)) for h in HEADS}
    return model


def scores(model: Model, body: Column) -> Column:
    """The heads' logits for a text as bytes: struct<quality: double, toxic: double>."""

    @F.pandas_udf("quality double, toxic double")
    def score(bodies: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in bodies:
            rows = np.array([model.row(bytes(b)) for b in part]) if len(part) else np.empty((0, 15))
            yield pd.DataFrame(model.logits(rows), columns=list(HEADS)) if len(part) else pd.DataFrame({h: pd.Series(dtype=float) for h in HEADS})

    return score(body)


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def site_posteriors(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, dict[str, float]]:
    """(host, path, n, and by head the path's sum, its host's posterior, the strengths) and the overall means.

    Only sums of the whole table come to the driver.
    """
    p = lambda h: 1 / (1 + F.exp(-F.col(f"logit_{h}")))
    paths = scored.groupBy(F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count(F.lit(1)).alias("n"), *(F.sum(p(h)).alias(f"sum_{h}") for h in HEADS))
    paths = materialize(paths, "quality-paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(f"sum_{h}").alias(f"host_{h}") for h in HEADS)), "quality-hosts")
    overall = hosts.agg(F.sum("host_n").alias("n"), *(F.sum(f"host_{h}").alias(h) for h in HEADS)).first()
    fixed: dict[str, float] = {}
    n = float(overall.n or 0)
    for h in HEADS:
        fixed[f"mean_{h}"] = min(1 - 1e-4, max(1e-4, (overall[h] or 0.0) / n)) if n else 0.5
    both = paths.join(hosts.withColumnRenamed("host", "its_host"), F.col("host").eqNullSafe(F.col("its_host")))
    for level, group, size, mean in (("host", hosts, "host_n", None), ("path", both, "n", "host")):
        # Moments: the spread of the groups' means beyond what their sizes explain gives the prior's strength.
        cells = []
        for h in HEADS:
            m = F.lit(fixed[f"mean_{h}"]) if mean is None else F.col(f"host_{h}") / F.col("host_n")
            rate = F.col(f"host_{h}" if mean is None else f"sum_{h}") / F.col(size)
            cells += [F.sum(F.col(size) * F.pow(rate - m, 2)).alias(f"ss_{h}"), F.sum(m * (1 - m)).alias(f"noise_{h}"), F.sum(F.col(size) * m * (1 - m)).alias(f"weight_{h}")]
        got = group.agg(*cells).first()
        for h in HEADS:
            ss, noise, weight = (got[f"{k}_{h}"] or 0.0 for k in ("ss", "noise", "weight"))
            spread = max(0.0, ss - noise) / weight if weight else 0.0
            fixed[f"{level}_strength_{h}"] = min(1e6, max(1.0, 1 / spread - 1 if spread > 1e-6 else 1e6))
    return both.drop("its_host"), fixed


def classify(
    df: DataFrame,
    model: Model,
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    quality_limit: float = 0.5,
    toxic_limit: float = 0.5,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``df``, or its columns ``keep``, with one more column, ``verdict``: struct of ``quality``, ``toxic``, ``host_quality``, ``path_quality`` and ``kept``.

    ``host`` and ``path`` are columns of strings, by default the source, and source and language. A
    null site is a site of its own. A null or empty text is judged by its features of form like any
    other. Repeated rows count each; an empty table gives an empty result; columns of ``df`` pass
    through untouched, whatever their names; one named ``verdict`` raises ValueError.
    """
    if "verdict" in (keep or df.columns):
        raise ValueError("the input has a column verdict of its own")
    small_batches(df.sparkSession)
    host = F.col("source").cast("string") if host is None else host
    path = F.concat_ws("/", F.col("source"), F.col("lang")) if path is None else path
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in keep or df.columns)).alias("row"), host.alias("host"), path.alias("path"), scores(model, text_bytes(text_col)).alias("s"))
    own = materialize(own.select("row", "host", "path", F.col("s.quality").alias("logit_quality"), F.col("s.toxic").alias("logit_toxic")), "quality-scored")
    sites, fixed = site_posteriors(own.drop("row"), "host", "path")
    sites = sites.select(F.col("host").alias("at_host"), F.col("path").alias("at_path"), *[c for c in sites.columns if c not in ("host", "path")])
    joined = own.join(sites, F.col("host").eqNullSafe(F.col("at_host")) & F.col("path").eqNullSafe(F.col("at_path")), "left")
    out = {}
    for h in HEADS:
        p = 1 / (1 + F.exp(-F.col(f"logit_{h}")))
        mean, ks, kp = fixed[f"mean_{h}"], fixed[f"host_strength_{h}"], fixed[f"path_strength_{h}"]
        at_host = (F.col(f"host_{h}") - p + ks * mean) / (F.col("host_n") - 1 + ks)
        at_path = (F.col(f"sum_{h}") - p + kp * at_host) / (F.col("n") - 1 + kp)
        bound = lambda c: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c))
        moved = F.col(f"logit_{h}") + _logit(bound(at_path)) - math.log(mean / (1 - mean))
        out[h], out[f"host_{h}"], out[f"path_{h}"] = 1 / (1 + F.exp(-moved)), at_host, at_path
    verdict = F.struct(
        F.round(out["quality"], 6).alias("quality"), F.round(out["toxic"], 6).alias("toxic"), F.round(out["host_quality"], 6).alias("host_quality"), F.round(out["path_quality"], 6).alias("path_quality"),
        ((out["quality"] >= quality_limit) & (out["toxic"] < toxic_limit)).alias("kept"),
    )
    return joined.select("row.*", verdict.alias("verdict"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return classify(docs, model, keep=("doc_id",)).select("doc_id", "verdict.*")
