"""N-gram Jaccard join by chosen paths.

Documents are sets of word shingles; equal sets are one set with copies. A set is embedded as a
sketch of minhash tokens, on which two sets agree as often as they are similar. A run starts with all
sets, chooses tokens at random and sends each set to the node of its value there; nodes that are
still large are split again on tokens chosen for the node, so a pair is kept along a path of shared
tokens. Small nodes, and nodes whose sets mostly agree and so can't be split, are compared by brute
force, in blocks. Runs are repeated until a pair at the threshold is found with the target recall.

Brute force compares the sketches first, and shingles only of sets that come near another. A pair is
counted in the first leaf that it shares only. Pairs never leave the task that finds them: a task gives
counts of links and a forest of edges, and the classes are the components of these edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm.common import discard, materialize, small_batches, table, text_bytes
from loomset.llm.graph import components

#: Tokens chosen at each node: 1 / threshold, rounded up.
CHOSEN = 2
#: Tokens of a sketch at least; lower thresholds take longer ones.
SKETCH = 64
LEAF, DEPTH = 64, 3
#: A node whose largest child has this share of it isn't split further.
DENSE = 0.5
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
_M = np.uint64(0x9E3779B97F4A7C15)


def shingles(body: bytes, width: int) -> np.ndarray:
    """The sorted hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    from xxhash import xxh3_64_intdigest as h

    words = body.split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([h(b" ".join(words), 1)], np.uint64)
    w = np.fromiter((h(x) for x in words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = (out ^ w[i : i + n]) * _M
        out ^= out >> np.uint64(31)
    return np.unique(out)


def sketch(values: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Minhash tokens as 32-bit values."""
    odd = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(values), 2048):
        mixed = (values[lo : lo + 2048, None] ^ (odd >> np.uint64(7))) * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd
        least = np.minimum(least, mixed.min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def describe(docs: DataFrame, width: int, length: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes, sketches = [], [], []
            for body in batch.column(2):
                values = shingles(body.as_py(), width)
                sids.append(blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None)
                sizes.append(len(values))
                sketches.append(sketch(values, length))
            flat = np.concatenate(sketches) if sketches else np.empty(0, np.int32)
            offsets = np.arange(len(sketches) + 1, dtype=np.int32) * length
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.binary()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "tid", "sid", "n", "sketch"])

    return docs.mapInArrow(run, f"id {kind}, tid binary, sid binary, n long, sketch array<int>")


def shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(b.as_py(), width).tobytes() for b in batch.column(1)], pa.binary())], ["sid", "shingles"])

    return texts.mapInArrow(run, "sid binary, shingles binary")


def n_runs(threshold: float, recall: float) -> int:
    """Runs until a pair at the threshold is missed with 1 - recall at most, when its path has full depth."""
    found = (1 - (1 - threshold) ** CHOSEN) ** DEPTH
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - found)))


def sketch_length(threshold: float, recall: float) -> int:
    """Tokens of a sketch: half of them or fewer are the trees' roots, the others are for the nodes below."""
    return max(SKETCH, 2 * CHOSEN * n_runs(threshold, recall))


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over slabs of the values that several sets hold."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return np.zeros((len(sets), len(sets)), np.float32)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    new = np.cumsum(times > 1) - 1
    owner, column = owner[keep], new[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    wide = 2048
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [lo, lo + wide])
        slab = np.zeros((len(sets), wide), np.float32)
        slab[owner[a:b], column[a:b] - lo] = 1
        out += slab @ slab.T
    return out


def links(members: list[tuple], leaf: int, cross: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of a block that share no earlier leaf, as a matrix, and each member's least linked member."""
    sets = [np.frombuffer(m[2], np.uint64) for m in members]
    earlier = [[x for x in m[1] if x < leaf] for m in members]
    if len(members) == 2:
        a, b = sets
        common = len(np.intersect1d(a, b, assume_unique=True)) if min(len(a), len(b)) >= threshold * max(len(a), len(b)) else 0
        linked = common >= threshold * (len(a) + len(b) - common) - 1e-9 and not set(earlier[0]) & set(earlier[1])
        adjacent = np.array([[False, linked], [linked, False]])
    else:
        sizes = np.array([len(s) for s in sets], np.float64)
        common = intersections(sets)
        adjacent = common >= threshold * (sizes[:, None] + sizes - common) - 1e-9
        if any(earlier):
            adjacent &= intersections([np.array(x, np.int64) for x in earlier]) == 0
        np.fill_diagonal(adjacent, False)
    if cross:
        side = np.array([m[0] for m in members])
        adjacent &= side[:, None] != side
    label = np.arange(len(members))
    while True:
        least = np.minimum(label, np.where(adjacent, label, len(members)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return adjacent, label
        label = least


def compare(blocks: DataFrame, threshold: float) -> DataFrame:
    """Brute force within each block; rows come sorted by block."""

    def told(key: tuple, members: list[tuple]) -> Iterator[tuple]:
        leaf, i, j = key
        adjacent, label = links(members, leaf, i != j, threshold)
        degree = adjacent @ np.array([m[4] for m in members], np.int64)
        for k in np.flatnonzero(degree):
            yield members[k][3], int(degree[k]), members[label[k]][3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[], [], []], (pa.binary(), pa.int64(), pa.binary()), strict=True)], ["sid", "links", "least"])
        for key, members in by_block(batches):
            out.extend(told(key, members))
            if len(out) > 20_000:
                yield pack(out)
                out = []
        yield pack(out)

    return blocks.mapInArrow(run, "sid binary, links long, least binary")


def leaf_members(sets: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(leaf, sid) for all leaves of all runs with two sets or more. A leaf's high byte is its run's tree."""
    trees = n_runs(threshold, recall) * CHOSEN
    low = (1 << 56) - 1
    root = lambda t: F.xxhash64(F.lit(t), F.get("sketch", F.lit(t))).bitwiseAND(F.lit(low)).bitwiseOR(F.lit(t << 56))
    at = sets.select("sid", F.explode(F.array(*map(root, range(trees)))).alias("node"))
    leaves: list[DataFrame] = []
    spent: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        if depth == 1:
            several = at.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
            several = materialize(several, "paths-several")  # a table of its own, so that the join can split a hot node
            at = materialize(at.join(several, "node"), f"paths-{depth}")
            spent += [at, several]
        if depth == DEPTH:
            leaves.append(at.select(F.col("node").alias("leaf"), "sid"))
            break
        leaves.append(at.where(F.col("size") <= LEAF).select(F.col("node").alias("leaf"), "sid"))
        large = at.where(F.col("size") > LEAF)
        if large.isEmpty():
            break
        deeper = sketch_length(threshold, recall) - trees
        pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(deeper)).cast("int") + trees
        child = lambda k: F.xxhash64("node", pick(k), F.get("sketch", pick(k))).bitwiseAND(F.lit(low)).bitwiseOR(F.col("node").bitwiseAND(F.lit(~low)))
        down = large.join(sets.select("sid", "sketch"), "sid").select("sid", "node", "size", F.explode(F.array(*map(child, range(CHOSEN)))).alias("child"))
        down = materialize(down, f"paths-down-{depth}")
        counted = materialize(down.groupBy("node", "size", "child").agg(F.count(F.lit(1)).alias("n")), f"paths-counted-{depth}")
        dense = counted.groupBy("node", "size").agg(F.max("n").alias("most")).where(F.col("most") >= DENSE * F.col("size")).select("node")
        dense = materialize(dense, f"paths-dense-{depth}")
        leaves.append(large.join(dense, "node", "left_semi").select(F.col("node").alias("leaf"), "sid"))
        split = counted.where("n > 1").join(dense, "node", "left_anti").select("child", F.col("n").alias("size"))
        at = materialize(down.select("sid", "child").join(split, "child").select(F.col("child").alias("node"), "sid", "size"), f"paths-{depth + 1}")
        spent += [at, down, counted, dense]
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    out = materialize(out.distinct(), "leaves")
    discard(*spent)
    return out


def in_blocks(members: DataFrame, cells) -> DataFrame:
    """Members by block (leaf, i, j): the leaf's sets are dealt over cells, and a set meets every cell in the block of the two."""
    dealt = members.withColumn("cells", F.greatest(F.lit(1), cells.cast("int"))).withColumn("cell", F.pmod(F.xxhash64("sid", "leaf"), "cells").cast("int"))
    out = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    return out.withColumn("i", F.least("cell", "other")).withColumn("j", F.greatest("cell", "other")).withColumn("side", F.col("cell")).drop("cells", "cell", "other")


def grouped(columns: list[list]) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows as they come, by their first three values."""
    key, members = None, []
    for row in zip(*columns, strict=True):
        if row[:3] != key:
            if members:
                yield key, members
            key, members = row[:3], []
        members.append(row[3:])
    if members:
        yield key, members


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """The blocks of a partition sorted by block, with two members or more."""
    held_key, held = None, []
    for batch in batches:
        for key, members in grouped([c.to_pylist() for c in batch.columns]):
            if key != held_key:
                if len(held) > 1:
                    yield held_key, held
                held_key, held = key, []
            held += members
    if len(held) > 1:
        yield held_key, held


def sketched(blocks: DataFrame, least_share: float) -> DataFrame:
    """The members of each leaf that agree with another on enough tokens, in a pair that shares no earlier leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["leaf", "sid"])
        for (leaf, i, j), members in by_block(batches):
            tokens = np.array([m[2] for m in members], np.int32)
            earlier = [np.array([x for x in m[1] if x < leaf], np.int64) for m in members]
            side = np.array([m[0] for m in members])
            shared = intersections(earlier) > 0 if len(members) > 2 else None
            hit = np.zeros(len(members), bool)
            for lo in range(0, len(members), 64):
                near = (tokens[lo : lo + 64, None, :] == tokens).sum(axis=2) >= least_share * tokens.shape[1]
                near[np.arange(near.shape[0]), np.arange(lo, lo + near.shape[0])] = False
                if shared is not None:
                    near &= ~shared[lo : lo + 64]
                elif set(earlier[0].tolist()) & set(earlier[1].tolist()):
                    near[:] = False
                if i != j:
                    near &= side[lo : lo + 64, None] != side
                hit[lo : lo + 64] |= near.any(axis=1)
            out += [(leaf, members[k][3]) for k in np.flatnonzero(hit)]
            if len(out) > 20_000:
                yield pack(out)
                out = []
        yield pack(out)

    return blocks.mapInArrow(run, "leaf long, sid binary")


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8, recall: float = 0.999999) -> DataFrame:
    """One row per input row: the id, ``class_id`` (the least id of its class), ``n_links`` and ``copies``.

    Shingles are ``width`` consecutive words; a text with fewer is one shingle of all its words. Two
    texts are linked when their sets have a Jaccard similarity of ``threshold`` or more; copies (rows with
    equal sets) are linked. ``n_links`` counts the other rows linked with a row. Null and empty texts have
    no shingles: no links, and a class of their own. Null ids pass through and never name a class unless
    all ids in it are null. An empty table gives an empty result. Only the two named columns are read.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.substring(F.sha2(text_bytes(text_col), 256), 1, 32)).alias("tid"), text_bytes(text_col).alias("body"))
    described = materialize(describe(docs, width, sketch_length(threshold, recall)), "sets-described")
    rows = materialize(described.select("id", "sid"), "sets-rows")
    sets = described.where("sid IS NOT NULL").groupBy("sid").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("tid").alias("tid"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sets = materialize(sets, "sets")
    discard(described)
    members = leaf_members(sets, threshold, recall)
    listed = materialize(members.groupBy("sid").agg(F.array_sort(F.collect_list("leaf")).alias("leaves")), "leaf-lists")
    # Tokens are compared before shingles are fetched. A pair at the threshold agrees on half of the
    # tokens or fewer with a chance of less than 1e-7, far below what the runs miss.
    sizes = materialize(members.groupBy("leaf").agg(F.count(F.lit(1)).alias("size")), "leaf-sizes")
    blocks = in_blocks(members.join(sizes, "leaf"), F.ceil(F.col("size") / BLOCK_SETS))
    packed = sets.select("sid", "sketch").join(listed, "sid")
    blocks = blocks.join(packed, "sid").select("leaf", "i", "j", "side", "leaves", "sketch", "sid")
    chosen = sketched(blocks.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j"), threshold - 0.3)
    chosen = materialize(chosen.distinct().join(sets.select("sid", "n", "copies"), "sid"), "leaf-members")
    discard(members, sizes)
    wanted = materialize(chosen.select("sid").distinct().join(sets.select("sid", "tid"), "sid"), "sets-wanted")
    # Merged at every size: the plan at 100 TB is the one that small inputs test.
    texts = docs.select("tid", "body").join(wanted.hint("merge"), "tid").groupBy("sid").agg(F.first("body").alias("body"))
    values = materialize(shingle_rows(texts, width), "sets-shingles")
    weights = materialize(chosen.groupBy("leaf").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")), "leaf-weights")
    cells = F.greatest(F.ceil(F.col("size") / BLOCK_SETS), F.ceil(F.col("weight") / BLOCK_SHINGLES))
    blocks = in_blocks(chosen.join(weights, "leaf"), cells).select("leaf", "i", "j", "side", "sid", "copies")
    full = blocks.join(listed.hint("merge"), "sid").join(values.hint("merge"), "sid").select("leaf", "i", "j", "side", "leaves", "shingles", "sid", "copies")
    found = compare(full.repartition("leaf", "i", "j").sortWithinPartitions("leaf", "i", "j"), threshold)
    found = materialize(found, "sets-links")
    discard(values, wanted, chosen, weights, listed)
    degree = found.groupBy("sid").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("sid").alias("u"), F.col("least").alias("v")))
    named = sets.select("sid", "least_id", "copies").join(roots.withColumnRenamed("u", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    named = named.join(classes, "root").join(degree, "sid", "left").select("sid", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    named = materialize(named, "sets-named")
    discard(sets, found)
    out = rows.select("id", "sid").join(named, "sid", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("sid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
