"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's target is its weighted share of the mix, capped at a multiple of its size. Blocks of
equally many words are then allocated by highest quotients: first to sources by their targets, then
within each source to its shards by their sizes, as integer quotas. A shard's documents, in a seeded
order, form a ring of words, and its quota of consecutive blocks is laid out on the ring from a
seeded start, so that a document takes part at most as often as the cap allows.

Neither a source's shards nor all sources ever meet in one task: targets and quotas are found by rounds
of sums, and the last few seats are dealt in a distributed order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomset.llm.common import WORD, discard, materialize, numbered, table

#: Divisors tried in a round; seats of a group that may be left for the last step; rounds until then at most.
TRIED, LAST_SEATS, ROUNDS = 16, 4096, 12


def apportion(units: DataFrame, seats: DataFrame, name: str) -> DataFrame:
    """``units`` (grp, unit, votes, most) with ``quota``: the seats (grp, seats) of each group by the highest quotients votes / (2 * taken + 1).

    A unit gets ``most`` seats at most, one without votes none; a group whose units can't take all its
    seats fills them; ties go to the least unit. A round tries ``TRIED`` divisors for all groups at once
    by sums, and keeps the two around the right one; the seats between them are dealt in order.
    """
    at = lambda x: F.least(F.col("most"), F.floor(F.col("votes") * x + 0.5).cast("long"))
    units = units.where("votes > 0 AND most > 0")
    # A unit has its k-th seat where votes * x >= k - 1/2: x is half of the divisor's inverse, and seats grow with it.
    # Rounding moves a unit's seats by a half at most, so the right x is near seats / votes, but for units that are full.
    every = units.groupBy("grp").agg(F.sum("votes").alias("all"), F.count(F.lit(1)).alias("n"), F.sum("most").alias("full"), F.max((F.col("most") + 1) / F.col("votes")).alias("last"))
    every = every.join(seats, "grp").withColumn("seats", F.least("seats", "full"))
    every = every.select("grp", "seats", F.greatest(F.lit(0.0), (F.col("seats") - F.col("n") / 2 - 1) / F.col("all")).alias("low"), ((F.col("seats") + F.col("n") / 2 + 1) / F.col("all")).alias("near"), "last", "full")
    sums = units.join(every.select("grp", "low", "near"), "grp").groupBy("grp").agg(F.sum(at(F.col("low"))).alias("at_low"), F.sum(at(F.col("near"))).alias("at_near"))
    enough = F.col("at_near") >= F.col("seats")
    state = every.join(sums, "grp").select("grp", "seats", "low", "at_low", F.when(enough, F.col("near")).otherwise(F.col("last")).alias("high"), F.when(enough, F.col("at_near")).otherwise(F.col("full")).alias("at_high"))
    state = materialize(state, f"{name}-bounds")
    crowded = True
    for _ in range(ROUNDS):
        crowded = (state.agg(F.max(F.col("at_high") - F.col("at_low")).alias("open")).first().open or 0) > LAST_SEATS
        if not crowded:
            break
        tried = lambda i: F.col("low") + (F.col("high") - F.col("low")) * (i / TRIED)
        sums = units.join(state.select("grp", "low", "high"), "grp").groupBy("grp").agg(*(F.sum(at(tried(i))).alias(f"at_{i}") for i in range(1, TRIED)))
        told = state.join(sums, "grp").withColumn("steps", F.array(*(F.struct(x.alias("x"), F.col(n).alias("n")) for x, n in [(F.col("low"), "at_low"), *((tried(i), f"at_{i}") for i in range(1, TRIED)), (F.col("high"), "at_high")])))
        lower, upper = F.element_at(F.filter("steps", lambda s: s["n"] <= F.col("seats")), -1), F.get(F.filter("steps", lambda s: s["n"] >= F.col("seats")), F.lit(0))
        closer = told.select("grp", "seats", lower["x"].alias("low"), lower["n"].alias("at_low"), upper["x"].alias("high"), upper["n"].alias("at_high"))
        closer = materialize(closer, f"{name}-bounds")
        discard(state)
        state = closer
    dealt = units.join(state, "grp").withColumn("sure", at(F.col("low"))).withColumn("may", at(F.col("high")))
    dealt = materialize(dealt.select("grp", "unit", "votes", "sure", "may", (F.col("seats") - F.col("at_low")).alias("left")), f"{name}-sure")
    open_seats = dealt.where("may > sure AND left > 0").select("grp", "unit", "left", "votes", F.explode(F.sequence("sure", F.col("may") - 1)).alias("k"))
    open_seats = open_seats.select("grp", "unit", "left", ((F.col("k") + 0.5) / F.col("votes")).alias("x"))
    spent = [state, dealt]
    if crowded:  # very many units with one and the same x
        ranked = numbered(open_seats, [F.col("grp"), F.col("x"), F.col("unit")], name)
        firsts = ranked.groupBy("grp").agg(F.min("number").alias("first"))
        placed = ranked.join(firsts, "grp").withColumn("place", F.col("number") - F.col("first") + 1)
        spent.append(ranked)
    else:  # a group has LAST_SEATS open seats at most
        placed = open_seats.withColumn("place", F.row_number().over(W.partitionBy("grp").orderBy("x", "unit")))
    won = placed.where("place <= left").groupBy("grp", "unit").agg(F.count(F.lit(1)).alias("won"))
    out = dealt.join(won, ["grp", "unit"], "left").select("grp", "unit", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))
    out = materialize(out, f"{name}-quotas")
    discard(*spent)
    return out


def water_level(sources: DataFrame, total: float) -> float | None:
    """The level at which the sources (weight, room) take ``total`` as least(room, level * weight); None where no level does: all are full.

    The level rises by rounds of sums: what the full ones can't take is shared again among the others.
    """
    level = 0.0
    while True:
        full = F.col("room") <= level * F.col("weight")
        got = sources.agg(F.sum(F.when(full, F.col("room")).otherwise(0.0)).alias("taken"), F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not got.weight:
            return None
        risen = (total - got.taken) / got.weight
        if risen <= level:
            return level
        level = risen


def told_apart(sizes: DataFrame) -> DataFrame:
    """``sizes`` with a ``lot`` of its own for each of the rows that agree in it and in source: their copies' numbers go into it.

    Such rows are alike, so it doesn't matter which of them has which number. They are numbered in ranges,
    and a lot with very many rows takes several of them.
    """
    same = ["lot", "source"]
    again = materialize(sizes.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "mix-copies")
    if again.isEmpty():
        discard(again)
        return sizes
    on = (F.col("lot") == F.col("again_lot")) & F.col("source").eqNullSafe(F.col("again_source"))
    keys = again.select(F.col("lot").alias("again_lot"), F.col("source").alias("again_source"))
    listed = numbered(sizes.join(keys, on, "left_semi"), [F.col("lot"), F.col("source"), F.col("row")], "mix-copies")
    firsts = listed.groupBy(*same).agg(F.min("number").alias("first")).select(F.col("lot").alias("again_lot"), F.col("source").alias("again_source"), "first")
    copy = F.col("number") - F.col("first")
    dealt = listed.join(firsts, on).withColumn("lot", F.when(copy > 0, F.xxhash64("lot", copy)).otherwise(F.col("lot"))).select(*sizes.columns)
    return materialize(sizes.join(keys, on, "left_anti").unionByName(dealt), "mix-told")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    block_words: int = 8,
    shard_words: int = 262_144,
    seed: int = 17,
    carry: str | None = None,
) -> DataFrame:
    """One row per input row: the id, ``source``, ``size``, ``source_size``, ``target`` and ``taken``, and ``carry``, a column of ``df``.

    Sizes are words (a null text has none); sources in code-point order, null last, take the weights in
    turn. An empty table, or one without words, gives targets and ``taken`` of 0. Rows that repeat are
    documents of their own, told by the number of the copy and dealt over all shards. Only the named
    columns are read. Reruns agree, as the orders and starts are hashes of the id, the text, the copy and
    the seed. A null source is a source like the others.
    """
    sizes = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{source_col}`").cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("lot"),
        (F.col(f"`{carry}`") if carry else F.lit(None).cast("int")).alias("carry"),
        F.monotonically_increasing_id().alias("row"),
    )
    sizes = told_apart(materialize(sizes, "mix-sizes"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = numbered(sources, [F.col("source").asc_nulls_last()], "mix-sources")
    kinds = F.array(*(F.lit(float(x)) for x in weights))
    sources = sources.select("source", "number", "source_size", F.get(kinds, (F.col("number") % len(weights)).cast("int")).alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("room"))
    total = sources.agg(F.sum("source_size").alias("n")).first().n or 0
    level = water_level(sources, share * total) if total else 0.0
    target = F.col("room") if level is None else F.least("room", F.col("weight") * level)
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    sources = materialize(sources.select("source", F.col("number").alias("grp"), "source_size", target.alias("target"), shards.alias("n_shards")), "mix-targets")
    placed = sizes.join(sources, sizes.source.eqNullSafe(sources.source), "left").select("id", "carry", sizes.source, "size", "source_size", "target", "grp", F.pmod("lot", "n_shards").alias("unit"), "lot")
    cells = placed.where("size > 0").groupBy("grp", "unit").agg(F.sum("size").alias("votes"))
    cells = materialize(cells.withColumn("most", F.floor(F.col("votes") * F.lit(float(cap)) / block_words)), "mix-cells")
    rooms = cells.groupBy("grp").agg(F.sum("most").alias("most"))
    by_target = sources.join(rooms, "grp").select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("unit"), F.col("target").alias("votes"), "most")
    blocks = round((sources.agg(F.sum("target").alias("n")).first().n or 0.0) / block_words)
    seats = apportion(by_target, df.sparkSession.range(1).select(F.col("id").alias("grp"), F.lit(blocks).cast("long").alias("seats")), "mix-seats")
    quotas = apportion(cells, seats.select(F.col("unit").alias("grp"), F.col("quota").alias("seats")), "mix-quotas")
    arcs = cells.join(quotas, ["grp", "unit"]).select(
        "grp", "unit", F.col("votes").alias("ring"), (F.col("quota") * block_words).alias("quota_words"),
        (F.pmod(F.xxhash64(F.lit(seed), "grp", "unit"), F.greatest(F.lit(1), F.floor(F.col("votes") / block_words))) * block_words).alias("begin"),
    )
    arcs = materialize(arcs, "mix-arcs")
    discard(cells, seats, quotas)
    # Documents without words are in no ring, however many there are.
    order = W.partitionBy("grp", "unit").orderBy(F.xxhash64(F.lit(seed + 1), "lot"), "lot", "id", "size")
    spots = placed.where("size > 0").withColumn("upto", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = spots.join(arcs, ["grp", "unit"], "left")
    laps = F.floor(F.col("quota_words") / F.col("ring"))
    first, last = F.col("upto") - F.col("size"), F.col("upto")
    arc = F.col("quota_words") - laps * F.col("ring")
    overlap = lambda shift: F.greatest(F.lit(0), F.least(last, F.col("begin") + arc - shift) - F.greatest(first, F.col("begin") - shift))
    taken = F.coalesce(laps * F.col("size") + overlap(F.lit(0)) + overlap(F.col("ring")), F.lit(0)).cast("long")
    kept = [F.col("carry").alias(carry)] if carry else []
    out = lambda rows, c: rows.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", c.alias("taken"), *kept)
    return out(joined, taken).unionByName(out(placed.where("size = 0"), F.lit(0).cast("long")))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))
