"""Generation of shots in waves: a shot that is chained to another one is made after it, from its output.

Chains may be of any length. The wave of a shot is the number of open shots above it, found by doubling:
each round a shot's way up is joined with the way of the shot that it has come to, so a chain of n steps
takes log2(n) rounds. (A recursive query takes a round for each step, and stops at a number of rows.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomset.operators.answers import AnswerLog, scratch_log
from loomset.operators.batch import Pace, Retries
from loomset.plans import shots
from loomset.store import discard, materialize

SEEDS = 1 << 48


def waves(todo: DataFrame) -> DataFrame:
    """(id, parent, wave, ring) for the shots (id, chain_from) that are to be made.

    ``parent`` is the shot above it that is also to be made; a shot without one, or chained to nothing, to
    a shot that is done or to an unknown one, is of wave 0. Shots that are chained in a ring, and those
    that hang on one, have ``ring`` and no wave. Ids are unique; a null id is left out.
    """
    ids = todo.where("id IS NOT NULL").select("id", "chain_from")
    above = ids.select(F.col("id").alias("parent"))
    way = ids.join(above, F.col("chain_from") == F.col("parent"), "left").select("id", "parent", F.col("parent").alias("up"), F.col("parent").isNotNull().cast("long").alias("wave"))
    way = materialize(way, "waves")
    n, reach = way.count(), 1
    while reach <= n and not way.where("up IS NOT NULL").isEmpty():
        further = way.select(F.col("id").alias("up"), F.col("up").alias("up_up"), F.col("wave").alias("steps"))
        then = way.join(further, "up", "left").select("id", "parent", F.col("up_up").alias("up"), (F.col("wave") + F.coalesce("steps", F.lit(0))).alias("wave"))
        then = materialize(then, "waves")
        discard(way)
        way, reach = then, reach * 2
    ring = F.col("up").isNotNull()
    return way.select("id", "parent", F.when(~ring, F.col("wave")).alias("wave"), ring.alias("ring"))


def generate(
    plan: DataFrame, opened: Callable[[], Callable[[dict], str]], existing: DataFrame | None = None, only_ids: DataFrame | None = None, exclude_props: bool = True,
    seed: int = 0, log: AnswerLog | None = None, retries: Retries = Retries(), stop: Callable[[], bool] | None = None, pace: Pace | None = None,
) -> DataFrame:
    """(id, path, seed, status, error, wave, ring, led_by): what is there of the plan's shots after this run.

    ``opened()`` gives the function that makes one shot and returns its path; it gets the shot's id, kind and
    prompts, a seed, and ``led_by``: the output of the shot that it is chained to, null where that isn't
    there, and the references alone have to do. Results of ``existing`` (id, path, seed, error) stay; with
    ``only_ids``, those of its shots are dropped and only they are made. Waves run one after the other, each
    in parallel; a shot in a ring is made in the first one, from the references. Shots that weren't reached
    before a wish to stop have no row, failed ones have an error, and a run with the same log takes both up.
    """
    spark = plan.sparkSession
    rows = shots.with_wardrobe(shots.clean_plan(plan))
    rows = (shots.without_props(rows) if exclude_props else rows).dropDuplicates(["id"])
    kept = existing.select("id", "path", "seed", "error") if existing is not None else spark.createDataFrame([], "id string, path string, seed long, error string")
    if only_ids is not None:
        kept, rows = kept.join(only_ids, "id", "left_anti"), rows.join(only_ids, "id", "left_semi")
    kept = materialize(kept, "generate-kept")
    rows = materialize(rows.withColumn("seed", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(SEEDS))), "generate-todo")
    order = materialize(waves(rows), "generate-waves")
    log = log or scratch_log(spark)
    done = kept.where("path IS NOT NULL").select(F.col("id").alias("chain_from"), F.col("path").alias("led_by"))
    made = order.select("id", F.lit(None).cast("string").alias("output"), F.lit(None).cast("int").alias("status"), F.lit("").alias("error"), F.lit(None).cast("string").alias("led_by")).limit(0)
    for wave in range((order.agg(F.max("wave")).first()[0] or 0) + 1):
        if stop and stop():
            break
        now = rows.join(order.where(F.coalesce("wave", F.lit(0)) == wave).select("id"), "id").join(done, "chain_from", "left")
        now = materialize(now.select("id", F.struct("id", "kind", "local_prompt", "cloud_prompt", "seed", "led_by").alias("shot"), "led_by"), f"generate-{wave}")
        said = materialize(log.ask(now, "id", "shot", opened, retries, stop, pace=pace), f"generate-made-{wave}")
        made = made.unionByName(said.join(now.select("id", "led_by"), "id"))
        done = done.unionByName(said.where("error = ''").select(F.col("id").alias("chain_from"), F.col("output").alias("led_by")))
    new = made.join(rows.select("id", "seed"), "id").join(order.select("id", "wave", "ring"), "id")
    new = new.select("id", F.col("output").alias("path"), "seed", "status", "error", "wave", "ring", "led_by")
    old = kept.join(new.select("id"), "id", "left_anti").select("id", "path", "seed", F.lit(None).cast("int").alias("status"), "error", F.lit(None).cast("long").alias("wave"), F.lit(False).alias("ring"), F.lit(None).cast("string").alias("led_by"))
    return old.unionByName(new)
