"""Shot plans in files, and what a plan calls its subject."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.plans.shots import PLAN_COLUMNS
from loomset.plans.training import scalar

NEEDED = PLAN_COLUMNS[:4]


def save_plan(plan: DataFrame, path: str) -> str:
    """A YAML list of shots in the plan's order (a plan is tens of rows); the suffix becomes .yaml unless it is one of YAML's."""
    spot = Path(path)
    spot = spot if spot.suffix.lower() in (".yaml", ".yml") else spot.with_suffix(".yaml")
    spot.parent.mkdir(parents=True, exist_ok=True)
    rows = [r.asDict() for r in plan.select(*PLAN_COLUMNS).toLocalIterator()]
    text = "".join("".join(f"{'- ' if i == 0 else '  '}{k}: {json.dumps(str(r[k] or ''), ensure_ascii=False)}\n" for i, k in enumerate(PLAN_COLUMNS)) for r in rows)
    spot.write_text(text or "[]\n", encoding="utf-8")
    return str(spot)


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan with ``ord``; a file that is no list, or a shot without its required fields, is an error."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, list):
        raise ValueError(f"{path} holds no list of shots")
    for i, shot in enumerate(raw):
        if not isinstance(shot, dict) or any(not isinstance(shot.get(k), str) for k in NEEDED):
            raise ValueError(f"shot {i} of {path} needs {', '.join(NEEDED)}")
    rows = [(i, *(str(shot.get(k) or "") for k in PLAN_COLUMNS)) for i, shot in enumerate(raw)]
    return spark.createDataFrame(rows, "ord long, " + ", ".join(f"{k} string" for k in PLAN_COLUMNS))


def plan_subject(name: Column, dataset_type: Column) -> Column:
    """A concept is its own noun; anything else is a character."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    return F.when(dataset_type == "concept", F.coalesce(F.nullif(bare, F.lit("")), F.lit("the object"))).when(bare != "", F.concat(F.lit("character "), bare)).otherwise("the character")


def first_shots(plan: DataFrame, most: int = 0) -> DataFrame:
    """The plan's first shots by ``ord``; 0 takes all."""
    return plan.orderBy("ord").limit(most) if most else plan.orderBy("ord")


def in_turn(plan: DataFrame) -> DataFrame:
    """Shots that hang on none before those that do."""
    return plan.orderBy(F.col("chain_from") != "", "ord")
