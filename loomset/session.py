"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(app: str = "loomset", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and ANSI arithmetic; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, where Python code runs on them."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="loomset-ship-"), "loomset_package.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent).as_posix())
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
