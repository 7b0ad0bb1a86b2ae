"""Sessions: a builder with this engine's settings, and the package's code sent to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent

#: Settings that hold at any size; sizes of partitions are left to adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

_shipped: set[str] = set()


def session(name: str = "docketry", master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS and what the caller sets besides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    return ship(builder.config(map=SETTINGS | settings).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's modules to the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        path = Path(tempfile.mkdtemp(prefix="docketry-")) / "docketry.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(PACKAGE.rglob("*")):
                if p.is_file() and p.suffix != ".pyc":
                    z.write(p, p.relative_to(PACKAGE.parent))
        context.addPyFile(str(path))
        _shipped.add(context.applicationId)
    return spark
