"""Session helper for local runs and tests; on a cluster the submitted settings win."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

#: Rows of an Arrow batch at most. A row is a frame or an audio block, and numpy, pandas and Arrow hold a batch and its result several times.
BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to ``BATCH_ROWS``; a smaller setting stays."""
    if not 0 < int(spark.conf.get(BATCH)) <= BATCH_ROWS:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def get_session(app: str = "footlamp", cpus: str | None = None, **conf: str) -> SparkSession:
    """Return a session; ``local[cpus]`` only when no master was submitted."""
    builder = SparkSession.builder.appName(app)
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        n = cpus or "*"
        builder = (
            builder.master(f"local[{n}]")
            .config("spark.driver.memory", os.environ.get("FOOTLAMP_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", "8" if n == "*" else n)
        )
    for key, value in {**LOCAL_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    small_batches(spark)
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which do not share the driver's import path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="footlamp-pkg-"), "footlamp.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(root.rglob("*.py")):
            z.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
