"""Shared scratch space for checkpoints, streaming state and staged tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    A cluster must name that folder. Only a local master may fall back to a temporary folder,
    because there driver and executors share one disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="footlamp-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared scratch folder and read it back.

    Losing an executor afterwards costs a re-read, not a recomputation of the whole chain.
    """
    path = scratch_dir(df.sparkSession, "stage")
    made = _MADE.get()
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system its path names."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def result_only(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """Materialise what ``build`` returns, then delete every table that ``cut_lineage`` wrote on the way to it.

    Nothing but the result may go on using those tables. An error deletes them as well.
    """
    made: list[str] = []
    outer = _MADE.set(made)
    try:
        found = build()
        _MADE.reset(outer)
        return cut_lineage(found)
    finally:
        if _MADE.get() is made:
            _MADE.reset(outer)
        for path in made:
            delete(spark, path)
