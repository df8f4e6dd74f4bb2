"""Rollups over a file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlamp.operators.validation import extension

GIB = 1024.0**3
MIB = 1024.0**2


def log_summary(files: DataFrame) -> DataFrame:
    """Log file count and total MB per volume."""
    return (
        files.where(extension() == "log")
        .groupBy("volume")
        .agg(F.count(F.lit(1)).alias("n_logs"), (F.sum("size_bytes") / MIB).alias("total_mb"))
    )


def folder_sizes(files: DataFrame) -> DataFrame:
    """Recursive bytes and file count of every folder.

    Each file adds one row per ancestor; partial aggregation folds them before the shuffle, so the root
    folder costs one row per task.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    folders = F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    deep = files.where(F.size(parts) > 1).select("size_bytes", F.posexplode(folders).alias("depth", "folder"))
    return deep.groupBy("folder", (F.col("depth") + 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").alias("bytes")
    )


def cleanup_summary(files: DataFrame, volumes: DataFrame, movable_mb: float = 94.0) -> DataFrame:
    """Reclaimable and movable GB per volume and the urgency of its fill level."""
    junk = extension().isin("log", "txt")
    movable = ~junk & (F.col("size_bytes") > movable_mb * MIB)
    per = files.groupBy("volume").agg(
        (F.coalesce(F.sum(F.when(junk, F.col("size_bytes"))), F.lit(0)) / GIB).alias("reclaimable_gb"),
        (F.coalesce(F.sum(F.when(movable, F.col("size_bytes"))), F.lit(0)) / GIB).alias("movable_gb"),
        F.count_if(junk).alias("n_deletable"),
        F.count_if(movable).alias("n_movable"),
    )
    used = F.col("usage_pct")
    return per.join(volumes, "volume").withColumn(
        "urgency",
        F.when(used > 90, F.lit("urgent")).when(used > 80, F.lit("high")).when(used > 70, F.lit("medium")).otherwise(F.lit("low")),
    )


def old_logs(files: DataFrame, days: int = 30) -> DataFrame:
    return files.where((extension() == "log") & (F.col("age_days") > days))


def largest_folders(folders: DataFrame, min_mb: float = 500.0, n: int = 10) -> DataFrame:
    """The ``n`` largest folders above a size (the report is a top-n, hence the limit)."""
    return folders.where(F.col("bytes") > min_mb * MIB).orderBy(F.desc("bytes"), "folder").limit(n)
