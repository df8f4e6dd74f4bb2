"""Sinks: run reports, monitoring documents, segment stores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footlamp.plans.ordered import number_rows


def write_report(report: DataFrame, path: str, run_date: str, fmt: str = "parquet") -> None:
    """Append a run report below its run date."""
    dated = report.withColumn("run_date", F.lit(run_date))
    dated.write.mode("append").partitionBy("run_date").format(fmt).save(path)


def monitoring_documents(
    attempts: DataFrame, session: str, order: list[str], fields: list[str], page: int = 1000
) -> DataFrame:
    """One JSON document per session and page of attempts.

    A session may hold any number of attempts, so it is written as numbered pages instead of one value.
    """
    numbered = number_rows(attempts, [session], order, None, "__n")
    paged = numbered.withColumn("part", F.floor(F.col("__n") / page).cast("bigint"))
    docs = paged.groupBy(session, "part").agg(
        F.array_sort(F.collect_list(F.struct("__n", F.struct(*fields).alias("a")))).alias("__items")
    )
    return docs.select(
        session, "part", F.to_json(F.transform("__items", lambda i: i["a"])).alias("document")
    )


def write_segments(segments: DataFrame, path: str, files: int = 64) -> None:
    """Even segments go to store A, odd ones to store B, in at most ``files`` files each; readers prune on the store.

    Rows are dealt by store and a hash of the row's segment and job and sorted by segment, so a store is
    written by many tasks, a task writes one file, and a segment is found by the files' statistics.
    """
    store = F.when(F.col("segment_idx") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    salt = F.pmod(F.xxhash64("job_id", "segment_idx"), F.lit(files))
    dealt = segments.withColumn("store", store).withColumn("__salt", salt).repartition(2 * files, "store", "__salt")
    dealt.drop("__salt").sortWithinPartitions("store", "segment_idx").write.mode("overwrite").partitionBy("store").parquet(path)
