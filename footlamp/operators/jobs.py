"""Job, segment and stage bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import number_rows, running_sums, sliding

BLOCK = 65536


def _block(col: str) -> Column:
    return F.floor(F.col(col) / BLOCK).cast("bigint")


def plan_segments(jobs: DataFrame, total: str, n: int) -> DataFrame:
    """ceil(total / n) segments per job with their inclusive frame range."""
    last = F.ceil(F.col(total) / n).cast("bigint") - 1
    df = jobs.where(F.col(total) > 0).withColumn("segment_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("segment_idx") * n
    return df.withColumn("start", start).withColumn("end", F.least(start + n - 1, F.col(total).cast("bigint") - 1))


def plan_time_segments(jobs: DataFrame, seconds: str, length_s: float) -> DataFrame:
    """Segments of fixed length in seconds; the last one is shorter."""
    last = F.ceil(F.col(seconds) / length_s).cast("bigint") - 1
    df = jobs.where(F.col(seconds) > 0).withColumn("segment_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("segment_idx") * F.lit(float(length_s))
    return df.withColumn("start_s", start).withColumn("length_s", F.least(F.lit(float(length_s)), F.col(seconds) - start))


def segments_to_timeline(frames: DataFrame, jobs: DataFrame, n: int, total: str) -> DataFrame:
    """Segment range of each frame: the range join is an equi-join because the index is computed."""
    df = join_per_key(frames, jobs.select("job_id", F.col(total).cast("bigint").alias("__total")), ["job_id"], "frame_no", spread=8)
    df = df.where((F.col("frame_no") >= 0) & (F.col("frame_no") < F.col("__total")))
    idx = F.floor(F.col("frame_no") / n).cast("bigint")
    return (
        df.withColumn("segment_idx", idx)
        .withColumn("start", idx * n)
        .withColumn("end", F.least(idx * n + n - 1, F.col("__total") - 1))
        .drop("__total")
    )


def pending_segments(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned segments without a processed result; failed ones stay in."""
    return planned.join(done.select("job_id", "segment_idx"), ["job_id", "segment_idx"], "left_anti")


def skip_existing(assets: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Mark assets whose ``output_name`` exists as skipped."""
    have = outputs.select("output_name").distinct().withColumn("__have", F.lit(True))
    exists = F.coalesce("__have", F.lit(False))
    status = F.when(exists & F.lit(not force), F.lit("skipped")).otherwise(F.lit("pending"))
    return assets.join(have, "output_name", "left").withColumn("status", status).drop("__have")


def combine_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row per segment over several runs; the earlier run wins."""
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    payload = [c for c in both.columns if c not in ("job_id", "segment_idx")]
    best = both.groupBy("job_id", "segment_idx").agg(F.min_by(F.struct(*payload), "run").alias("r"))
    return best.select("job_id", "segment_idx", "r.*")


def compare_runs(first: DataFrame, second: DataFrame) -> DataFrame:
    """Segments of both runs, only the first, only the second."""
    key = ["job_id", "segment_idx"]
    a, b = first.select(*key), second.select(*key)
    return (
        a.intersect(b)
        .withColumn("side", F.lit("both"))
        .unionByName(a.exceptAll(b).withColumn("side", F.lit("first")))
        .unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
    )


def merge_order(segments: DataFrame, audio: DataFrame) -> DataFrame:
    """Offsets of the successful segments in index order, cut at the shorter of video and audio."""
    good = segments.where(F.col("status") == "completed")
    placed = running_sums(good, ["job_id"], ["segment_idx"], _block("segment_idx"), {"end": F.col("frames").cast("bigint")})
    df = placed.withColumn("offset", F.col("end") - F.col("frames"))
    df = join_per_key(df, audio.select("job_id", "audio_frames"), ["job_id"], "segment_idx", spread=8)
    kept = F.greatest(F.lit(0), F.least("end", "audio_frames") - F.col("offset"))
    return df.withColumn("frames_kept", kept)


# Progress -----------------------------------------------------------------------------------------


def effective_progress() -> Column:
    return F.when(F.col("status") == "skipped", 1.0).when(F.col("status") == "completed", 1.0).otherwise(F.col("progress"))


def latest_substages(events: DataFrame) -> DataFrame:
    """Newest event of every (job, stage, substage)."""
    rest = [c for c in events.columns if c not in ("job_id", "stage", "substage")]
    newest = events.groupBy("job_id", "stage", "substage").agg(F.max_by(F.struct(*rest), "ts").alias("e"))
    return newest.select("job_id", "stage", "substage", "e.*")


def progress(events: DataFrame) -> DataFrame:
    """Weighted progress per job: substages by their own weight, stages by theirs; no weight gives 0."""
    now = latest_substages(events)
    per_stage = now.groupBy("job_id", "stage").agg(
        F.max("weight").alias("weight"),
        F.sum(effective_progress() * F.col("substage_weight")).alias("__done"),
        F.sum("substage_weight").alias("__all"),
    )
    share = F.when(F.col("__all") > 0, F.col("__done") / F.col("__all")).otherwise(0.0)
    total = per_stage.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_stages"),
        F.sum(share * F.col("weight")).alias("__p"),
        F.sum("weight").alias("__w"),
    )
    return total.select(
        "job_id", "n_stages", F.when(F.col("__w") > 0, F.col("__p") / F.col("__w")).otherwise(0.0).alias("progress")
    )


def stage_status(events: DataFrame) -> DataFrame:
    """Status per (job, stage): a later start of another stage completes a running one."""
    numbered = number_rows(events, ["job_id"], ["ts"], None, "__seq")
    seen = sliding(
        numbered, ["job_id"], "__seq", lambda w: {"__next": F.lead("stage").over(w)}, before=0, after=1
    )
    moved_on = F.col("__next").isNotNull() & (F.col("__next") != F.col("stage"))
    state = F.when((F.col("status") == "in_progress") & moved_on, F.lit("completed")).otherwise(F.col("status"))
    s = F.col("__state")
    per = seen.withColumn("__state", state).groupBy("job_id", "stage").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.bool_and(s.isin("completed", "skipped")).alias("__done"),
        F.bool_or(s == "failed").alias("__failed"),
        F.bool_or(s == "in_progress").alias("__active"),
    )
    return per.select(
        "job_id",
        "stage",
        "n_events",
        F.when(F.col("__done"), F.lit("completed"))
        .when(F.col("__failed"), F.lit("failed"))
        .when(F.col("__active"), F.lit("in_progress"))
        .otherwise(F.lit("not_started"))
        .alias("status"),
    )


def eta(elapsed: Column, done: Column) -> Column:
    """Remaining seconds; 0 when nothing is known or all is done."""
    return F.when((done > 0) & (done < 1), elapsed / done - elapsed).otherwise(0.0)


def eta_speed(segments: DataFrame) -> DataFrame:
    """ETA and speed per job from its processed segments."""
    done = F.when(F.col("processed"), F.col("frames"))
    per = segments.groupBy("job_id").agg(
        F.sum("frames").alias("total"),
        F.coalesce(F.sum(done), F.lit(0)).alias("items"),
        F.coalesce(F.sum(F.when(F.col("processed"), F.col("seconds"))), F.lit(0.0)).alias("elapsed_s"),
    )
    share = F.when(F.col("total") > 0, F.col("items") / F.col("total")).otherwise(0.0)
    return per.select(
        "job_id",
        "items",
        "elapsed_s",
        share.alias("progress"),
        eta(F.col("elapsed_s"), share).alias("eta_s"),
        F.when(F.col("elapsed_s") > 0, F.col("items") / F.col("elapsed_s")).otherwise(0.0).alias("speed"),
    )


# Reports ------------------------------------------------------------------------------------------


def stage_throughput(runs: DataFrame) -> DataFrame:
    """Frames per second per (batch, stage), per batch and overall. Seconds add up in microseconds, in any order alike."""
    exact = F.sum(F.col("seconds").cast("decimal(18,6)")).cast("double")
    total = runs.rollup("batch", "stage").agg(
        F.sum("frames").cast("bigint").alias("frames"), exact.alias("seconds"), F.grouping_id().alias("level")
    )
    return total.withColumn("fps", F.when(F.col("seconds") > 0, F.col("frames") / F.col("seconds")).otherwise(0.0))


def batch_report(items: DataFrame) -> DataFrame:
    """Counts, bytes and success share for every (preset, status) combination and total."""
    done = F.col("item_status") == "completed"
    per = (
        items.withColumn("item_status", F.col("status"))
        .cube("preset", "status")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.count_if(done).alias("n_completed"),
            F.coalesce(F.sum(F.when(done, F.col("bytes_in"))), F.lit(0)).alias("bytes_in"),
            F.coalesce(F.sum(F.when(done, F.col("bytes_out"))), F.lit(0)).alias("bytes_out"),
            F.avg(F.when(done, F.col("seconds"))).alias("avg_seconds"),
            F.grouping_id().alias("level"),
        )
    )
    return per.withColumn("success_pct", F.col("n_completed") / F.col("n_items") * 100)


def batch_outcome(results: DataFrame, page: int = 100) -> DataFrame:
    """Item ids per operation and outcome as numbered pages, with the outcome total on each page.

    Successful, failed and skipped lists grow with the batch, so each is cut into pages of fixed size.
    """
    outcome = (
        F.when(F.col("status") == "failed", F.lit("failed"))
        .when(F.col("result").isNull(), F.lit("skipped"))
        .otherwise(F.lit("successful"))
    )
    tagged = results.withColumn("outcome", outcome)
    key = ["operation", "outcome"]
    numbered = number_rows(tagged, key, ["item_id"], _block("item_id"), "__n")
    pages = numbered.groupBy(*key, F.floor(F.col("__n") / page).cast("bigint").alias("page")).agg(
        F.array_sort(F.collect_list("item_id")).alias("item_ids")
    )
    totals = tagged.groupBy(*key).agg(F.count(F.lit(1)).alias("n_total"))
    return pages.join(totals, key)


def test_report(results: DataFrame) -> DataFrame:
    """Per suite and overall: totals, pass rate, time and acceptance flags."""
    per = results.rollup("suite").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("passed").alias("n_passed"),
        F.sum("seconds").alias("seconds"),
        F.max("peak_mb").alias("peak_mb"),
        F.max(F.when(F.col("key_test") == 0, F.col("passed").cast("int"))).alias("__k0"),
        F.max(F.when(F.col("key_test") == 1, F.col("passed").cast("int"))).alias("__k1"),
        F.max(F.when(F.col("key_test") == 2, F.col("passed").cast("int"))).alias("__k2"),
    )
    rate = F.col("n_passed") / F.col("total") * 100
    keys = sum((F.coalesce(F.col(k), F.lit(0)) for k in ("__k0", "__k1", "__k2")), F.lit(0))
    return per.select(
        "suite",
        "total",
        "n_passed",
        (F.col("total") - F.col("n_passed")).alias("n_failed"),
        rate.alias("rate"),
        "seconds",
        (rate > 95).alias("stable"),
        (rate > 90).alias("pass_rate_ok"),
        (F.col("peak_mb") < 6000).alias("memory_ok"),
        (keys >= 2).alias("error_handling_ok"),
    )
