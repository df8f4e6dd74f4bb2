"""Windows over telemetry, checkpoints and logs.

A host may send a third of all rows, so every per-host order goes through the chunked helpers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.functions.scalars import codes, epoch_us, ratio
from footlamp.plans.ordered import number_rows, running_sums, sliding

ORDER = ["ts", "event_id"]


def sequence_hosts(metrics: DataFrame) -> DataFrame:
    return number_rows(metrics, ["host"], ORDER, None, "seq")


# Bottleneck limits in percent and MB/s.
LIMITS = {"cpu": (90.0, 20.0), "memory": (85.0, 30.0), "gpu": (95.0, 15.0)}
DISK_LIMIT = 100.0


# Limits of the form over ten samples; a None has no lower limit.
RECENT_LIMITS = {"cpu": (90.0, 30.0), "memory": (85.0, None), "disk_io": (100.0, None)}


def bottleneck_codes(cpu: Column, mem: Column, gpu: Column, disk: Column) -> Column:
    """Codes of the resources outside their band; the arguments are means over the last samples."""
    out = []
    for name, mean in (("cpu", cpu), ("memory", mem), ("gpu", gpu)):
        high, low = LIMITS[name]
        out.append(F.when(mean > high, F.lit(f"{name}_high")).when(mean < low, F.lit(f"{name}_low")))
    out.append(F.when(disk > DISK_LIMIT, F.lit("disk_io")))
    return codes(*out)


def bottleneck_recent(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The form over ten samples: its own limits, and reads and writes judged apart."""
    means = {"cpu": ["cpu_pct"], "memory": ["mem_pct"], "disk_io": ["read_mb_s", "write_mb_s"]}

    def make(w):
        last = w.rowsBetween(-(n - 1), 0)
        return {f"m_{c}": F.avg(c).over(last) for cols in means.values() for c in cols}

    df = sliding(sequence_hosts(metrics), ["host"], "seq", make, before=n - 1)
    found = []
    for name, cols in means.items():
        high, low = RECENT_LIMITS[name]
        value = F.greatest(*[F.col(f"m_{c}") for c in cols]) if len(cols) > 1 else F.col(f"m_{cols[0]}")
        code = F.when(value > high, F.lit(f"{name}_high"))
        found.append(code if low is None else code.when(value < low, F.lit(f"{name}_low")))
    enough = F.col("seq") >= n - 1
    return df.select(
        "event_id",
        "host",
        F.when(enough, F.lit("analysed")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.when(enough, codes(*found)).alias("bottlenecks"),
        *[F.when(enough, F.col(f"m_{c}")).alias(f"avg_{c}") for cols in means.values() for c in cols],
    )


def bottleneck_last_n(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Bottlenecks over the last ``n`` samples of each host; fewer samples give no verdict."""

    def make(w):
        last = w.rowsBetween(-(n - 1), 0)
        cols = {f"m_{c}": F.avg(c).over(last) for c in ("cpu_pct", "mem_pct", "gpu_pct", "disk_mb_s")}
        return cols

    df = sliding(sequence_hosts(metrics), ["host"], "seq", make, before=n - 1)
    found = bottleneck_codes(*[F.col(f"m_{c}") for c in ("cpu_pct", "mem_pct", "gpu_pct", "disk_mb_s")])
    enough = F.col("seq") >= n - 1
    return df.select(
        "event_id",
        "host",
        F.when(enough, F.lit("analysed")).otherwise(F.lit("insufficient_data")).alias("status"),
        F.when(enough, found).alias("bottlenecks"),
        F.when(enough, F.col("m_cpu_pct")).alias("avg_cpu"),
    )


def io_rate(counters: DataFrame) -> DataFrame:
    """MB/s between consecutive samples of a growing byte counter; the first row is 0."""
    seq = sequence_hosts(counters.withColumn("__us", epoch_us()))
    df = sliding(
        seq, ["host"], "seq", lambda w: {"__b": F.lag("bytes").over(w), "__t": F.lag("__us").over(w)}, before=1
    )
    seconds = (F.col("__us") - F.col("__t")) / 1e6
    rate = F.when(seconds > 0, (F.col("bytes") - F.col("__b")) / seconds / 1048576.0).otherwise(0.0)
    return df.select("event_id", "host", F.coalesce(rate, F.lit(0.0)).alias("mb_per_s"))


def adaptive_multiplier(work: DataFrame) -> DataFrame:
    """Thread and memory multipliers after each sample of a host."""
    eff = F.when(F.col("failed"), 0.0).otherwise(
        (F.col("cpu_pct") + F.col("mem_pct")) / 2 / F.greatest(F.col("duration_s"), F.lit(0.1))
    )
    seq = sequence_hosts(work.withColumn("efficiency", eff))
    block = F.floor(F.col("seq") / 65536).cast("bigint")
    running = running_sums(seq, ["host"], ["seq"], block, {"__sum": F.col("efficiency")})

    def make(w):
        last = w.rowsBetween(-4, 0)
        return {f"l_{c}": F.avg(c).over(last) for c in ("efficiency", "cpu_pct", "mem_pct")}

    df = sliding(running, ["host"], "seq", make, before=4)
    falling = (F.col("seq") >= 4) & (F.col("l_efficiency") < F.col("__sum") / (F.col("seq") + 1) * 0.9)
    hits = running_sums(
        df,
        ["host"],
        ["seq"],
        block,
        {
            "n_thread": (falling & (F.col("l_cpu_pct") > 90)).cast("bigint"),
            "n_memory": (falling & (F.col("l_mem_pct") > 85)).cast("bigint"),
        },
    )
    return hits.select(
        "event_id",
        "host",
        "efficiency",
        F.greatest(F.lit(0.5), F.pow(F.lit(0.9), F.col("n_thread"))).alias("thread_multiplier"),
        F.greatest(F.lit(0.5), F.pow(F.lit(0.9), F.col("n_memory"))).alias("memory_multiplier"),
    )


def utilisation_stats(metrics: DataFrame, minutes: int = 10) -> DataFrame:
    """Min, max and mean of each resource in the trailing window of every sample, and its current value."""
    span = minutes * 60 * 1000000
    df = metrics.withColumn("__us", epoch_us())

    def make(w):
        last = w.rangeBetween(-span, 0)
        out = {}
        for c in ("cpu_pct", "mem_pct"):
            out |= {f"{c}_min": F.min(c).over(last), f"{c}_max": F.max(c).over(last), f"{c}_avg": F.avg(c).over(last)}
        return out | {"n_samples": F.count(F.lit(1)).over(last)}

    return sliding(df, ["host"], "__us", make, before=span, size=4 * span).drop("__us")


def recent_activity(logs: DataFrame) -> DataFrame:
    """Totals per kind and the newest rows of each kind: ten operations, ten records, five errors."""
    totals = logs.groupBy("kind").agg(F.count(F.lit(1)).alias("n_total"))
    parts = None
    for kind, n in (("operation", 10), ("performance", 10), ("error", 5)):
        part = logs.where(F.col("kind") == kind).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
        parts = part if parts is None else parts.unionByName(part)
    return parts.join(totals, "kind").select("kind", "event_id", "n_total")


def perf_report(metrics: DataFrame, baseline_fps: float = 2.4) -> DataFrame:
    """Mean and peak load and frame rate against a baseline, per host and overall; GPU load may be null."""
    per = metrics.rollup("host").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("cpu_pct").alias("avg_cpu"),
        F.max("cpu_pct").alias("peak_cpu"),
        F.avg("mem_pct").alias("avg_mem"),
        F.max("mem_pct").cast("double").alias("peak_mem"),
        F.avg("gpu_pct").alias("avg_gpu"),
        F.max("gpu_pct").alias("peak_gpu"),
        ratio(F.count(F.lit(1)), F.sum("duration_s")).alias("fps"),
    )
    return per.withColumn("improvement_pct", (F.col("fps") / baseline_fps - 1) * 100)


# Checkpoints --------------------------------------------------------------------------------------

HASHED = ["event_id", "host", "kind", "mem_pct"]


def checkpoint_hash() -> Column:
    """SHA-256 of the record as JSON with sorted keys, without the stored hash."""
    return F.sha2(F.to_json(F.struct(*sorted(HASHED))), 256)


def checkpoint_integrity(checkpoints: DataFrame) -> DataFrame:
    """Intact when the record hash matches and the input, if it still exists, has its old hash."""
    record = checkpoint_hash() == F.col("integrity_hash")
    source = F.col("input_hash_now").isNull() | (F.col("input_hash_now") == F.col("input_hash"))
    return checkpoints.withColumn("record_ok", record).withColumn("intact", record & source)


def newest_first(checkpoints: DataFrame) -> DataFrame:
    """Rank 0 is the newest checkpoint of its input."""
    return number_rows(
        checkpoints, ["host"], [F.desc("ts"), F.desc("event_id")], None, "rank"
    )


def checkpoint_retention(checkpoints: DataFrame, now: Column, keep: int = 10, max_days: int = 30) -> DataFrame:
    """What to delete: beyond the newest ``keep`` of its input, or older than ``max_days``."""
    df = newest_first(checkpoints)
    old = F.col("ts") < now - F.expr(f"INTERVAL {max_days} DAYS")
    return df.withColumn(
        "reason", F.when(F.col("rank") >= keep, F.lit("count")).when(old, F.lit("age"))
    ).withColumn("delete", F.col("reason").isNotNull())


def session_pairs(events: DataFrame, opens: Column, closes: Column) -> DataFrame:
    """Pair each opening event with the first close before the next opening of the same host.

    A running count of openings numbers the sessions, so pairing is one aggregation and keeps sides
    without a partner.
    """
    numbered = running_sums(events, ["host"], ORDER, None, {"session_no": opens.cast("bigint")})
    us = epoch_us()
    per = numbered.where(opens | closes).groupBy("host", "session_no").agg(
        F.min(F.when(opens, us)).alias("__o"),
        F.min(F.when(opens, F.col("event_id"))).alias("open_id"),
        F.min(F.when(closes, F.struct(us.alias("t"), F.col("event_id").alias("e")))).alias("__c"),
    )
    c = F.col("__c")
    return per.select(
        "host",
        "session_no",
        "open_id",
        c["e"].alias("close_id"),
        ((c["t"] - F.col("__o")) / 1e6).alias("duration_s"),
        (F.col("open_id").isNotNull() & c.isNotNull()).alias("success"),
    )
