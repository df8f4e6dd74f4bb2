"""Queries: streams (STR1-9) and user functions (UDF1-3).

Each stream reads the given table as a file stream, runs until all input is used, and returns its sink
table. The check SQL is the batch form of the same rows; in append mode only what the final watermark
(latest event minus ten minutes) has passed is emitted.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from footlamp.catalog.fixtures import LUMA, ROWWISE, SEGMENT_CTE, cte, frames, rows, segments
from footlamp.catalog.frames import FR
from footlamp.catalog.registry import REGISTRY, query
from footlamp.catalog.registry import r6 as S6
from footlamp.catalog.telemetry import METRIC
from footlamp.functions.scalars import epoch_us, instant, r6
from footlamp.functions.user import StagedRun, map_frames, register_venue_functions
from footlamp.operators import jobs as J
from footlamp.streaming import live as L

SEEN = "wm AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM events)"


def stream(t, table: str):
    return L.read_stream(t.spark, t.dir, f"{table}.parquet", getattr(t, table).schema)


def metric_stream(t):
    cols = ROWWISE["metric"][1]
    df = stream(t, "events").selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    return df.withColumn("us", epoch_us()).withColumn("ts", instant())


def rounded(df, *cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("str1_stream_progress", REGISTRY["agg3_progress"].sql)
def str1(t):
    cols = ROWWISE["stage_event"][1]
    events = stream(t, "conversations").selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    events = events.select("*", F.col("step").alias("substage"), F.col("step").alias("ts"), (F.col("step") + 1.0).alias("substage_weight"))
    latest = L.drain_updates(L.stream_latest_substages(events), "progress", ["job_id", "stage", "substage"])
    return J.progress(latest).withColumn("progress", r6(F.col("progress")))


@query(
    "str1_stream_snapshots",
    f"""WITH {cte("stage_event")}, e AS (SELECT *, status IN ('skipped', 'completed') AS fin, CASE WHEN status IN ('skipped', 'completed') THEN 1e0 ELSE progress END AS p FROM stage_event),
    s AS (SELECT job_id, stage, max(weight) AS weight, sum(p * (step + 1)) / sum(step + 1) AS p FROM e GROUP BY job_id, stage),
    j AS (SELECT job_id, count(*) AS n_stages, sum(p * weight) / sum(weight) AS progress FROM s GROUP BY job_id),
    k AS (SELECT job_id, (max(step) - min(step)) * 60e0 AS el, arg_max(stage, step) AS stage, count(*) FILTER (WHERE fin) AS n_done FROM e GROUP BY job_id)
    SELECT job_id, k.stage, {S6('s.p')} AS stage_progress, n_stages, {S6('j.progress')} AS progress, el AS elapsed_s,
      {S6('CASE WHEN j.progress > 0 AND j.progress < 1 THEN el / j.progress - el ELSE 0 END')} AS eta_s, {S6('CASE WHEN el > 0 THEN n_done / el ELSE 0 END')} AS speed
    FROM j JOIN k USING (job_id) JOIN s USING (job_id) WHERE s.stage = k.stage""",
)
def str1_snapshots(t):
    cols = ROWWISE["stage_event"][1]
    events = stream(t, "conversations").selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])
    minute = F.timestamp_micros((F.col("step") + 1).cast("bigint") * 60_000_000)
    events = events.select("*", F.col("step").alias("substage"), minute.alias("ts"), (F.col("step") + 1.0).alias("substage_weight"))
    return rounded(L.drain_updates(L.stream_snapshots(events), "snapshots", ["job_id"]), "stage_progress", "progress", "eta_s", "speed")


@query(
    "str2_stream_utilisation",
    f"""WITH {METRIC}, {SEEN}, w AS (SELECT *, unnest(range(10)) AS k, date_trunc('minute', ts) AS m FROM metric), s AS (SELECT *, m - k * INTERVAL 1 MINUTE AS st FROM w)
    SELECT host, epoch_us(st) AS start_us, count(*) AS n, {S6('min(cpu_pct)')} AS cpu_min, {S6('max(cpu_pct)')} AS cpu_max, {S6('avg(cpu_pct)')} AS cpu_avg, {S6('arg_max(cpu_pct, ts)')} AS cpu_now,
      {S6('avg(mem_pct)')} AS mem_avg FROM s, wm WHERE st + INTERVAL 10 MINUTES <= w GROUP BY host, st""",
)
def str2(t):
    df = L.drain(L.stream_utilisation(metric_stream(t)), "utilisation")
    df = df.withColumn("start_us", F.unix_micros("start")).drop("start", "end")
    return rounded(df, "cpu_min", "cpu_max", "cpu_avg", "cpu_now", "mem_avg")


@query(
    "str3_stream_resource_tumbling",
    f"""WITH {METRIC}, {SEEN} SELECT kind, epoch_us(ts) // 30000000 * 30000000 AS start_us, count(*) AS n, {S6('avg(cpu_pct)')} AS cpu_avg, {S6('avg(mem_pct)')} AS mem_avg
    FROM metric, wm WHERE epoch_us(ts) // 30000000 * 30000000 + 30000000 <= epoch_us(w) GROUP BY kind, epoch_us(ts) // 30000000""",
)
def str3(t):
    df = L.drain(L.stream_resource_tumbling(metric_stream(t)), "tumbling")
    return rounded(df.withColumn("start_us", F.unix_micros("start")).drop("start"), "cpu_avg", "mem_avg")


@query(
    "str4_stream_bottlenecks",
    f"""WITH q AS ({REGISTRY["win4_bottleneck_last_n"].sql}), {SEEN} SELECT q.* FROM q JOIN events e ON e.event_id = q.event_id, wm WHERE e.ts <= w""",
)
def str4(t):
    m = metric_stream(t).selectExpr("*", "CASE WHEN host % 2 = 0 THEN value / 4 END AS gpu_pct", "value * 1.5e0 AS disk_mb_s")
    m = m.select("host", "ts", "event_id", "cpu_pct", F.col("mem_pct").cast("double").alias("mem_pct"), "gpu_pct", "disk_mb_s")
    return L.drain(L.stream_bottlenecks(m), "bottlenecks").withColumn("avg_cpu", r6(F.col("avg_cpu")))


@query(
    "str5_stream_recovery_sessions",
    f"""WITH {METRIC}, a AS (SELECT host, ts, mem_pct < 50 AS ok, duration_s FROM metric WHERE kind = 'error'), wm AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM a),
    g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY host ORDER BY ts) + INTERVAL 36 HOURS THEN 0 ELSE 1 END AS brk FROM a),
    s AS (SELECT *, sum(brk) OVER (PARTITION BY host ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
    SELECT host, epoch_us(min(ts)) AS start_us, count(*) AS n_attempts, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE NOT ok) AS n_failed, {S6('sum(duration_s)')} AS duration_s,
      CASE WHEN count(*) FILTER (WHERE ok) > 0 THEN 'resolved' ELSE 'failed' END AS outcome FROM s, wm GROUP BY host, sid, w HAVING max(ts) + INTERVAL 36 HOURS <= w""",
)
def str5(t):
    a = metric_stream(t).where("kind = 'error'").selectExpr("host", "ts", "mem_pct < 50 AS success", "duration_s")
    # the watermark follows the attempts, which may end before the last event of the table
    df = L.drain(L.stream_recovery_sessions(a, "36 hours"), "sessions")
    return rounded(df.withColumn("start_us", F.unix_micros("start")).drop("start"), "duration_s")


@query(
    "str6_stream_ema",
    f"""WITH RECURSIVE src AS MATERIALIZED (SELECT label AS asset_id, vec_id AS frame_key, list_transform(embedding, lambda v: CAST({LUMA} AS DOUBLE)) AS L,
      row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
    e AS (SELECT asset_id, frame_key, rn, L AS S FROM src WHERE rn = 1
      UNION ALL SELECT s.asset_id, s.frame_key, s.rn, list_transform(range(64), lambda i: 0.9e0 * s.L[i + 1] + 0.1e0 * e.S[i + 1]) FROM e JOIN src s ON s.asset_id = e.asset_id AND s.rn = e.rn + 1)
    SELECT asset_id, frame_key, CAST(i AS INT) AS p, {S6('S[i + 1]')} AS v FROM e, (SELECT unnest(range(64)) AS i) g""",
)
def str6(t):
    src = stream(t, "embeddings").select(
        F.col("label").alias("asset_id"), F.col("vec_id").alias("frame_key"), F.expr(f"transform(embedding, v -> CAST({LUMA} AS DOUBLE))").alias("luma")
    )
    df = L.drain(L.stream_ema(src), "ema")
    px = df.select("asset_id", "frame_key", "block", F.posexplode("luma").alias("i", "v"))
    return px.select("asset_id", "frame_key", (F.col("block") * 4096 + F.col("i")).cast("int").alias("p"), r6(F.col("v")).alias("v"))


@query(
    "str7_stream_session_pairs",
    f"""WITH {METRIC}, k AS (SELECT * FROM metric WHERE kind IN ('signup', 'purchase')), wm AS (SELECT max(ts) - INTERVAL 10 MINUTES AS w FROM k),
    s AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM k, wm WHERE ts <= w),
    c AS (SELECT host, n, event_id AS close_id, ts FROM s WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY host, n ORDER BY ts, event_id) = 1)
    SELECT o.host, o.event_id AS open_id, close_id, {S6('(epoch_us(c.ts) - epoch_us(o.ts)) / 1e6')} AS duration_s FROM s o JOIN c ON c.host = o.host AND c.n = o.n WHERE o.kind = 'signup'""",
)
def str7(t):
    df = L.drain(L.stream_session_pairs(metric_stream(t)), "pairs")
    return df.select("host", "open_id", "close_id", r6((F.col("close_us") - F.col("open_us")) / 1e6).alias("duration_s"))


@query(
    "str8_stream_checkpoint_cadence",
    f"""WITH RECURSIVE {METRIC}, {SEEN}, s AS MATERIALIZED (SELECT host, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY host ORDER BY ts, event_id) AS rn FROM metric, wm WHERE ts <= w),
    r AS (SELECT host, event_id, us, rn, us AS last, true AS hit FROM s WHERE rn = 1
      UNION ALL SELECT s.host, s.event_id, s.us, s.rn, CASE WHEN s.us - r.last >= 129600000000 THEN s.us ELSE r.last END, s.us - r.last >= 129600000000 FROM r JOIN s ON s.host = r.host AND s.rn = r.rn + 1)
    SELECT host, event_id, us FROM r WHERE hit""",
)
def str8(t):
    m = metric_stream(t).select("host", "ts", "event_id", "us")
    return L.drain(L.stream_checkpoint_cadence(m, 36 * 3600.0), "cadence")


@query(
    "str9_stream_stalled_jobs",
    f"""WITH {METRIC}, {SEEN}, h AS (SELECT host, count(*) AS n_events, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS last_us FROM metric GROUP BY host)
    SELECT host, n_events, last_us, {S6('greatest(0, 80 - n_events) * ((last_us - f) / 6e7) / (n_events - 1)')} AS remaining_min FROM h, wm WHERE last_us + 43200000000 < epoch_us(w)""",
)
def str9(t):
    m = metric_stream(t).select("host", "ts", "us")
    return rounded(L.drain(L.stream_stalled_jobs(m, 720.0, 80), "stalled"), "remaining_min")


# User functions -----------------------------------------------------------------------------------


def invert_bright(img: np.ndarray) -> np.ndarray:
    """Sample callback: inverts a frame and refuses dark ones."""
    if img.mean() < 120:
        raise ValueError("too dark")
    return 255 - img


@query(
    "udf1_map_frames",
    f"""WITH {FR} SELECT asset_id, frame_no, CASE WHEN list_avg(L) >= 120 THEN list_sum(list_transform(L, lambda v: 255e0 - v)) END AS total, CASE WHEN list_avg(L) < 120 THEN 'ValueError' END AS error FROM fr""",
)
def udf1(t):
    df = map_frames(frames(t), invert_bright)
    total = F.when(F.col("luma").isNotNull(), F.aggregate("luma", F.lit(0.0), lambda a, v: a + v))
    return df.select("asset_id", "frame_no", total.alias("total"), "error")


@query(
    "udf2_staged_run",
    f"""WITH {SEGMENT_CTE} SELECT job_id, count(*) AS n_segments, CAST(sum(frames) AS BIGINT) AS frames FROM seg WHERE status = 'completed' GROUP BY job_id HAVING sum(frames) > 50""",
)
def udf2(t):
    run = StagedRun(t.spark)
    run.add_stage("good", lambda df: df.where("status = 'completed'").select("job_id", "frames"))
    run.add_stage("per_job", lambda df: df.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("frames").alias("frames")))
    run.add_stage("large", lambda df: df.where("frames > 50"))
    run.run(segments(t))
    return run.run(resume_after="per_job")


@query(
    "udf3_venue_gain",
    f"""WITH {cte('media_asset')}, g(venue, gain, width, thr) AS (VALUES ('small', 1.1e0 * 2.5e0, 0.8e0, 0.8e0), ('medium', 2.5e0, 1e0, 0.7e0), ('large', 0.9e0 * 2.5e0, 1.3e0, 0.6e0))
    SELECT asset_id, {S6('gain')} AS gain, width, thr AS threshold FROM media_asset m JOIN g ON g.venue = m.venue""".replace("SELECT asset_id, ", "SELECT m.asset_id, ").replace(
        " AS gain, width,", " AS gain, g.width,"
    ),
)
def udf3(t):
    register_venue_functions(t.spark)
    return rows(t, "media_asset").selectExpr(
        "asset_id", "round(venue_gain(venue, 'presence'), 6) AS gain", "venue_width(venue) AS width", "venue_threshold(venue) AS threshold"
    )
