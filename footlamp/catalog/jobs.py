"""Queries: sources, sinks, jobs, segments, reports and file rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import SEGMENT_CTE, cte, rows, segments
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.catalog.validation import EXT
from footlamp.functions.scalars import r6
from footlamp.operators import files as FI
from footlamp.operators import jobs as J
from footlamp.plans.storage import scratch_dir
from footlamp.sources import logs as L
from footlamp.sources import media as M
from footlamp.sources import sinks as S

# Probe documents: streams and keys are missing in a fixed share of the assets.
RATE = "CASE p_partkey % 4 WHEN 0 THEN '30000/1001' WHEN 1 THEN '25/1' WHEN 2 THEN '24/0' END"
STREAM_DURATION = "CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey + 10 AS STRING) END"
FORMAT_DURATION = "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey + 11 AS STRING) END"
STREAM_RATE = "CASE WHEN p_size % 2 = 0 THEN CAST(p_size * 1000 AS STRING) END"
FORMAT_RATE = "CASE WHEN p_size % 3 <> 0 THEN CAST(p_size * 1001 AS STRING) END"
HAS_VIDEO = "p_size % 13 <> 0"
CHANNELS = "CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 6 + 1 END"
AUDIO_RATE = "CASE WHEN p_partkey % 9 <> 0 THEN '48000' END"


def probes(t):
    video = (
        f"CASE WHEN {HAS_VIDEO} THEN named_struct('codec_type', 'video', 'codec_name', 'h264', 'width', p_size * 80, "
        f"'height', p_size * 45, 'r_frame_rate', {RATE}, 'duration', {STREAM_DURATION}, 'bit_rate', {STREAM_RATE}, "
        "'channels', CAST(NULL AS INT), 'sample_rate', CAST(NULL AS STRING), 'tags', CAST(NULL AS STRUCT<language: STRING>)) END"
    )
    audio = (
        "transform(sequence(1, 2), i -> CASE WHEN i <= p_partkey % 3 THEN named_struct('codec_type', 'audio', "
        "'codec_name', CASE i WHEN 1 THEN 'aac' END, 'width', CAST(NULL AS INT), 'height', CAST(NULL AS INT), "
        "'r_frame_rate', CAST(NULL AS STRING), 'duration', CAST(NULL AS STRING), 'bit_rate', CAST(i * 64000 AS STRING), "
        f"'channels', CAST({CHANNELS} AS INT), 'sample_rate', {AUDIO_RATE}, "
        "'tags', CASE WHEN p_size % 2 = 0 THEN named_struct('language', concat('l', CAST(i AS STRING))) END) END)"
    )
    doc = (
        f"to_json(named_struct('format', named_struct('duration', {FORMAT_DURATION}, 'bit_rate', {FORMAT_RATE}), "
        f"'streams', array_compact(concat(array({video}), {audio}))))"
    )
    return M.parse_probe(t.part.selectExpr("p_partkey AS asset_id", f"{doc} AS probe"))


@query(
    "src1_probe_assets",
    f"""SELECT p_partkey AS asset_id, CASE WHEN {HAS_VIDEO} THEN p_size * 80 END AS width, CASE WHEN {HAS_VIDEO} THEN p_size * 45 END AS height,
    CASE WHEN {HAS_VIDEO} THEN CAST(coalesce({STREAM_DURATION}, {FORMAT_DURATION}, '0') AS DOUBLE) END AS duration_s,
    CASE WHEN {HAS_VIDEO} THEN {S6("CASE WHEN p_partkey % 4 = 0 THEN 30000e0 / 1001 ELSE 25 END")} END AS fps,
    CASE WHEN {HAS_VIDEO} THEN CAST(coalesce({STREAM_RATE}, {FORMAT_RATE}, '0') AS BIGINT) END AS bitrate,
    CASE WHEN {HAS_VIDEO} THEN p_partkey % 3 > 0 END AS has_audio,
    CAST(CASE WHEN {HAS_VIDEO} AND p_partkey % 3 > 0 THEN coalesce({CHANNELS}, 2) END AS INT) AS channels,
    CASE WHEN {HAS_VIDEO} AND p_partkey % 3 > 0 THEN CAST(coalesce({AUDIO_RATE}, '44100') AS INT) END AS audio_rate,
    CASE WHEN NOT ({HAS_VIDEO}) THEN 'no_video_stream' END AS error FROM part""",
)
def src1(t):
    return M.probe_assets(probes(t)).drop("codec").withColumn("fps", r6(F.col("fps")))


@query(
    "src1_probe_format_only",
    f"""SELECT p_partkey AS asset_id, CASE WHEN {HAS_VIDEO} THEN CAST(coalesce({FORMAT_DURATION}, '0') AS DOUBLE) END AS duration_s,
    CASE WHEN {HAS_VIDEO} THEN CAST(coalesce({FORMAT_RATE}, '0') AS BIGINT) END AS bitrate FROM part""",
)
def src1_format(t):
    return M.probe_assets(probes(t), format_only=True).select("asset_id", "duration_s", "bitrate")


@query(
    "src2_discover_assets",
    f"""WITH {cte('file_inventory')}, n AS (SELECT file_id, path, age_days, regexp_extract(path, '([^/]+)$', 1) AS name, {EXT} AS ext FROM file_inventory)
    SELECT file_id, concat(regexp_extract(name, '^(.*)(\\.[^.]+)$', 1), '_enhanced_', CASE file_id % 3 WHEN 0 THEN 'small' ELSE 'large' END, '_',
      CASE age_days % 2 WHEN 0 THEN 'fast' ELSE 'high' END, '_4k', regexp_extract(name, '(\\.[^.]+)$', 1)) AS output_name
    FROM n WHERE ext IN ('mp4','avi','mkv','mov','wmv','flv','webm')""",
)
def src2(t):
    files = rows(t, "file_inventory")
    preset = F.expr("CASE file_id % 3 WHEN 0 THEN 'small' ELSE 'large' END")
    quality = F.expr("CASE age_days % 2 WHEN 0 THEN 'fast' ELSE 'high' END")
    return M.discover_assets(files, preset, quality).select("file_id", "output_name")


@query(
    "src3_explode_tracks",
    f"""WITH k AS (SELECT *, p_partkey % 3 AS nt FROM part), e AS (SELECT *, unnest(range(1, greatest(nt, 1) + 1)) AS i FROM k)
    SELECT p_partkey AS asset_id, CASE WHEN nt > 0 THEN CAST(i AS INT) END AS track, CASE WHEN nt > 0 THEN CASE i WHEN 1 THEN 'aac' ELSE 'unknown' END END AS codec,
      CASE WHEN nt > 0 THEN CAST(i * 64000 AS BIGINT) END AS bitrate, CASE WHEN nt > 0 THEN CAST(coalesce({CHANNELS}, 2) AS INT) END AS channels,
      CASE WHEN nt > 0 THEN 'stereo' END AS layout, CASE WHEN nt > 0 THEN CAST(coalesce({AUDIO_RATE}, '44100') AS INT) END AS rate,
      CASE WHEN nt > 0 THEN CASE WHEN p_size % 2 = 0 THEN concat('l', CAST(i AS STRING)) ELSE 'unknown' END END AS language FROM e""",
)
def src3(t):
    return M.explode_tracks(probes(t))


STATE = """CASE o_orderkey % 4 WHEN 0 THEN '{"stage":"merge","total_segments":12,"completed":[0,1,2]}'
WHEN 1 THEN '{"failed":[3],"total_segments":7}' WHEN 2 THEN 'broken' ELSE '{}' END"""


@query(
    "src4_load_run_state",
    """SELECT o_orderkey AS job_id, CASE WHEN o_orderkey % 4 = 0 THEN 'merge' ELSE 'init' END AS stage,
    CASE o_orderkey % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 ELSE 0 END AS total_segments,
    CASE WHEN o_orderkey % 4 = 0 THEN '0,1,2' ELSE '' END AS completed, CASE WHEN o_orderkey % 4 = 1 THEN '3' ELSE '' END AS failed FROM orders""",
)
def src4(t):
    df = M.load_run_state(t.orders.selectExpr("o_orderkey AS job_id", f"{STATE} AS state"))
    return df.withColumn("completed", F.array_join(F.col("completed").cast("array<string>"), ",")).withColumn(
        "failed", F.array_join(F.col("failed").cast("array<string>"), ",")
    )


@query(
    "src5_read_logs",
    """SELECT event_id, CASE WHEN event_id % 20 <> 0 THEN event_type END AS level, CASE WHEN event_id % 20 <> 0 AND event_type = 'error' THEN 'Boom' END AS exception_type,
    CASE WHEN event_id % 20 <> 0 THEN CAST(user_id AS STRING) END AS custom_user, CASE WHEN event_id % 20 <> 0 THEN 1 END AS n_custom,
    event_id % 20 = 0 AS corrupt FROM events""",
)
def src5(t):
    line = (
        "CASE WHEN event_id % 20 = 0 THEN concat('{\"level\": ', event_id) ELSE to_json(named_struct('level', event_type, 'line', 7, "
        "'exception', CASE WHEN event_type = 'error' THEN named_struct('type', 'Boom', 'message', 'x') END, 'custom_user', user_id)) END"
    )
    df = L.parse_logs(t.events.selectExpr("event_id", f"{line} AS value"))
    return df.select(
        "event_id",
        "level",
        F.col("exception.type").alias("exception_type"),
        F.col("custom")["user"].alias("custom_user"),
        F.when(F.col("_corrupt_record").isNull(), F.size("custom")).alias("n_custom"),
        F.col("_corrupt_record").isNotNull().alias("corrupt"),
    )


@query(
    "snk1_write_report",
    f"""WITH {cte('order_job')} SELECT preset, status, count(*) AS n_items, CAST(sum(bytes_in) AS BIGINT) AS bytes_in, '2024-01-31' AS run_date
    FROM order_job GROUP BY preset, status""",
)
def snk1(t):
    report = rows(t, "order_job").groupBy("preset", "status").agg(F.count(F.lit(1)).alias("n_items"), F.sum("bytes_in").alias("bytes_in"))
    path = scratch_dir(t.spark, "report")
    S.write_report(report, path, "2024-01-31")
    return t.spark.read.parquet(path).withColumn("run_date", F.col("run_date").cast("string"))


@query(
    "snk2_export_monitoring",
    f"""WITH {cte('metric')}, n AS (SELECT host, event_id, failed, mem_pct, (row_number() OVER (PARTITION BY host ORDER BY ts, event_id) - 1) AS n FROM metric)
    SELECT host, CAST(n // 25 AS BIGINT) AS part, CAST(to_json(list({{'event_id': event_id, 'failed': failed, 'mem_pct': mem_pct}} ORDER BY n)) AS VARCHAR) AS document
    FROM n GROUP BY host, n // 25""",
)
def snk2(t):
    return S.monitoring_documents(rows(t, "metric"), "host", ["ts", "event_id"], ["event_id", "failed", "mem_pct"], page=25)


@query(
    "snk3_write_segments",
    f"""WITH {SEGMENT_CTE} SELECT CASE WHEN segment_idx % 2 = 0 THEN 'A' ELSE 'B' END AS store, segment_idx, count(*) AS n, CAST(sum(frames) AS BIGINT) AS frames
    FROM seg GROUP BY segment_idx""",
)
def snk3(t):
    path = scratch_dir(t.spark, "segments")
    S.write_segments(segments(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("store", "segment_idx").agg(F.count(F.lit(1)).alias("n"), F.sum("frames").alias("frames"))


# Segments -----------------------------------------------------------------------------------------


@query(
    "set1_plan_segments",
    f"""WITH {cte('order_job')}, e AS (SELECT job_id, total_frames, unnest(range((total_frames + 7499) // 7500)) AS segment_idx FROM order_job WHERE total_frames > 0)
    SELECT job_id, segment_idx, segment_idx * 7500 AS start, least(segment_idx * 7500 + 7499, total_frames - 1) AS "end" FROM e""",
)
def set1(t):
    return J.plan_segments(rows(t, "order_job"), "total_frames", 7500).select("job_id", "segment_idx", "start", "end")


@query(
    "set1_plan_time_segments",
    f"""WITH {cte('order_job')}, e AS (SELECT job_id, seconds, unnest(range(CAST(ceil(seconds / 60) AS BIGINT))) AS segment_idx FROM order_job WHERE seconds > 0)
    SELECT job_id, segment_idx, segment_idx * 60e0 AS start_s, {S6('least(60e0, seconds - segment_idx * 60e0)')} AS length_s FROM e""",
)
def set1_time(t):
    df = J.plan_time_segments(rows(t, "order_job"), "seconds", 60.0)
    return df.select("job_id", "segment_idx", "start_s", r6(F.col("length_s")).alias("length_s"))


@query(
    "jon1_pending_segments",
    f"""WITH {SEGMENT_CTE}, p AS (SELECT job_id, unnest(range(1, m + 1)) AS segment_idx FROM (SELECT job_id, max(segment_idx) AS m FROM seg GROUP BY job_id))
    SELECT job_id, CAST(segment_idx AS BIGINT) AS segment_idx FROM p
    WHERE NOT EXISTS (SELECT 1 FROM seg s WHERE s.job_id = p.job_id AND s.segment_idx = p.segment_idx AND s.processed AND s.status = 'completed')""",
)
def jon1(t):
    from footlamp.operators.validation import expected_frames

    seg = segments(t).withColumn("segment_idx", F.col("segment_idx").cast("bigint"))
    planned = expected_frames(seg, "job_id", "segment_idx")
    return J.pending_segments(planned, seg.where("processed AND status = 'completed'"))


@query(
    "jon2_skip_existing",
    f"""WITH {cte('file_inventory')} SELECT file_id, CASE WHEN file_id % 3 = 0 THEN 'skipped' ELSE 'pending' END AS status FROM file_inventory""",
)
def jon2(t):
    assets = rows(t, "file_inventory").withColumn("output_name", F.concat("path", F.lit(".out")))
    outputs = assets.where("file_id % 3 = 0").select("output_name")
    return J.skip_existing(assets, outputs).select("file_id", "status")


TIMELINE = "SELECT l_orderkey AS job_id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CAST(floor(l_extendedprice / 5) AS BIGINT) AS frame_no FROM lineitem"


@query(
    "jon8_segments_to_timeline",
    f"""WITH {cte('order_job')}, f AS ({TIMELINE}), s AS (SELECT job_id, total_frames, unnest(range((total_frames + 2999) // 3000)) AS segment_idx FROM order_job),
    r AS (SELECT job_id, segment_idx, segment_idx * 3000 AS start, least(segment_idx * 3000 + 2999, total_frames - 1) AS "end" FROM s)
    SELECT f.job_id, line, part, supp, frame_no, segment_idx, start, "end" FROM f JOIN r ON f.job_id = r.job_id AND f.frame_no BETWEEN r.start AND r."end" """,
)
def jon8(t):
    frames = t.lineitem.selectExpr(
        "l_orderkey AS job_id", "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supp", "CAST(floor(l_extendedprice / 5) AS BIGINT) AS frame_no"
    )
    return J.segments_to_timeline(frames, rows(t, "order_job"), 3000, "total_frames")


def two_runs(t):
    seg = segments(t).select("job_id", "segment_idx", "frames", "status", "processed")
    return seg.where("frames < 35").drop("processed"), seg.where("processed").drop("processed")


RUNS = f"""{SEGMENT_CTE}, a AS (SELECT * FROM seg WHERE frames < 35), b AS (SELECT * FROM seg WHERE processed)"""


@query(
    "set2_combine_runs",
    f"""WITH {RUNS} SELECT job_id, segment_idx, 1 AS run, frames, status FROM a
    UNION ALL SELECT job_id, segment_idx, 2, frames, status FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.job_id = b.job_id AND a.segment_idx = b.segment_idx)""",
)
def set2(t):
    return J.combine_runs(*two_runs(t))


@query(
    "set2_compare_runs",
    f"""WITH {RUNS} SELECT job_id, segment_idx, CASE WHEN frames < 35 AND processed THEN 'both' WHEN processed THEN 'second' ELSE 'first' END AS side
    FROM seg WHERE frames < 35 OR processed""",
)
def set2_compare(t):
    return J.compare_runs(*two_runs(t))


@query(
    "top2_merge_order",
    f"""WITH {SEGMENT_CTE}, g AS (SELECT *, sum(frames) OVER (PARTITION BY job_id ORDER BY segment_idx ROWS UNBOUNDED PRECEDING) AS e FROM seg WHERE status = 'completed'),
    o AS (SELECT o_orderkey AS job_id, CAST(floor(o_totalprice / 5000) AS BIGINT) AS audio_frames FROM orders)
    SELECT g.job_id, segment_idx, CAST(e - frames AS BIGINT) AS "offset", CAST(e AS BIGINT) AS "end", CAST(greatest(0, least(e, audio_frames) - (e - frames)) AS BIGINT) AS frames_kept
    FROM g JOIN o ON g.job_id = o.job_id""",
)
def top2(t):
    audio = t.orders.selectExpr("o_orderkey AS job_id", "CAST(floor(o_totalprice / 5000) AS BIGINT) AS audio_frames")
    return J.merge_order(segments(t), audio).select("job_id", "segment_idx", "offset", "end", "frames_kept")


# Progress -----------------------------------------------------------------------------------------


def stage_rows(t):
    df = rows(t, "stage_event")
    return df.select("*", F.col("step").alias("substage"), F.col("step").alias("ts"), (F.col("step") + 1.0).alias("substage_weight"))


@query(
    "agg3_progress",
    f"""WITH {cte('stage_event')}, s AS (SELECT job_id, stage, max(weight) AS weight,
      sum((CASE WHEN status IN ('skipped', 'completed') THEN 1e0 ELSE progress END) * (step + 1)) / sum(step + 1) AS p FROM stage_event GROUP BY job_id, stage)
    SELECT job_id, count(*) AS n_stages, {S6('sum(p * weight) / sum(weight)')} AS progress FROM s GROUP BY job_id""",
)
def agg3(t):
    return J.progress(stage_rows(t)).withColumn("progress", r6(F.col("progress")))


@query(
    "agg4_stage_status",
    f"""WITH {cte('stage_event')}, n AS (SELECT *, lead(stage) OVER (PARTITION BY job_id ORDER BY step) AS nx FROM stage_event),
    s AS (SELECT *, CASE WHEN status = 'in_progress' AND nx IS NOT NULL AND nx <> stage THEN 'completed' ELSE status END AS st FROM n)
    SELECT job_id, stage, count(*) AS n_events, CASE WHEN bool_and(st IN ('completed', 'skipped')) THEN 'completed' WHEN bool_or(st = 'failed') THEN 'failed'
      WHEN bool_or(st = 'in_progress') THEN 'in_progress' ELSE 'not_started' END AS status FROM s GROUP BY job_id, stage""",
)
def agg4(t):
    return J.stage_status(stage_rows(t))


@query(
    "agg5_eta_speed",
    f"""WITH {SEGMENT_CTE}, p AS (SELECT job_id, sum(frames) AS total, coalesce(sum(frames) FILTER (WHERE processed), 0) AS items,
      coalesce(sum(seconds) FILTER (WHERE processed), 0e0) AS el FROM seg GROUP BY job_id), q AS (SELECT *, items::DOUBLE / total AS share FROM p)
    SELECT job_id, CAST(items AS BIGINT) AS items, {S6('el')} AS elapsed_s, {S6('share')} AS progress,
      {S6('CASE WHEN share > 0 AND share < 1 THEN el / share - el ELSE 0 END')} AS eta_s, {S6('CASE WHEN el > 0 THEN items / el ELSE 0 END')} AS speed FROM q""",
)
def agg5(t):
    df = J.eta_speed(segments(t))
    return df.select("job_id", "items", *[r6(F.col(c)).alias(c) for c in ("elapsed_s", "progress", "eta_s", "speed")])


STAGE_RUN = """SELECT l_orderkey % 100 AS batch, CASE l_linenumber % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'upscale' WHEN 2 THEN 'audio' ELSE 'merge' END AS stage,
CAST(l_quantity AS BIGINT) AS frames, l_extendedprice / 1000 AS seconds FROM lineitem"""


@query(
    "agg6_stage_throughput",
    f"""WITH r AS ({STAGE_RUN}) SELECT batch, stage, CAST(sum(frames) AS BIGINT) AS frames, {S6('CAST(sum(CAST(seconds AS DECIMAL(18,6))) AS DOUBLE)')} AS seconds,
    CAST(grouping(batch, stage) AS BIGINT) AS level, {S6('CASE WHEN CAST(sum(CAST(seconds AS DECIMAL(18,6))) AS DOUBLE) > 0 THEN sum(frames) / CAST(sum(CAST(seconds AS DECIMAL(18,6))) AS DOUBLE) ELSE 0 END')} AS fps FROM r GROUP BY ROLLUP (batch, stage)""",
)
def agg6(t):
    runs = t.lineitem.selectExpr(*[c.strip() for c in (
        "l_orderkey % 100 AS batch",
        "CASE l_linenumber % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'upscale' WHEN 2 THEN 'audio' ELSE 'merge' END AS stage",
        "CAST(l_quantity AS BIGINT) AS frames", "l_extendedprice / 1000 AS seconds")])
    df = J.stage_throughput(runs)
    return df.select("batch", "stage", "frames", r6(F.col("seconds")).alias("seconds"), F.col("level").cast("bigint").alias("level"), r6(F.col("fps")).alias("fps"))


@query(
    "agg7_batch_report",
    f"""WITH {cte('order_job')} SELECT preset, status, count(*) AS n_items, count(*) FILTER (WHERE j.status = 'completed') AS n_completed,
      CAST(coalesce(sum(bytes_in) FILTER (WHERE j.status = 'completed'), 0) AS BIGINT) AS bytes_in,
      CAST(coalesce(sum(bytes_out) FILTER (WHERE j.status = 'completed'), 0) AS BIGINT) AS bytes_out,
      {S6("avg(seconds) FILTER (WHERE j.status = 'completed')")} AS avg_seconds, CAST(grouping(preset, status) AS BIGINT) AS level,
      {S6("count(*) FILTER (WHERE j.status = 'completed') * 100e0 / count(*)")} AS success_pct FROM order_job j GROUP BY CUBE (preset, status)""",
)
def agg7(t):
    df = J.batch_report(rows(t, "order_job"))
    return df.withColumn("avg_seconds", r6(F.col("avg_seconds"))).withColumn("success_pct", r6(F.col("success_pct"))).withColumn("level", F.col("level").cast("bigint"))


@query(
    "agg8_batch_outcome",
    f"""WITH {cte('order_job')}, r AS (SELECT preset AS operation, job_id, CASE WHEN status = 'failed' THEN 'failed' WHEN job_id % 7 = 0 THEN 'skipped' ELSE 'successful' END AS outcome FROM order_job),
    n AS (SELECT *, row_number() OVER (PARTITION BY operation, outcome ORDER BY job_id) - 1 AS n, count(*) OVER (PARTITION BY operation, outcome) AS n_total FROM r)
    SELECT operation, outcome, CAST(n // 100 AS BIGINT) AS page, string_agg(CAST(job_id AS VARCHAR), ',' ORDER BY job_id) AS item_ids, max(n_total) AS n_total FROM n GROUP BY operation, outcome, n // 100""",
)
def agg8(t):
    results = rows(t, "order_job").selectExpr("preset AS operation", "job_id AS item_id", "status", "CASE WHEN job_id % 7 <> 0 THEN 1 END AS result")
    return J.batch_outcome(results).withColumn("item_ids", F.array_join(F.col("item_ids").cast("array<string>"), ","))


@query(
    "agg10_test_report",
    f"""WITH {cte('order_job')}, r AS (SELECT preset AS suite, status = 'completed' OR bytes_in % 10 > 0 AS passed, seconds, bytes_in / 50e0 AS peak_mb, job_id % 5 AS key_test FROM order_job),
    g AS (SELECT suite, count(*) AS total, count(*) FILTER (WHERE passed) AS n_passed, sum(seconds) AS seconds, max(peak_mb) AS pk,
      coalesce(max(CASE WHEN key_test = 0 THEN CAST(passed AS INT) END), 0) + coalesce(max(CASE WHEN key_test = 1 THEN CAST(passed AS INT) END), 0)
      + coalesce(max(CASE WHEN key_test = 2 THEN CAST(passed AS INT) END), 0) AS k FROM r GROUP BY ROLLUP (suite))
    SELECT suite, total, n_passed, total - n_passed AS n_failed, {S6('n_passed * 100e0 / total')} AS rate, {S6('seconds')} AS seconds, n_passed * 100e0 / total > 95 AS stable,
      n_passed * 100e0 / total > 90 AS pass_rate_ok, pk < 6000 AS memory_ok, k >= 2 AS error_handling_ok FROM g""",
)
def agg10(t):
    results = rows(t, "order_job").selectExpr(
        "preset AS suite", "status = 'completed' OR bytes_in % 10 > 0 AS passed", "seconds", "bytes_in / 50e0 AS peak_mb", "job_id % 5 AS key_test"
    )
    df = J.test_report(results)
    return df.withColumn("rate", r6(F.col("rate"))).withColumn("seconds", r6(F.col("seconds")))


# Files --------------------------------------------------------------------------------------------


@query(
    "agg14_log_summary",
    f"""WITH {cte('file_inventory')}, e AS (SELECT *, {EXT} AS ext FROM file_inventory)
    SELECT volume, count(*) AS n_logs, {S6('sum(size_bytes) / 1048576e0')} AS total_mb FROM e WHERE ext = 'log' GROUP BY volume""",
)
def agg14(t):
    return FI.log_summary(rows(t, "file_inventory")).withColumn("total_mb", r6(F.col("total_mb")))


FOLDERS = f"""{cte('file_inventory')}, s AS (SELECT size_bytes, list_filter(string_split(path, '/'), lambda p: p <> '') AS parts FROM file_inventory),
e AS (SELECT size_bytes, parts, unnest(range(1, len(parts))) AS depth FROM s),
fol AS (SELECT concat('/', array_to_string(parts[1:depth], '/')) AS folder, CAST(depth AS INT) AS depth, count(*) AS n_files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM e GROUP BY ALL)"""


@query("agg15_folder_sizes", f"WITH {FOLDERS} SELECT folder, depth, n_files, bytes FROM fol")
def agg15(t):
    return FI.folder_sizes(rows(t, "file_inventory"))


@query(
    "agg16_cleanup_summary",
    f"""WITH {cte('file_inventory')}, e AS (SELECT *, {EXT} AS ext FROM file_inventory), v AS (SELECT volume, count(*) % 35 + 65e0 AS usage_pct FROM file_inventory GROUP BY volume),
    f AS (SELECT volume, size_bytes, ext IN ('log', 'txt') AS junk, ext NOT IN ('log', 'txt') AND size_bytes > 94 * 1048576e0 AS mov FROM e),
    g AS (SELECT volume, coalesce(sum(size_bytes) FILTER (WHERE junk), 0) / 1073741824e0 AS r, coalesce(sum(size_bytes) FILTER (WHERE mov), 0) / 1073741824e0 AS m,
      count(*) FILTER (WHERE junk) AS n_deletable, count(*) FILTER (WHERE mov) AS n_movable FROM f GROUP BY volume)
    SELECT g.volume, {S6('r')} AS reclaimable_gb, {S6('m')} AS movable_gb, n_deletable, n_movable, usage_pct,
      CASE WHEN usage_pct > 90 THEN 'urgent' WHEN usage_pct > 80 THEN 'high' WHEN usage_pct > 70 THEN 'medium' ELSE 'low' END AS urgency FROM g JOIN v ON g.volume = v.volume""",
)
def agg16(t):
    files = rows(t, "file_inventory")
    volumes = files.groupBy("volume").agg((F.count(F.lit(1)) % 35 + 65.0).alias("usage_pct"))
    df = FI.cleanup_summary(files, volumes)
    return df.withColumn("reclaimable_gb", r6(F.col("reclaimable_gb"))).withColumn("movable_gb", r6(F.col("movable_gb")))


@query("win9_log_retention", f"WITH {cte('file_inventory')} SELECT file_id, path FROM file_inventory WHERE {EXT} = 'log' AND age_days > 30")
def win9(t):
    return FI.old_logs(rows(t, "file_inventory")).select("file_id", "path")


@query("top1_largest_programs", f"WITH {FOLDERS} SELECT folder, depth, n_files, bytes FROM fol WHERE depth = 3 AND bytes > 500 * 1048576 ORDER BY bytes DESC, folder LIMIT 10")
def top1(t):
    return FI.largest_folders(FI.folder_sizes(rows(t, "file_inventory")).where("depth = 3"))
