"""Queries: telemetry windows, checkpoints, sessions, errors and recovery."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import cte, rows
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.scalars import r6
from footlamp.operators import errors as E
from footlamp.operators import telemetry as T

METRIC = cte("metric")


@query(
    "win1_checkpoint_latest",
    f"""WITH {METRIC} SELECT event_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) - 1 AS BIGINT) AS rank
    FROM metric WHERE kind = 'view' AND mem_pct % 10 <> 0""",
)
def win1(t):
    valid = rows(t, "metric").where("kind = 'view' AND mem_pct % 10 <> 0")
    return T.newest_first(valid).select("event_id", "host", "rank")


@query(
    "win2_checkpoint_retention",
    f"""WITH {METRIC}, r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ts DESC, event_id DESC) - 1 AS rank FROM metric WHERE kind = 'view')
    SELECT event_id, host, CAST(rank AS BIGINT) AS rank, CASE WHEN rank >= 10 THEN 'count' WHEN ts < TIMESTAMP '2024-02-08 00:00:00' - INTERVAL 30 DAYS THEN 'age' END AS reason,
      rank >= 10 OR ts < TIMESTAMP '2024-02-08 00:00:00' - INTERVAL 30 DAYS AS "delete" FROM r""",
)
def win2(t):
    now = F.expr("timestamp_ntz'2024-02-08 00:00:00'")
    df = T.checkpoint_retention(rows(t, "metric").where("kind = 'view'"), now)
    return df.select("event_id", "host", "rank", "reason", "delete")


CKPT = "{'event_id': event_id, 'host': host, 'kind': kind, 'mem_pct': mem_pct}"


@query(
    "win3_checkpoint_integrity",
    f"""WITH {METRIC}, h AS (SELECT *, sha256(CAST(to_json({CKPT}) AS VARCHAR)) AS hash FROM metric WHERE kind = 'view')
    SELECT event_id, hash, event_id % 10 <> 0 AS record_ok, event_id % 10 <> 0 AND (event_id % 4 = 0 OR host % 7 <> 3) AS intact FROM h""",
)
def win3(t):
    c = rows(t, "metric").where("kind = 'view'").withColumn("hash", T.checkpoint_hash())
    c = (
        c.withColumn("integrity_hash", F.when(F.expr("event_id % 10 = 0"), F.lit("tampered")).otherwise(F.col("hash")))
        .withColumn("input_hash", F.sha2(F.col("host").cast("string"), 256))
        .withColumn(
            "input_hash_now",
            F.when(F.expr("event_id % 4 <> 0"), F.sha2(F.expr("CAST(CASE WHEN host % 7 = 3 THEN -1 ELSE host END AS STRING)"), 256)),
        )
    )
    return T.checkpoint_integrity(c).select("event_id", "hash", "record_ok", "intact")


LOAD = "gpu_pct AS (SELECT *, CASE WHEN host % 2 = 0 THEN value / 4 END AS gpu, value * 1.5e0 AS disk FROM metric)"


@query(
    "win4_bottleneck_last_n",
    f"""WITH {METRIC}, {LOAD}, w AS (SELECT event_id, host, row_number() OVER o AS rn, avg(cpu_pct) OVER l AS c, avg(mem_pct) OVER l AS m, avg(gpu) OVER l AS g, avg(disk) OVER l AS d
      FROM gpu_pct WINDOW o AS (PARTITION BY host ORDER BY ts, event_id), l AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, host, CASE WHEN rn >= 5 THEN 'analysed' ELSE 'insufficient_data' END AS status, CASE WHEN rn >= 5 THEN array_to_string(list_filter([
      CASE WHEN c > 90 THEN 'cpu_high' WHEN c < 20 THEN 'cpu_low' END, CASE WHEN m > 85 THEN 'memory_high' WHEN m < 30 THEN 'memory_low' END,
      CASE WHEN g > 95 THEN 'gpu_high' WHEN g < 15 THEN 'gpu_low' END, CASE WHEN d > 100 THEN 'disk_io' END], lambda c: c IS NOT NULL), ',') END AS bottlenecks,
      {S6('CASE WHEN rn >= 5 THEN c END')} AS avg_cpu FROM w""",
)
def win4(t):
    m = rows(t, "metric").selectExpr("*", "CASE WHEN host % 2 = 0 THEN value / 4 END AS gpu_pct", "value * 1.5e0 AS disk_mb_s")
    return T.bottleneck_last_n(m).withColumn("avg_cpu", r6(F.col("avg_cpu")))


@query(
    "win5_io_rate",
    f"""WITH {METRIC}, l AS (SELECT event_id, host, event_id * 1000003 AS b, lag(event_id * 1000003) OVER w AS pb, epoch_us(ts) AS us, lag(epoch_us(ts)) OVER w AS pus
      FROM metric WINDOW w AS (PARTITION BY host ORDER BY ts, event_id))
    SELECT event_id, host, {S6('coalesce(CASE WHEN us > pus THEN (b - pb) / ((us - pus) / 1e6) / 1048576e0 ELSE 0 END, 0)')} AS mb_per_s FROM l""",
)
def win5(t):
    c = rows(t, "metric").withColumn("bytes", F.col("event_id") * 1000003)
    return T.io_rate(c).withColumn("mb_per_s", r6(F.col("mb_per_s")))


@query(
    "win6_adaptive_multiplier",
    f"""WITH {METRIC}, s AS (SELECT event_id, ts, host, cpu_pct * 2.5e0 AS cpu_pct, mem_pct, CASE WHEN failed THEN 0e0 ELSE (cpu_pct * 2.5e0 + mem_pct) / 2 / greatest(duration_s, 0.1e0) END AS eff FROM metric),
    w AS (SELECT *, row_number() OVER o AS rn, avg(eff) OVER r AS ra, avg(eff) OVER l AS la, avg(cpu_pct) OVER l AS lc, avg(mem_pct) OVER l AS lm FROM s
      WINDOW o AS (PARTITION BY host ORDER BY ts, event_id), r AS (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
        l AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
    c AS (SELECT event_id, host, eff, sum(CASE WHEN rn >= 5 AND la < ra * 0.9e0 AND lc > 90 THEN 1 ELSE 0 END) OVER k AS nt,
      sum(CASE WHEN rn >= 5 AND la < ra * 0.9e0 AND lm > 85 THEN 1 ELSE 0 END) OVER k AS nm FROM w WINDOW k AS (PARTITION BY host ORDER BY rn ROWS UNBOUNDED PRECEDING))
    SELECT event_id, host, {S6('eff')} AS efficiency, {S6('greatest(0.5e0, pow(0.9e0, nt))')} AS thread_multiplier, {S6('greatest(0.5e0, pow(0.9e0, nm))')} AS memory_multiplier FROM c""",
)
def win6(t):
    work = rows(t, "metric").withColumn("cpu_pct", F.col("cpu_pct") * 2.5)
    df = T.adaptive_multiplier(work)
    return df.select("event_id", "host", *[r6(F.col(c)).alias(c) for c in ("efficiency", "thread_multiplier", "memory_multiplier")])


@query(
    "win7_utilisation_stats",
    f"""WITH {METRIC} SELECT event_id, host, {S6('cpu_pct')} AS cpu_now, {S6('min(cpu_pct) OVER w')} AS cpu_min, {S6('max(cpu_pct) OVER w')} AS cpu_max, {S6('avg(cpu_pct) OVER w')} AS cpu_avg,
      min(mem_pct) OVER w AS mem_min, max(mem_pct) OVER w AS mem_max, {S6('avg(mem_pct) OVER w')} AS mem_avg, count(*) OVER w AS n_samples
    FROM metric WINDOW w AS (PARTITION BY host ORDER BY ts RANGE BETWEEN INTERVAL 1440 MINUTE PRECEDING AND CURRENT ROW)""",
)
def win7(t):
    df = T.utilisation_stats(rows(t, "metric"), minutes=1440)
    return df.select(
        "event_id", "host", r6(F.col("cpu_pct")).alias("cpu_now"), r6(F.col("cpu_pct_min")).alias("cpu_min"), r6(F.col("cpu_pct_max")).alias("cpu_max"),
        r6(F.col("cpu_pct_avg")).alias("cpu_avg"), F.col("mem_pct_min").alias("mem_min"), F.col("mem_pct_max").alias("mem_max"), r6(F.col("mem_pct_avg")).alias("mem_avg"), "n_samples",
    )


KIND = "CASE event_type WHEN 'click' THEN 'operation' WHEN 'view' THEN 'performance' WHEN 'error' THEN 'error' ELSE 'other' END"


@query(
    "win8_recent_activity",
    f"""WITH l AS (SELECT event_id, ts, {KIND} AS kind FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY kind) AS n_total FROM l)
    SELECT kind, event_id, n_total FROM r WHERE (kind IN ('operation', 'performance') AND rn <= 10) OR (kind = 'error' AND rn <= 5)""",
)
def win8(t):
    return T.recent_activity(t.events.selectExpr("event_id", "ts", f"{KIND} AS kind"))


@query(
    "agg9_perf_report",
    f"""WITH {METRIC}, {LOAD} SELECT host, count(*) AS n_samples, {S6('avg(cpu_pct)')} AS avg_cpu, {S6('max(cpu_pct)')} AS peak_cpu, {S6('avg(mem_pct)')} AS avg_mem,
      max(mem_pct)::DOUBLE AS peak_mem, {S6('avg(gpu)')} AS avg_gpu, {S6('max(gpu)')} AS peak_gpu, {S6('count(*) / sum(duration_s)')} AS fps,
      {S6('(count(*) / sum(duration_s) / 2.4e0 - 1) * 100')} AS improvement_pct FROM gpu_pct GROUP BY ROLLUP (host)""",
)
def agg9(t):
    df = T.perf_report(rows(t, "metric").selectExpr("*", "CASE WHEN host % 2 = 0 THEN value / 4 END AS gpu_pct"))
    cols = ("avg_cpu", "peak_cpu", "avg_mem", "avg_gpu", "peak_gpu", "fps", "improvement_pct")
    return df.select("host", "n_samples", "peak_mem", *[r6(F.col(c)).alias(c) for c in cols])


@query(
    "win4_bottleneck_recent",
    f"""WITH {METRIC}, w AS (SELECT event_id, host, row_number() OVER o AS rn, avg(cpu_pct) OVER l AS c, avg(mem_pct) OVER l AS m, avg(value * 0.5e0) OVER l AS rd, avg(value * 1.5e0) OVER l AS wr
      FROM metric WINDOW o AS (PARTITION BY host ORDER BY ts, event_id), l AS (PARTITION BY host ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT event_id, host, CASE WHEN rn >= 10 THEN 'analysed' ELSE 'insufficient_data' END AS status, CASE WHEN rn >= 10 THEN array_to_string(list_filter([
      CASE WHEN c > 90 THEN 'cpu_high' WHEN c < 30 THEN 'cpu_low' END, CASE WHEN m > 85 THEN 'memory_high' END, CASE WHEN rd > 100 OR wr > 100 THEN 'disk_io_high' END],
      lambda c: c IS NOT NULL), ',') END AS bottlenecks,
      {S6('CASE WHEN rn >= 10 THEN c END')} AS avg_cpu, {S6('CASE WHEN rn >= 10 THEN wr END')} AS avg_write FROM w""",
)
def win4_recent(t):
    m = rows(t, "metric").selectExpr("*", "value * 0.5e0 AS read_mb_s", "value * 1.5e0 AS write_mb_s")
    df = T.bottleneck_recent(m)
    return df.select("event_id", "host", "status", "bottlenecks", r6(F.col("avg_cpu_pct")).alias("avg_cpu"), r6(F.col("avg_write_mb_s")).alias("avg_write"))


@query(
    "jon7_session_pairs",
    f"""WITH {METRIC}, s AS (SELECT *, sum(CASE WHEN kind = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY host ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM metric),
    o AS (SELECT host, n, event_id AS open_id, ts FROM s WHERE kind = 'signup'),
    c AS (SELECT host, n, event_id AS close_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY host, n ORDER BY ts, event_id) AS rn FROM s WHERE kind = 'purchase') WHERE rn = 1)
    SELECT coalesce(o.host, c.host) AS host, CAST(coalesce(o.n, c.n) AS BIGINT) AS session_no, open_id, close_id, {S6('(epoch_us(c.ts) - epoch_us(o.ts)) / 1e6')} AS duration_s,
      open_id IS NOT NULL AND close_id IS NOT NULL AS success FROM o FULL JOIN c ON o.host = c.host AND o.n = c.n""",
)
def jon7(t):
    df = T.session_pairs(rows(t, "metric"), F.col("kind") == "signup", F.col("kind") == "purchase")
    return df.withColumn("duration_s", r6(F.col("duration_s")))


CKPT_EVENTS = """ev AS (SELECT event_id, ts, user_id AS input, CASE event_type WHEN 'view' THEN 'checkpoint' WHEN 'error' THEN 'error' END AS kind,
CAST(json_extract_string(props, '$.k') AS INT) % 10 <> 0 AS intact FROM events WHERE event_type IN ('view', 'error'))"""


def checkpoint_events(t):
    return t.events.where("event_type IN ('view', 'error')").selectExpr(
        "event_id", "ts", "user_id AS input", "CASE event_type WHEN 'view' THEN 'checkpoint' ELSE 'error' END AS kind",
        "CAST(get_json_object(props, '$.k') AS INT) % 10 <> 0 AS intact",
    )


@query(
    "jon6_restore_point",
    f"""WITH {CKPT_EVENTS}, c AS (SELECT * FROM ev WHERE kind = 'checkpoint'), e AS (SELECT * FROM ev WHERE kind = 'error')
    SELECT e.event_id, e.input, c.event_id AS newest_checkpoint, CASE WHEN c.intact THEN c.event_id END AS restore_from
    FROM e ASOF LEFT JOIN c ON e.input = c.input AND e.ts >= c.ts""",
)
def jon6(t):
    return E.restore_point(checkpoint_events(t))


@query(
    "jon6_newest_checkpoint",
    f"""WITH {CKPT_EVENTS} SELECT input, event_id, intact AS usable FROM ev WHERE kind = 'checkpoint'
    QUALIFY row_number() OVER (PARTITION BY input ORDER BY ts DESC, event_id DESC) = 1""",
)
def jon6_newest(t):
    return E.newest_checkpoint(checkpoint_events(t))


# Errors -------------------------------------------------------------------------------------------

# Rules with words that occur in the given texts.
RULES = [
    E.Rule(("MemoryError",), ("the", "aux"), "system", "high"),
    E.Rule(("ValueError",), ("ing", "ment"), "processing", "medium"),
    E.Rule(("KeyError",), ("eau", "tion", "und"), "configuration", "medium"),
    E.Rule(("ImportError", "ValueError"), ("en",), "dependency", "high"),
    E.Rule(("TimeoutError",), ("ere", "que"), "network", "medium"),
    E.Rule(("OSError", "IOError"), ("qu", "sch"), "input", "medium"),
]


def rules_sql() -> str:
    parts = []
    for r in RULES:
        types = ", ".join(f"'{x}'" for x in r.types)
        words = " OR ".join(f"contains(lower(message), '{w}')" for w in r.keywords)
        parts.append(f"WHEN exception_type IN ({types}) AND ({words}) THEN '{r.category}/{r.severity}'")
    return "CASE " + " ".join(parts) + " ELSE 'unknown/medium' END"


CLASSIFIED = f"{cte('error_event')}, cls AS (SELECT *, string_split(k, '/')[1] AS category, string_split(k, '/')[2] AS severity FROM (SELECT *, {rules_sql()} AS k FROM error_event))"
STRATEGY = """str AS (SELECT *, CASE k WHEN 'system/high' THEN 'restore_checkpoint' WHEN 'system/medium' THEN 'retry' WHEN 'input/medium' THEN 'user_intervention'
    WHEN 'processing/medium' THEN 'fallback' WHEN 'network/medium' THEN 'retry' WHEN 'dependency/high' THEN 'user_intervention' WHEN 'configuration/medium' THEN 'fallback'
    ELSE 'user_intervention' END AS primary_action,
  CASE k WHEN 'system/high' THEN ['fallback', 'abort'] WHEN 'system/medium' THEN ['fallback'] WHEN 'input/medium' THEN ['skip'] WHEN 'processing/medium' THEN ['retry', 'skip']
    WHEN 'network/medium' THEN ['skip'] WHEN 'dependency/high' THEN ['abort'] WHEN 'configuration/medium' THEN ['user_intervention'] ELSE [] END AS fb,
  CASE k WHEN 'system/medium' THEN 2 WHEN 'processing/medium' THEN 3 WHEN 'network/medium' THEN 5 WHEN 'configuration/medium' THEN 2 ELSE 1 END AS max_retries FROM cls),
rec AS (SELECT error_id, category, severity, primary_action, max_retries, list_concat(
    CASE WHEN contains(lower(operation), 'ai_model') AND primary_action = 'retry' THEN ['fallback'] ELSE [] END,
    list_concat(CASE WHEN k <> 'unknown/medium' AND progress > 0.8e0 AND primary_action <> 'restore_checkpoint' THEN ['restore_checkpoint'] ELSE [] END, fb)) AS fallbacks FROM str)"""


@query("jon3_classify_errors", f"WITH {CLASSIFIED} SELECT error_id, category, severity FROM cls")
def jon3(t):
    return E.classify_errors(rows(t, "error_event"), RULES).select("error_id", "category", "severity")


@query(
    "jon3_classify_by_keyword",
    f"""WITH {cte('error_event')} SELECT error_id, CASE WHEN regexp_matches(lower(message), 'config|setting|parameter|invalid') THEN 'configuration'
      WHEN regexp_matches(lower(message), 'memory|disk|space|resource|gpu|cuda') THEN 'resource' WHEN regexp_matches(lower(message), 'permission|access|network|connection') THEN 'system'
      WHEN regexp_matches(lower(message), 'process|encode|decode|frame|audio|video') THEN 'processing' ELSE 'system' END AS category,
      CASE WHEN regexp_matches(lower(message), 'config|setting|parameter|invalid') THEN 'high' WHEN regexp_matches(lower(message), 'memory|disk|space|resource|gpu|cuda') THEN 'medium'
      WHEN regexp_matches(lower(message), 'permission|access|network|connection|process|encode|decode|frame|audio|video') THEN 'high' ELSE 'medium' END AS severity FROM error_event""",
)
def jon3_keyword(t):
    return E.classify_by_keyword(rows(t, "error_event")).select("error_id", "category", "severity")


@query("jon4_recovery_strategy", f"WITH {CLASSIFIED}, {STRATEGY} SELECT error_id, primary_action, array_to_string(fallbacks, ',') AS fallbacks, max_retries FROM rec")
def jon4(t):
    df = E.recovery_strategy(E.classify_errors(rows(t, "error_event"), RULES))
    return df.select("error_id", "primary_action", F.array_join("fallbacks", ",").alias("fallbacks"), "max_retries")


OUTCOME_ACTIONS = ["retry", "fallback", "restore_checkpoint", "user_intervention"]


def resolved(t):
    planned = E.recovery_strategy(E.classify_errors(rows(t, "error_event"), RULES))
    outcomes = t.documents.select(
        F.col("doc_id").alias("error_id"), F.explode(F.array(*[F.lit(a) for a in OUTCOME_ACTIONS])).alias("action")
    ).withColumn("success", (F.col("error_id") + F.length("action")) % 3 == 0)
    return planned, E.resolve_errors(planned, outcomes)


RESOLVED = f"""{CLASSIFIED}, {STRATEGY}, act AS (SELECT error_id, unnest(list_prepend(primary_action, fallbacks)) AS action, generate_subscripts(list_prepend(primary_action, fallbacks), 1) AS pos FROM rec),
win AS (SELECT error_id, min(CASE WHEN action = 'skip' OR (action <> 'abort' AND (error_id + length(action)) % 3 = 0) THEN pos END) AS p FROM act GROUP BY error_id),
res AS (SELECT win.error_id, act.action AS resolution, p IS NOT NULL AS resolved, CAST(p AS INT) AS n_tried FROM win LEFT JOIN act ON act.error_id = win.error_id AND act.pos = win.p)"""


@query("jon5_resolve_errors", f"WITH {RESOLVED} SELECT error_id, resolution, resolved, n_tried FROM res")
def jon5(t):
    return resolved(t)[1]


@query(
    "agg11_error_stats",
    f"""WITH {RESOLVED}, j AS (SELECT cls.category, cls.severity, res.resolved FROM cls JOIN res ON cls.error_id = res.error_id)
    SELECT category, severity, count(*) AS n_errors, count(*) FILTER (WHERE resolved) AS n_recovered, count(*) FILTER (WHERE NOT resolved) AS n_failed,
      CAST(grouping(category, severity) AS BIGINT) AS level, round(count(*) FILTER (WHERE resolved) * 100e0 / count(*), 2) AS rate_pct FROM j GROUP BY GROUPING SETS ((category), (severity), ())""",
)
def agg11(t):
    planned, done = resolved(t)
    df = E.error_stats(planned.select("error_id", "category", "severity").join(done, "error_id"))
    return df.withColumn("level", F.col("level").cast("bigint"))


ATTEMPT_COLS = {
    "host": "user_id",
    "ts": "ts",
    "category": "CASE event_id % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'input' WHEN 2 THEN 'processing' ELSE 'network' END",
    "action": "CASE event_id % 3 WHEN 0 THEN 'retry' WHEN 1 THEN 'fallback' ELSE 'restore_checkpoint' END",
    "success": "event_id % 7 < 4",
    "duration_s": "value / 10",
}
SESSION_COLS = {
    "host": "user_id",
    "ts": "ts",
    "operation": "concat('op', CAST(user_id % 5 AS STRING))",
    "stage": "concat('st', CAST(event_id % 4 AS STRING))",
    "has_checkpoint": "event_id % 11 = 0",
    "outcome": "CASE WHEN event_id % 3 = 0 THEN 'resolved' ELSE 'failed' END",
}
ATT = "att AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in ATTEMPT_COLS.items()) + " FROM events WHERE event_type = 'error')"
SES = "ses AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in SESSION_COLS.items()) + " FROM events WHERE event_type = 'signup')"
SINCE_SQL = "TIMESTAMP '2024-01-11 00:00:00'"


def recovery_tables(t):
    a = t.events.where("event_type = 'error'").selectExpr(*[f"{e} AS {c}" for c, e in ATTEMPT_COLS.items()])
    s = t.events.where("event_type = 'signup'").selectExpr(*[f"{e} AS {c}" for c, e in SESSION_COLS.items()])
    return a, s, F.expr("timestamp_ntz'2024-01-11 00:00:00'")


@query(
    "agg12_recovery_metrics",
    f"""WITH {ATT}, {SES}, a AS (SELECT * FROM att WHERE ts >= {SINCE_SQL}), s AS (SELECT * FROM ses WHERE ts >= {SINCE_SQL}),
    x AS (SELECT (SELECT count(*) FROM s) AS te, (SELECT count(*) FROM a) AS ta)
    SELECT te AS total_errors, ta AS total_attempts, {S6('(SELECT avg(CAST(success AS INT)) FROM a)')} AS success_rate, {S6('ta / te')} AS attempts_per_error,
      {S6('(SELECT avg(duration_s) FROM a)')} AS avg_recovery_s, {S6('(SELECT avg(CAST(has_checkpoint AS INT)) FROM s)')} AS checkpoint_rate,
      (SELECT category FROM a GROUP BY category ORDER BY count(*) DESC, list_position(['system','input','processing','network'], category) LIMIT 1) AS most_common_category,
      (SELECT action FROM a GROUP BY action ORDER BY avg(CAST(success AS INT)) DESC, list_position(['retry','fallback','restore_checkpoint'], action) LIMIT 1) AS best_action,
      array_to_string(list_filter([CASE WHEN (SELECT avg(CAST(success AS INT)) FROM a) < 0.7e0 THEN 'review_strategies' END, CASE WHEN ta / te > 3 THEN 'too_many_attempts' END,
        CASE WHEN (SELECT avg(CAST(has_checkpoint AS INT)) FROM s) < 0.3e0 THEN 'use_checkpoints' END], lambda c: c IS NOT NULL), ',') AS advice FROM x""",
)
def agg12(t):
    df = E.recovery_advice(E.recovery_metrics(*recovery_tables(t)))
    nums = ["success_rate", "attempts_per_error", "avg_recovery_s", "checkpoint_rate"]
    return df.select(*[r6(F.col(c)).alias(c) if c in nums else F.col(c) for c in df.columns])


@query(
    "agg12_session_shares",
    f"""WITH {SES}, s AS (SELECT * FROM ses WHERE ts >= {SINCE_SQL})
    SELECT operation, stage, count(*) AS n, {S6('count(*) * 1e0 / (SELECT count(*) FROM s)')} AS share FROM s GROUP BY GROUPING SETS ((operation), (stage))""",
)
def agg12_shares(t):
    _, s, since = recovery_tables(t)
    return E.session_shares(s, since).withColumn("share", r6(F.col("share")))


@query(
    "agg13_recovery_report",
    f"""WITH {SES} SELECT concat(operation, ':', stage) AS pattern, count(*) AS n FROM ses WHERE ts >= {SINCE_SQL} AND outcome <> 'resolved'
    GROUP BY 1 ORDER BY n DESC, pattern LIMIT 10""",
)
def agg13(t):
    _, s, since = recovery_tables(t)
    return E.recovery_report(s, since)
