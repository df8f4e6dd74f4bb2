"""Adapters from the given tables to the data model.

Row-wise adapters are stated once as expression text that Spark and DuckDB both accept, so a query and
its check start from the same rows. Ordered adapters (frames, samples) have a Spark form that never
sorts a whole recording in one task and a plain SQL form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.catalog.registry import Tables
from footlamp.plans.ordered import number_rows

ROWWISE: dict[str, tuple[str, dict[str, str]]] = {
    "media_asset": (
        "part",
        {
            "asset_id": "p_partkey",
            "width": "p_size * 80",
            "height": "p_size * 45",
            "duration_s": "p_retailprice",
            "fps": "CAST(25 AS DOUBLE)",
            "codec": "CASE p_type WHEN 'PROMO' THEN 'hevc' WHEN 'SMALL' THEN 'vp9' ELSE 'h264' END",
            "bitrate": "CAST(floor(p_retailprice * 10000 + 0.5) AS BIGINT)",
            "size_bytes": "CAST(floor(p_retailprice * 100000 + 0.5) AS BIGINT)",
            "path": "concat('/lib/', p_brand, '/', CAST(p_partkey AS STRING), "
            "CASE WHEN p_size % 10 = 0 THEN '.txt' ELSE '.mp4' END)",
            "venue": "CASE p_partkey % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END",
            "quality": "CASE p_size % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'high' END",
            "mem_mb": "2000 + (p_partkey % 10) * 900",
            "lighting": "CASE p_size % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'natural' ELSE 'mixed' END",
            "complexity": "CASE p_partkey % 4 WHEN 0 THEN 'complex' WHEN 1 THEN 'simple' ELSE 'moderate' END",
        },
    ),
    "output_asset": (
        "part",
        {
            "asset_id": "p_partkey",
            "width": "CASE WHEN p_size % 4 = 0 THEN 3840 ELSE p_size * 160 END",
            "height": "CASE WHEN p_size % 4 = 0 THEN 2160 ELSE p_size * 90 END",
            "duration_s": "p_retailprice * (1 + (p_partkey % 9 - 4) / 400e0)",
            "audio_duration_s": "p_retailprice * (1 + (p_partkey % 9 - 4) / 400e0) + (p_partkey % 5 - 2) * 0.07e0",
            "start_s": "(p_partkey % 3) * 0.02e0",
            "audio_start_s": "(p_partkey % 7) * 0.02e0",
            "has_video": "p_partkey % 17 <> 0",
            "has_audio": "p_partkey % 11 <> 0",
            "codec": "CASE p_type WHEN 'PROMO' THEN 'hevc' WHEN 'SMALL' THEN 'vp9' ELSE 'h264' END",
            "container": "CASE p_size % 5 WHEN 0 THEN 'mkv' WHEN 1 THEN 'avi' ELSE 'mov,mp4,m4a,3gp,3g2,mj2' END",
            "audio_codec": "CASE p_partkey % 3 WHEN 0 THEN 'aac' WHEN 1 THEN 'mp3' ELSE 'opus' END",
            "audio_rate": "CASE p_size % 3 WHEN 0 THEN 48000 WHEN 1 THEN 44100 ELSE 22050 END",
            "audio_bitrate": "64000 * (1 + p_partkey % 4)",
            "channels": "CAST(p_partkey % 3 AS INT)",
            "bitrate": "CAST(floor(p_retailprice * 10000 * (p_size % 8) + 0.5) AS BIGINT)",
            "size_bytes": "CASE WHEN p_partkey % 50 = 0 THEN CAST(p_size * 30 AS BIGINT) "
            "ELSE CAST(floor(p_retailprice * 3000 * p_size + 0.5) AS BIGINT) * 5 END",
            "frame_count": "CAST(floor(p_retailprice) AS BIGINT) * 25",
        },
    ),
    "file_inventory": (
        "part",
        {
            "file_id": "p_partkey",
            "path": "concat('/lib/', p_brand, '/', p_type, '/', CAST(p_partkey AS STRING), "
            "CASE p_size % 10 WHEN 0 THEN '.txt' WHEN 1 THEN '.mkv' WHEN 2 THEN '.log' "
            "WHEN 3 THEN '.mov' WHEN 4 THEN '.WMV' ELSE '.mp4' END)",
            "size_bytes": "CASE WHEN p_partkey % 50 = 0 THEN CAST(p_size * 10 AS BIGINT) "
            "WHEN p_partkey % 97 = 0 THEN CAST(p_size AS BIGINT) * 4294967296 "
            "ELSE CAST(floor(p_retailprice * 100000 + 0.5) AS BIGINT) END",
            "age_days": "CAST(p_size AS INT)",
            "volume": "p_brand",
        },
    ),
    "host": (
        "supplier",
        {
            "host_id": "s_suppkey",
            "os": "CASE s_suppkey % 9 WHEN 8 THEN 'Plan9' WHEN 7 THEN 'Darwin' WHEN 6 THEN 'Windows' ELSE 'Linux' END",
            "cores": "CAST(s_suppkey % 12 + 1 AS INT)",
            "ram_gb": "abs(s_acctbal) / 300",
            "gpu": "s_nationkey % 3 = 0",
            "cuda": "s_nationkey % 6 = 0",
            "gpu_gb": "CAST(s_suppkey % 11 AS DOUBLE)",
            "deps_found": "CAST(s_suppkey % 6 AS INT)",
            "version": "concat(CAST(s_suppkey % 4 + 3 AS STRING), '.', CAST(s_suppkey % 13 AS STRING), "
            "CASE WHEN s_suppkey % 2 = 0 THEN '.1' ELSE '' END)",
        },
    ),
    "metric": (
        "events",
        {
            "event_id": "event_id",
            "ts": "ts",
            "host": "user_id",
            "kind": "event_type",
            "cpu_pct": "least(100e0, value / 3)",
            "mem_pct": "CAST(get_json_object(props, '$.k') AS INT)",
            "failed": "event_type = 'error'",
            "duration_s": "value / 10",
            "value": "value",
        },
    ),
    "order_job": (
        "orders",
        {
            "job_id": "o_orderkey",
            "preset": "o_orderpriority",
            "owner": "o_custkey",
            "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END",
            "bytes_in": "CAST(floor(o_totalprice + 0.5) AS BIGINT)",
            "bytes_out": "CAST(floor(o_totalprice + 0.5) AS BIGINT) * 4",
            "total_frames": "CAST(floor(o_totalprice / 10) AS BIGINT)",
            "seconds": "o_totalprice / 1000",
            "ts": "o_orderdate",
        },
    ),
    "error_event": (
        "documents",
        {
            "error_id": "doc_id",
            "message": "text",
            "exception_type": "CASE doc_id % 6 WHEN 0 THEN 'MemoryError' WHEN 1 THEN 'ValueError' "
            "WHEN 2 THEN 'KeyError' WHEN 3 THEN 'ImportError' WHEN 4 THEN 'TimeoutError' ELSE 'OSError' END",
            "operation": "CASE WHEN doc_id % 4 = 0 THEN concat('ai_model/', source) ELSE source END",
            "stage": "lang",
            "progress": "(doc_id % 10) / 10e0",
        },
    ),
    "stage_event": (
        "conversations",
        {
            "job_id": "conv_id",
            "stage": "role",
            "step": "turn",
            "weight": "CASE role WHEN 'system' THEN 1e0 WHEN 'user' THEN 2e0 ELSE 12e0 END",
            "status": "CASE WHEN length(text) % 7 = 0 THEN 'failed' WHEN length(text) % 5 = 0 THEN 'skipped' "
            "WHEN length(text) % 3 = 0 THEN 'in_progress' ELSE 'completed' END",
            "progress": "(length(text) % 11) / 10e0",
        },
    ),
}


def rows(t: Tables, name: str) -> DataFrame:
    """Spark form of a row-wise adapter."""
    table, cols = ROWWISE[name]
    return getattr(t, table).selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def cte(name: str) -> str:
    """SQL form of a row-wise adapter, for use after WITH."""
    table, cols = ROWWISE[name]
    body = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    body = body.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')")
    return f"{name} AS (SELECT {body} FROM {table})"


# Frames -------------------------------------------------------------------------------------------

SIDE = 8
FRAME_CHUNK = 4096
LUMA = "greatest(0, least(255, floor((CAST(v AS DOUBLE) * 2 + 0.5e0) * 256)))"


def frames(t: Tables) -> DataFrame:
    """frame(asset_id, frame_no, w, h, luma): one packed row per frame."""
    numbered = number_rows(
        t.embeddings.select(F.col("label").alias("asset_id"), "vec_id", "embedding"),
        ["asset_id"],
        ["vec_id"],
        F.floor(F.col("vec_id") / FRAME_CHUNK).cast("bigint"),
        "frame_no",
    )
    return numbered.select(
        "asset_id",
        "frame_no",
        F.lit(SIDE).alias("w"),
        F.lit(SIDE).alias("h"),
        F.expr(f"transform(embedding, v -> CAST({LUMA} AS INT))").alias("luma"),
    )


# Positions are a running count: a filter on ``row_number() - 1`` loses rows in this DuckDB version.
FRAMES_CTE = (
    "frame_src AS (SELECT label AS asset_id, embedding, "
    "count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1 AS frame_no FROM embeddings)"
)
PX_CTE = (
    FRAMES_CTE
    + f""",
px AS (SELECT asset_id, frame_no, CAST((p - 1) // {SIDE} AS INT) AS y, CAST((p - 1) % {SIDE} AS INT) AS x,
       CAST({LUMA} AS INT) AS luma
       FROM (SELECT asset_id, frame_no, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p
             FROM frame_src))"""
)


def channels(luma: Column | str = "luma") -> dict[str, Column]:
    """Packed colour channels of the fixture, derived from luma."""
    c = F.col(luma) if isinstance(luma, str) else luma
    return {
        "b": c,
        "g": F.transform(c, lambda v: (v + 64) % 256),
        "r": F.transform(c, lambda v: (v * 3) % 256),
    }


# Audio --------------------------------------------------------------------------------------------

BLOCK_RATE = 8000
SAMPLE_RATE = 16


def audio_blocks(t: Tables) -> DataFrame:
    """audio_block(asset_id, hop, samples): one packed row per block of 64 samples."""
    numbered = number_rows(
        t.embeddings.select(F.col("label").alias("asset_id"), "vec_id", "embedding"),
        ["asset_id"],
        ["vec_id"],
        F.floor(F.col("vec_id") / FRAME_CHUNK).cast("bigint"),
        "hop",
    )
    return numbered.select("asset_id", "hop", F.col("embedding").cast("array<double>").alias("samples"))


BLOCK_CTE = """block AS (SELECT asset_id, hop, CAST(p - 1 AS INT) AS n, CAST(v AS DOUBLE) AS amp
FROM (SELECT label AS asset_id, count(*) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) - 1 AS hop,
      unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings))"""

# Spectrum of each block: periodic Hann window, 33 bins of 125 Hz.
SPECTRUM_CTE = (
    BLOCK_CTE
    + """,
basis AS (SELECT b.k AS bin, s.n AS n,
    cos(2 * pi() * b.k * s.n / 64e0) * (0.5e0 - 0.5e0 * cos(2 * pi() * s.n / 64e0)) AS c,
    -sin(2 * pi() * b.k * s.n / 64e0) * (0.5e0 - 0.5e0 * cos(2 * pi() * s.n / 64e0)) AS s
    FROM (SELECT unnest(range(33)) AS k) b, (SELECT unnest(range(64)) AS n) s),
spec AS (SELECT asset_id, hop, bin, bin * 125e0 AS freq, sum(amp * c) AS re, sum(amp * s) AS im,
    sqrt(sum(amp * c) * sum(amp * c) + sum(amp * s) * sum(amp * s)) AS mag
    FROM block JOIN basis USING (n) GROUP BY asset_id, hop, bin)"""
)


def audio_samples(t: Tables) -> DataFrame:
    """audio_sample(asset_id, ch, n, amp) at SAMPLE_RATE."""
    src = t.events.select(
        F.col("user_id").alias("asset_id"),
        (F.col("event_id") % 2).cast("int").alias("ch"),
        "ts",
        "event_id",
        F.expr("greatest(-1e0, least(1e0, (value - 100) / 330))").alias("amp"),
    )
    numbered = number_rows(src, ["asset_id", "ch"], ["ts", "event_id"], None, "n")
    return numbered.select("asset_id", "ch", "n", "amp")


SAMPLE_CTE = """smp AS (SELECT user_id AS asset_id, CAST(event_id % 2 AS INT) AS ch,
count(*) OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS n,
greatest(-1e0, least(1e0, (value - 100) / 330)) AS amp FROM events)"""


# Jobs ---------------------------------------------------------------------------------------------

SEGMENT_COLS = {
    "frames": "CAST(l_quantity AS INT)",
    "status": "CASE l_returnflag WHEN 'A' THEN 'failed' WHEN 'R' THEN 'skipped' ELSE 'completed' END",
    "processed": "l_linestatus = 'F'",
    "seconds": "l_extendedprice / 1000",
    "ts": "l_shipdate",
}


def segments(t: Tables) -> DataFrame:
    """segment(job_id, segment_idx, ...): one row per (order, line), smallest part and supplier wins."""
    cols = ", ".join(f"'{c}', {e}" for c, e in SEGMENT_COLS.items())
    best = t.lineitem.groupBy(
        F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("segment_idx")
    ).agg(F.expr(f"min_by(named_struct({cols}), struct(l_partkey, l_suppkey))").alias("s"))
    return best.select("job_id", "segment_idx", "s.*")


SEGMENT_CTE = (
    "seg AS (SELECT l_orderkey AS job_id, l_linenumber AS segment_idx, "
    + ", ".join(f"{e} AS {c}" for c, e in SEGMENT_COLS.items())
    + " FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1)"
)
