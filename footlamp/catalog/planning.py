"""Queries: planning rules (PLN1-4, PLN6-14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import cte, rows
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.catalog.validation import PRESET_COLS, preset_sql
from footlamp.functions.scalars import r6
from footlamp.operators import planning as P

TILE = "CASE quality WHEN 'fast' THEN 512 WHEN 'balanced' THEN 768 ELSE 1024 END"


def grid8(x: str) -> str:
    return f"least(1024, greatest(256, CAST(floor(({x}) / 8) * 8 AS BIGINT)))"


def shaped(src: str, side: str, out: str) -> str:
    """Tile width and height from a side length and the aspect ratio."""
    w = f"CASE WHEN width / height > 2 THEN trunc({side} * 1.2e0) WHEN width / height < 0.8e0 THEN trunc({side} * 0.8e0) ELSE {side} END"
    h = f"CASE WHEN width / height > 2 THEN trunc({side} * 0.8e0) WHEN width / height < 0.8e0 THEN trunc({side} * 1.2e0) ELSE {side} END"
    return f"{out} AS (SELECT *, {grid8(w)} AS tile_w, {grid8(h)} AS tile_h FROM {src})"


def tiles(src: str, mem: str) -> str:
    mb = "(tile_w::DOUBLE * tile_h * 24 / 1048576e0)"
    return f"""side AS (SELECT *, {TILE} AS side FROM {src}), {shaped('side', 'side', 'shp')},
    bat AS (SELECT *, least(64, greatest(32, tile_w // 16)) AS overlap,
      least(8, greatest(1, CAST(trunc(({mem} * 0.7e0 - 500) / {mb}) AS BIGINT))) AS batch FROM shp),
    til AS (SELECT *, CAST(trunc({mb} * batch + 500) AS BIGINT) AS tile_memory_mb FROM bat)"""


STRATEGY = f"""{tiles('media_asset', '4000')},
    strat AS (SELECT *, CASE WHEN width / height >= 16e0 / 9 - 0.1e0 THEN 3840 ELSE 2880 END AS target_w, 2160 AS target_h,
      (width * height >= 2073600 AND quality IN ('balanced', 'high')) OR width * height >= 8294400 AS use_gpu,
      greatest(CASE WHEN width * height >= 8294400 THEN CAST(trunc(2800 * 1.5e0) AS BIGINT)
        WHEN width * height <= 921600 THEN CAST(trunc(2800 * 0.7e0) AS BIGINT) ELSE 2800 END, tile_memory_mb + 1000) AS memory_limit_mb,
      CASE quality WHEN 'fast' THEN 0.5e0 WHEN 'balanced' THEN 0.7e0 ELSE 0.9e0 END AS denoise FROM til)"""


@query(
    "pln1_plan_strategy",
    f"""WITH {cte('media_asset')}, {STRATEGY} SELECT asset_id, tile_w, tile_h, overlap, batch, tile_memory_mb, target_w,
    target_h, use_gpu, memory_limit_mb, denoise FROM strat""",
)
def pln1(t):
    return P.plan_strategy(rows(t, "media_asset")).select(
        "asset_id", "tile_w", "tile_h", "overlap", "batch", "tile_memory_mb", "target_w", "target_h", "use_gpu",
        "memory_limit_mb", "denoise",
    )


@query(
    "pln2_plan_tiles",
    f"WITH {cte('media_asset')}, {tiles('media_asset', 'mem_mb')} SELECT asset_id, tile_w, tile_h, overlap, batch, tile_memory_mb FROM til",
)
def pln2(t):
    df = P.plan_tiles(rows(t, "media_asset"), F.col("mem_mb"))
    return df.select("asset_id", "tile_w", "tile_h", "overlap", "batch", "tile_memory_mb")


@query(
    "pln3_plan_adaptive",
    f"""WITH {cte('media_asset')}, a AS (SELECT *, CASE WHEN width * height >= 8294400 THEN 'high' WHEN width * height >= 2073600
      THEN CASE WHEN duration_s > 3600 THEN 'high' ELSE 'medium' END ELSE 'low' END AS complexity_level,
      {grid8(f"trunc({TILE} * (CASE WHEN width >= 3840 THEN 1.2e0 WHEN width >= 1920 THEN 1e0 ELSE 0.8e0 END) * (CASE WHEN mem_mb < 4000 THEN 0.8e0 WHEN mem_mb > 8000 THEN 1.2e0 ELSE 1e0 END))")} AS side
      FROM media_asset), {shaped('a', 'side', 'b')},
    c AS (SELECT *, greatest(1, CAST(trunc((mem_mb * 0.7e0 - 1000) / (tile_w::DOUBLE * tile_h * 24 / 1048576e0)) AS BIGINT)) AS fit,
      width::DOUBLE * height * trunc(duration_s * fps) * CASE quality WHEN 'fast' THEN 1e0 WHEN 'balanced' THEN 1.5e0 ELSE 2e0 END AS load FROM b)
    SELECT asset_id, complexity_level, tile_w, tile_h,
      least(128, greatest(16, CAST(trunc(((tile_w + tile_h) // 2 // 16) * CASE complexity_level WHEN 'low' THEN 0.8e0 WHEN 'medium' THEN 1e0 ELSE 1.2e0 END) AS BIGINT))) AS overlap,
      least(8, greatest(1, CAST(trunc(fit * CASE quality WHEN 'fast' THEN 1.5e0 WHEN 'balanced' THEN 1e0 ELSE 0.8e0 END) AS BIGINT))) AS batch,
      greatest(2000, CAST(trunc(trunc(mem_mb * 0.7e0) * CASE WHEN width * height >= 8294400 THEN 1.3e0 WHEN width * height >= 2073600 THEN 1e0 ELSE 0.7e0 END) AS BIGINT)) AS memory_limit_mb,
      CAST(CASE WHEN width >= 3840 AND height >= 2160 THEN width WHEN width / height >= 16e0/9 - 0.1e0 THEN 3840 WHEN width / height >= 4e0/3 - 0.1e0 THEN 2880
        ELSE floor(trunc(2160 * (width / height)) / 2) * 2 END AS BIGINT) AS target_w,
      CAST(CASE WHEN width >= 3840 AND height >= 2160 THEN height ELSE 2160 END AS BIGINT) AS target_h,
      load, {S6('load / (2073600 * 30e0 * 3600)')} AS hours, NOT (width * height < 2073600 AND quality = 'fast') AS use_gpu FROM c""",
)
def pln3(t):
    return P.plan_adaptive(rows(t, "media_asset")).select(
        "asset_id", "complexity_level", "tile_w", "tile_h", "overlap", "batch", "memory_limit_mb", "target_w", "target_h",
        "load", r6(F.col("hours")).alias("hours"), "use_gpu",
    )


@query(
    "pln4_rescale_plan",
    f"""WITH {cte('media_asset')}, {tiles('media_asset', 'mem_mb')}, f AS (SELECT *,
      CASE quality WHEN 'fast' THEN 0.8e0 WHEN 'balanced' THEN 1e0 ELSE 1.2e0 END AS k,
      CASE quality WHEN 'fast' THEN 1.5e0 WHEN 'balanced' THEN 1e0 ELSE 0.8e0 END AS kb FROM til)
    SELECT asset_id, {grid8('trunc(tile_w * k)')} AS tile_w, {grid8('trunc(tile_h * k)')} AS tile_h,
      least(128, greatest(16, CAST(trunc(overlap * k) AS BIGINT))) AS overlap, least(16, greatest(1, CAST(trunc(batch * kb) AS BIGINT))) AS batch,
      CASE quality WHEN 'fast' THEN 0.5e0 WHEN 'balanced' THEN 0.7e0 ELSE 0.9e0 END AS denoise FROM f""",
)
def pln4(t):
    plan = P.plan_tiles(rows(t, "media_asset"), F.col("mem_mb"))
    return P.rescale_plan(plan).select("asset_id", "tile_w", "tile_h", "overlap", "batch", "denoise")


@query(
    "pln6_estimate_cost",
    f"""WITH {cte('media_asset')}, a AS (SELECT *, CASE WHEN 3840e0 / width <= 1.5e0 THEN 1 WHEN 3840e0 / width <= 2.5e0 THEN 2
      WHEN 3840e0 / width <= 3.5e0 THEN 3 ELSE 4 END AS scale,
      CASE WHEN width * height > 2073600 THEN 400 WHEN width * height < 921600 THEN 640 ELSE 512 END AS base FROM media_asset),
    b AS (SELECT *, CASE complexity WHEN 'complex' THEN least(base, 400) WHEN 'simple' THEN least(base + 128, 640) ELSE base END AS tile FROM a)
    SELECT asset_id, scale, tile, CASE WHEN tile >= 512 THEN 1 WHEN tile >= 400 THEN 2 ELSE 4 END AS batch,
      CASE WHEN lighting = 'stage' THEN 2 ELSE 1 END AS denoise_level, width * height > 2073600 OR duration_s > 1800 AS memory_optimised,
      round(duration_s * 25 * (0.5e0 * (width * height / 2073600e0) * pow(scale, 1.5e0)
        * CASE complexity WHEN 'complex' THEN 1.3e0 WHEN 'simple' THEN 0.8e0 ELSE 1e0 END * (512e0 / tile)) / 3600, 1) AS hours,
      round(2e0 + width * height * 12 / 1073741824e0 + tile * tile * 24 / 1073741824e0, 1) AS memory_gb,
      round(size_bytes / 1073741824e0 * scale * scale * 1.2e0, 1) AS output_gb,
      CASE WHEN lighting = 'natural' AND complexity = 'simple' THEN 'fast_denoise' ELSE 'general_upscale' END AS tool FROM b""",
)
def pln6(t):
    return P.estimate_cost(rows(t, "media_asset"), F.col("size_bytes") / 1024.0**3).select(
        "asset_id", "scale", "tile", "batch", "denoise_level", "memory_optimised", "hours", "memory_gb", "output_gb", "tool"
    )


def step_sql(src: str, dst: str, when: str) -> str:
    done = "ow >= 3840 AND oh >= 2160"
    over = "ow * 2 > 3840 OR oh * 2 > 2160"
    return f"""{dst} AS (SELECT asset_id, width, height,
      CASE WHEN NOT ({when}) OR ({done}) THEN ow WHEN {over} THEN 3840 ELSE ow * 2 END AS ow,
      CASE WHEN NOT ({when}) OR ({done}) THEN oh WHEN {over} THEN 2160 ELSE oh * 2 END AS oh FROM {src})"""


@query(
    "pln7_upscale_path",
    f"""WITH {cte('media_asset')}, s0 AS (SELECT asset_id, width, height, width AS ow, height AS oh FROM media_asset),
    {step_sql('s0', 's1', 'true')}, {step_sql('s1', 's2', 'width <= 1920 AND height <= 1080')}
    SELECT asset_id, CAST(ow AS BIGINT) AS out_w, CAST(oh AS BIGINT) AS out_h FROM s2""",
)
def pln7(t):
    return P.upscale_path(rows(t, "media_asset"), P.resolution_plan()).select("asset_id", "out_w", "out_h")


@query(
    "pln8_plan_tiles_by_memory",
    f"""WITH {cte('media_asset')}, a AS (SELECT asset_id, width, height, mem_mb AS free_mb, (asset_id % 5) * 1500 AS gpu_mb,
      50 + (asset_id % 7) * 190 AS need FROM media_asset),
    b AS (SELECT *, CASE WHEN need > 800 THEN 'ai' WHEN need > 200 THEN 'video' ELSE 'audio' END AS profile,
      CAST(trunc(free_mb * 0.7e0) AS BIGINT) AS safe, CAST(trunc(gpu_mb * 0.7e0) AS BIGINT) AS safe_gpu FROM a),
    c AS (SELECT *, CASE WHEN safe_gpu >= need AND gpu_mb > 0 THEN 'gpu' ELSE 'cpu' END AS mode,
      CASE profile WHEN 'ai' THEN 500 WHEN 'video' THEN 200 ELSE 100 END AS base, CASE profile WHEN 'ai' THEN 50 WHEN 'video' THEN 20 ELSE 5 END AS pt,
      CASE profile WHEN 'ai' THEN 1000 WHEN 'video' THEN 500 ELSE 0 END AS g, CASE profile WHEN 'ai' THEN 2e0 WHEN 'video' THEN 1.5e0 ELSE 1.2e0 END AS tf FROM b),
    d AS (SELECT *, CASE WHEN mode = 'gpu' THEN pt ELSE pt * 2 END AS per_tile FROM c),
    e AS (SELECT *, greatest(CASE WHEN mode = 'gpu' THEN safe_gpu - g ELSE safe - base END, per_tile) AS for_tiles FROM d),
    f AS (SELECT *, greatest(1, for_tiles // per_tile) AS max_tiles FROM e),
    h AS (SELECT *, trunc(sqrt(width * height / max_tiles)) AS side, width / height AS asp FROM f),
    i AS (SELECT *, CAST(greatest(least(CASE WHEN asp > 1 THEN trunc(side * sqrt(asp)) ELSE trunc(side / sqrt(1 / asp)) END, width), 64) AS BIGINT) // 8 * 8 AS tile_w,
      CAST(greatest(least(CASE WHEN asp > 1 THEN trunc(side / sqrt(asp)) ELSE trunc(side * sqrt(1 / asp)) END, height), 64) AS BIGINT) // 8 * 8 AS tile_h FROM h),
    j AS (SELECT *, least(max_tiles, CASE WHEN tile_w * tile_h > 1048576 THEN 2 WHEN tile_w * tile_h > 262144 THEN 4 ELSE 8 END) AS batch FROM i)
    SELECT asset_id, profile, mode, CAST(max_tiles AS BIGINT) AS max_tiles, tile_w, tile_h, CAST(batch AS BIGINT) AS batch,
      CAST(least(128, greatest(16, trunc(least(tile_w, tile_h) * 0.05e0))) AS BIGINT) // 8 * 8 AS overlap,
      CAST(base + batch * per_tile + trunc(greatest(100, (width * height * 3) // 1048576 * 2) * tf) AS BIGINT) AS memory_mb FROM j""",
)
def pln8(t):
    a = rows(t, "media_asset").selectExpr(
        "asset_id", "width", "height", "mem_mb AS free_mb", "(asset_id % 5) * 1500 AS gpu_mb", "50 + (asset_id % 7) * 190 AS model_mb"
    )
    return P.plan_tiles_by_memory(a).select(
        "asset_id", "profile", "mode", "max_tiles", "tile_w", "tile_h", "batch", "overlap", "memory_mb"
    )


@query(
    "pln9_choose_model",
    """WITH a AS (SELECT p_partkey AS asset_id, (p_partkey % 13) * 100 AS free_mb, p_size % 2 = 0 AS has_gpu FROM part),
    m(priority, model, need_mb, on_gpu) AS (VALUES (0, 'real_esrgan_x4', 1000, true), (1, 'real_esrgan_x2', 800, true), (2, 'opencv_cubic', 50, false)),
    j AS (SELECT asset_id, model, row_number() OVER (PARTITION BY asset_id ORDER BY CASE WHEN has_gpu AND on_gpu THEN 0 ELSE 1 END, priority) AS rn
      FROM a JOIN m ON m.need_mb <= a.free_mb)
    SELECT a.asset_id, coalesce(model, 'opencv_cubic') AS model FROM a LEFT JOIN j ON a.asset_id = j.asset_id AND rn = 1""",
)
def pln9(t):
    a = t.part.selectExpr("p_partkey AS asset_id", "(p_partkey % 13) * 100 AS free_mb", "p_size % 2 = 0 AS has_gpu")
    return P.choose_model(a).select("asset_id", "model")


@query(
    "pln10_preset_matrix",
    f"""WITH {cte('media_asset')}, u AS (SELECT venue, quality, count(*) AS n_assets FROM media_asset GROUP BY venue, quality),
    v(venue, dist, rt, noise, boost, cut, vt) AS (VALUES ('small', 8e0, 1.2e0, 0.3e0, 6e0, 0.7e0, 0.8e0), ('medium', 15e0, 1.8e0, 0.4e0, 4e0, 0.5e0, 1e0),
      ('large', 25e0, 2.5e0, 0.5e0, 2e0, 0.3e0, 1.2e0)),
    q(quality, tile, bat, den, mem, tf) AS (VALUES ('fast', 512, 4, 0.5e0, 0.6e0, 1e0), ('balanced', 768, 2, 0.7e0, 0.7e0, 2e0), ('high', 1024, 1, 0.9e0, 0.8e0, 4e0))
    SELECT v.venue, q.quality, coalesce(n_assets, 0) AS n_assets, tile AS tile_size, bat AS batch, den AS denoise, mem AS memory_usage, boost AS dialogue_boost, cut AS noise_reduction,
      {S6('least(0.9e0, rt / 3)')} AS reverb_reduction, {S6('least(0.8e0, 0.3e0 + dist / 50)')} AS spatial, {S6('0.2e0 + noise * 0.3e0')} AS compression,
      CAST((tile * tile * 12 * bat) // 1048576 AS BIGINT) AS estimated_mb, CAST(trunc(((tile * tile * 12 * bat) // 1048576) / mem) AS BIGINT) AS system_mb,
      {S6('tf * vt')} AS time_factor, (v.venue, q.quality) IN (('small','fast'),('small','balanced'),('medium','balanced'),('medium','high'),('large','balanced'),('large','high')) AS recommended
    FROM v CROSS JOIN q LEFT JOIN u ON u.venue = v.venue AND u.quality = q.quality""",
)
def pln10(t):
    df = P.preset_matrix(rows(t, "media_asset"))
    nums = ["reverb_reduction", "spatial", "compression", "time_factor"]
    return df.select(*[r6(F.col(c)).alias(c) if c in nums else F.col(c) for c in df.columns])


@query(
    "pln11_adjust_for_venue",
    f"""WITH {cte('media_asset')}, {STRATEGY}, k AS (SELECT asset_id, batch, denoise, CASE WHEN asset_id % 10 = 0 THEN 'unknown' ELSE venue END AS venue FROM strat)
    SELECT asset_id, {S6("denoise * CASE venue WHEN 'small' THEN 0.8e0 WHEN 'large' THEN 1.2e0 ELSE 1e0 END")} AS denoise,
      greatest(1, CAST(trunc(batch * CASE venue WHEN 'small' THEN 1.2e0 WHEN 'large' THEN 0.8e0 ELSE 1e0 END) AS BIGINT)) AS batch FROM k""",
)
def pln11(t):
    plan = P.plan_strategy(rows(t, "media_asset")).withColumn("venue", F.expr("CASE WHEN asset_id % 10 = 0 THEN 'unknown' ELSE venue END"))
    return P.adjust_for_venue(plan).select("asset_id", r6(F.col("denoise")).alias("denoise"), "batch")


OVERRIDE_PAIRS = {
    "dialogue_boost": ("p_size % 3 = 0", "CAST(p_partkey % 30 AS DOUBLE)"),
    "tile_size": ("p_size % 4 = 0", "p_size * 30.5e0"),
    "memory_usage": ("p_size % 5 = 0", "(p_partkey % 10) / 10e0"),
    "colour": ("p_size % 2 = 0", "1e0"),
}


@query(
    "pln12_apply_overrides",
    f"""WITH {preset_sql()}, o AS ("""
    + " UNION ALL ".join(f"SELECT p_partkey AS preset_id, '{k}' AS key, {v} AS value FROM part WHERE {c}" for k, (c, v) in OVERRIDE_PAIRS.items())
    + """), r(key, lo, hi, whole) AS (VALUES ('dialogue_boost', 0e0, 20e0, false), ('tile_size', 64e0, 2048e0, true), ('memory_usage', 0.1e0, 0.9e0, false)),
    w AS (SELECT preset_id, bool_and(value BETWEEN lo AND hi AND (NOT whole OR value = floor(value))) AS accepted,
      max(CASE WHEN o.key = 'dialogue_boost' THEN value END) AS b, max(CASE WHEN o.key = 'tile_size' THEN value END) AS t,
      max(CASE WHEN o.key = 'memory_usage' THEN value END) AS m FROM o JOIN r ON o.key = r.key GROUP BY preset_id)
    SELECT p.preset_id, coalesce(accepted, true) AS accepted, denoise_strength, noise_reduction, reverb_reduction,
      CASE WHEN coalesce(accepted, true) THEN coalesce(b, dialogue_boost) ELSE dialogue_boost END AS dialogue_boost,
      CASE WHEN coalesce(accepted, true) THEN coalesce(t, tile_size::DOUBLE) ELSE tile_size::DOUBLE END AS tile_size,
      CASE WHEN coalesce(accepted, true) THEN coalesce(m, memory_usage) ELSE memory_usage END AS memory_usage
    FROM preset p LEFT JOIN w ON p.preset_id = w.preset_id""",
)
def pln12(t):
    preset = t.part.selectExpr(*[f"{e} AS {c}" for c, e in PRESET_COLS.items()])
    pairs = F.array(*[F.expr(f"CASE WHEN {c} THEN named_struct('key', '{k}', 'value', {v}) END") for k, (c, v) in OVERRIDE_PAIRS.items()])
    o = t.part.select(F.col("p_partkey").alias("preset_id"), F.explode(F.array_compact(pairs)).alias("m"))
    return P.apply_overrides(preset, o.select("preset_id", "m.key", "m.value"))


@query(
    "pln13_space_check",
    f"""WITH {cte('file_inventory')}, vol AS (SELECT volume, sum(size_bytes)::DOUBLE * 3 AS free_bytes FROM file_inventory GROUP BY volume),
    q AS (SELECT *, sum(size_bytes * 4) OVER (PARTITION BY volume ORDER BY file_id ROWS UNBOUNDED PRECEDING) AS queued FROM file_inventory)
    SELECT file_id, q.volume, queued::DOUBLE AS queued_bytes, free_bytes > size_bytes * 4e0 * 1.2e0 AS fits_alone, free_bytes > queued::DOUBLE * 1.2e0 AS fits_in_queue
    FROM q JOIN vol ON q.volume = vol.volume""",
)
def pln13(t):
    files = rows(t, "file_inventory")
    volumes = files.groupBy("volume").agg((F.sum("size_bytes").cast("double") * 3).alias("free_bytes"))
    df = P.space_check(files, volumes)
    return df.select("file_id", "volume", F.col("queued_bytes").cast("double").alias("queued_bytes"), "fits_alone", "fits_in_queue")


@query(
    "pln14_score_hosts",
    f"""WITH {cte('host')}, m AS (SELECT *, 5 - least(deps_found, 5) AS missing,
      list_transform(string_split(version, '.'), lambda p: CAST(p AS INT)) AS vp FROM host)
    SELECT host_id, {S6('''least(10e0, (CASE WHEN os IN ('Windows','Linux','Darwin') THEN 2e0 ELSE 0 END)
      + (CASE WHEN ram_gb >= 16 THEN 2e0 WHEN ram_gb >= 8 THEN 1.5e0 WHEN ram_gb >= 4 THEN 1e0 ELSE 0 END)
      + (CASE WHEN cores >= 8 THEN 2e0 WHEN cores >= 4 THEN 1.5e0 WHEN cores >= 2 THEN 1e0 ELSE 0 END)
      + (CASE WHEN gpu AND cuda THEN 2e0 WHEN gpu THEN 1e0 ELSE 0 END) + (5 - missing) / 5e0 * 2)''')} AS score,
      array_to_string(list_filter([CASE WHEN os NOT IN ('Windows','Linux','Darwin') THEN 'platform' END, CASE WHEN ram_gb < 4 THEN 'memory' END,
        CASE WHEN cores < 2 THEN 'cores' END, CASE WHEN missing > 0 THEN concat('dependencies:', missing) END], lambda c: c IS NOT NULL), ',') AS issues,
      CASE WHEN ram_gb >= 8 THEN 'full' WHEN ram_gb >= 4 THEN 'limited' ELSE 'basic' END AS video_tier,
      CASE WHEN gpu AND cuda THEN 'gpu' WHEN ram_gb >= 16 THEN 'cpu' ELSE 'none' END AS upscale_tier,
      CASE WHEN cores >= 4 AND ram_gb >= 8 THEN 'efficient' ELSE 'sequential' END AS batch_tier,
      CASE WHEN gpu AND cuda THEN CASE WHEN gpu_gb >= 8 THEN 'very_fast' WHEN gpu_gb >= 4 THEN 'fast' ELSE 'moderate' END
        WHEN cores >= 8 THEN 'moderate' ELSE 'slow' END AS speed_tier,
      CASE WHEN ram_gb >= 32 THEN 'excellent' WHEN ram_gb >= 16 THEN 'good' WHEN ram_gb >= 8 THEN 'adequate' ELSE 'limited' END AS memory_tier,
      CASE WHEN missing = 0 THEN 'high' WHEN missing <= 2 THEN 'medium' ELSE 'low' END AS stability,
      [coalesce(vp[1], 0), coalesce(vp[2], 0), coalesce(vp[3], 0)] >= [4, 5, 0] AS version_ok FROM m""",
)
def pln14(t):
    df = P.score_hosts(rows(t, "host"))
    cols = ["issues", "video_tier", "upscale_tier", "batch_tier", "speed_tier", "memory_tier", "stability", "version_ok"]
    return df.select("host_id", r6(F.col("score")).alias("score"), *cols)
