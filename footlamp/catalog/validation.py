"""Queries: validation and scoring (VAL, FRM21, AUD35)."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import SEGMENT_CTE, cte, rows, segments
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.scalars import r6
from footlamp.operators import validation as V

EXT = "CASE WHEN regexp_matches(path, '\\.[^./]+$') THEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) ELSE '' END"
GRADE = "CASE WHEN {0} >= 90 THEN 'excellent' WHEN {0} >= 70 THEN 'good' WHEN {0} >= 50 THEN 'fair' ELSE 'poor' END"
PAIR = (
    f"{cte('media_asset')}, {cte('output_asset')}, pair AS (SELECT o.*, a.width AS in_width, a.height AS in_height, "
    "a.duration_s AS in_duration_s, a.size_bytes AS in_size_bytes FROM output_asset o JOIN media_asset a USING (asset_id))"
)


@query(
    "val1_validate_assets",
    f"""WITH {cte('file_inventory')}, e AS (SELECT *, {EXT} AS ext FROM file_inventory),
    v AS (SELECT *, CASE WHEN ext NOT IN ('mp4','avi','mkv','mov','wmv','flv','webm','m4v','mpg','mpeg')
      THEN 'unsupported_format' WHEN size_bytes < 1024 THEN 'too_small' END AS error FROM e)
    SELECT file_id, error, CASE WHEN error IS NULL AND size_bytes / 1048576e0 > 50000 THEN 'very_large' END AS warning,
      error IS NULL AS valid FROM v""",
)
def val1(t):
    return V.validate_assets(rows(t, "file_inventory")).select("file_id", "error", "warning", "valid")


@query(
    "val2_frame_gaps",
    f"""WITH {SEGMENT_CTE}, f AS (SELECT job_id, count(*) AS n_found, CAST(max(segment_idx) AS BIGINT) AS n_expected
      FROM seg GROUP BY job_id),
    e AS (SELECT job_id, unnest(range(1, n_expected + 1)) AS segment_idx FROM f),
    m AS (SELECT e.job_id, count(*) AS n_missing, min(e.segment_idx) AS first_missing FROM e
      ANTI JOIN seg ON e.job_id = seg.job_id AND e.segment_idx = seg.segment_idx GROUP BY e.job_id)
    SELECT f.job_id, n_found, n_expected, coalesce(n_missing, 0) AS n_missing, first_missing,
      coalesce(n_missing, 0) = 0 AS contiguous, coalesce(n_missing, 0) <= n_expected * 0.1e0 AS tolerated
    FROM f LEFT JOIN m ON f.job_id = m.job_id""",
)
def val2(t):
    return V.frame_gaps(segments(t), "job_id", "segment_idx")


@query(
    "val3_reconcile_outputs",
    f"""WITH {SEGMENT_CTE}, s AS (SELECT job_id, CASE WHEN processed THEN frames >= 10 END AS readable,
      status = 'skipped' AS fixed FROM seg),
    a AS (SELECT job_id, count(*) AS n_expected, count(*) FILTER (WHERE readable) AS n_valid, count(*) FILTER (WHERE readable IS NULL) AS n_missing,
      count(*) FILTER (WHERE NOT readable) AS n_corrupted, count(*) FILTER (WHERE (readable IS NULL OR NOT readable) AND fixed) AS n_recovered
      FROM s GROUP BY job_id)
    SELECT job_id, n_expected, CAST(n_valid AS BIGINT) AS n_valid, CAST(n_missing AS BIGINT) AS n_missing,
      CAST(n_corrupted AS BIGINT) AS n_corrupted, CAST(n_recovered AS BIGINT) AS n_recovered,
      CAST(n_expected - n_valid - n_recovered AS BIGINT) AS n_failed,
      (n_valid + n_recovered)::DOUBLE / n_expected * 100 > 95e0 AS success FROM a""",
)
def val3(t):
    seg = segments(t)
    key = ["job_id", "segment_idx"]
    produced = seg.where("processed").select(*key, (F.col("frames") >= 10).alias("readable"))
    return V.reconcile_outputs(seg.select(*key), produced, seg.where("status = 'skipped'"), key, "job_id")


STAGE_FILES = {
    "stage": "CASE l_linenumber % 4 WHEN 0 THEN 'extract' WHEN 1 THEN 'upscale' WHEN 2 THEN 'audio' ELSE 'merge' END",
    "job_id": "l_orderkey",
    "exists": "l_returnflag <> 'A' OR l_discount > 0.01",
    "size_bytes": "CAST(CASE WHEN l_tax = 0 THEN 0 ELSE floor(l_extendedprice) END AS BIGINT)",
    "readable": "l_quantity > 3",
}


@query(
    "val4_validate_stage",
    f"""WITH f AS (SELECT {', '.join(f'{e} AS "{c}"' for c, e in STAGE_FILES.items())} FROM lineitem),
    p AS (SELECT stage, job_id % 100 AS batch, CASE WHEN NOT "exists" THEN 'missing' WHEN size_bytes = 0 THEN 'empty'
      WHEN NOT readable THEN 'unreadable' END AS problem FROM f),
    a AS (SELECT stage, batch, count(*) AS n_files, count(*) FILTER (WHERE problem = 'missing') AS n_missing,
      count(*) FILTER (WHERE problem = 'empty') AS n_empty, count(*) FILTER (WHERE problem = 'unreadable') AS n_unreadable FROM p GROUP BY stage, batch)
    SELECT concat(stage, '-', batch) AS stage, n_files, CAST(n_missing AS BIGINT) AS n_missing,
      CAST(n_empty AS BIGINT) AS n_empty, CAST(n_unreadable AS BIGINT) AS n_unreadable,
      n_missing + n_empty + n_unreadable = 0 AS success FROM a""",
)
def val4(t):
    files = t.lineitem.selectExpr(*[f"{e} AS {c}" for c, e in STAGE_FILES.items()])
    files = files.withColumn("stage", F.concat_ws("-", "stage", F.col("job_id") % 100))
    return V.validate_stage(files)


@query(
    "val5_validate_final",
    f"""WITH {PAIR} SELECT asset_id,
      in_duration_s > 0 AND duration_s > 0 AND abs(in_duration_s - duration_s) / in_duration_s < 0.01e0 AS duration_match,
      width > in_width OR height > in_height AS resolution_enhanced, has_audio AS audio_present,
      has_audio AND duration_s > 0 AND audio_duration_s > 0
        AND abs(duration_s - audio_duration_s) / greatest(duration_s, audio_duration_s) < 0.02e0 AS sync_preserved,
      in_duration_s > 0 AND duration_s > 0 AND abs(in_duration_s - duration_s) / in_duration_s < 0.01e0
        AND has_audio AS success FROM pair""",
)
def val5(t):
    return V.validate_final(rows(t, "media_asset"), rows(t, "output_asset")).select(
        "asset_id", "duration_match", "resolution_enhanced", "audio_present", "sync_preserved", "success"
    )


@query(
    "val6_validate_merge",
    f"""WITH {PAIR} SELECT asset_id, has_video AND has_audio AND size_bytes >= 1024 AND
      (CASE WHEN in_duration_s > 0 AND duration_s > 0 THEN abs(in_duration_s - duration_s) / in_duration_s ELSE 0 END) <= 0.05e0
      AS merge_ok FROM pair""",
)
def val6(t):
    return V.validate_merge(rows(t, "media_asset"), rows(t, "output_asset")).select("asset_id", "merge_ok")


@query(
    "val7_integration_score",
    f"""WITH {cte('output_asset')}, s AS (SELECT asset_id, (CASE WHEN width = 3840 AND height = 2160 THEN 30 ELSE 0 END)
      + (CASE WHEN bitrate > 5000000 THEN 25 ELSE 0 END) + (CASE WHEN audio_bitrate > 200000 THEN 20 ELSE 0 END)
      + (CASE WHEN abs(duration_s - audio_duration_s) < 0.1e0 THEN 25 ELSE 0 END) AS score FROM output_asset)
    SELECT asset_id, score, {GRADE.format('score')} AS grade FROM s""",
)
def val7(t):
    return V.integration_score(rows(t, "output_asset")).select("asset_id", "score", "grade")


PLAY = """play AS (SELECT *, (CASE WHEN contains(lower(container), 'mp4') THEN 20 ELSE 0 END)
  + (CASE WHEN codec = 'h264' THEN 25 ELSE 0 END) + (CASE WHEN has_audio AND audio_codec = 'aac' THEN 20 ELSE 0 END)
  + (CASE WHEN width = 3840 AND height = 2160 THEN 15 ELSE 0 END)
  + (CASE WHEN bitrate BETWEEN 100000 AND 50000000 THEN 10 ELSE 0 END)
  + (CASE WHEN has_audio AND channels = 2 THEN 10 ELSE 0 END) AS score,
  (CASE codec WHEN 'h264' THEN 30 WHEN 'hevc' THEN 25 WHEN 'vp9' THEN 20 ELSE 0 END)
  + (CASE WHEN contains(container, 'mp4') THEN 25 WHEN contains(container, 'mkv') THEN 20
     WHEN contains(container, 'avi') THEN 15 ELSE 0 END) AS score_v2 FROM output_asset)"""


@query(
    "val8_playback_score",
    f"""WITH {cte('output_asset')}, {PLAY} SELECT asset_id, score, {GRADE.format('score')} AS level, score_v2,
      array_to_string(list_sort(list_distinct(list_concat(
        CASE codec WHEN 'h264' THEN ['VLC','Windows Media Player','QuickTime','Chrome','Firefox'] WHEN 'hevc' THEN ['VLC','Modern browsers','Hardware players']
        ELSE ['Chrome','Firefox','VLC'] END,
        [CASE WHEN contains(container, 'mp4') THEN 'Universal MP4 support' WHEN contains(container, 'mkv') THEN 'MKV players'
         ELSE 'Legacy AVI support' END]))), ',') AS players FROM play""",
)
def val8(t):
    return V.playback_score(rows(t, "output_asset")).select("asset_id", "score", "level", "score_v2", "players")


TRACK = """track AS (SELECT *, (CASE WHEN audio_rate >= 48000 THEN 25 WHEN audio_rate >= 44100 THEN 20 ELSE 0 END)
  + (CASE WHEN audio_bitrate >= 192000 THEN 25 WHEN audio_bitrate >= 128000 THEN 20 ELSE 0 END)
  + (CASE channels WHEN 2 THEN 25 WHEN 1 THEN 15 ELSE 0 END)
  + (CASE WHEN audio_codec = 'aac' THEN 25 ELSE 0 END) AS audio_score FROM {0})"""


@query(
    "val9_audio_track_score",
    f"""WITH {cte('output_asset')}, {TRACK.format('output_asset')}
    SELECT asset_id, audio_score, {GRADE.format('audio_score')} AS audio_level FROM track""",
)
def val9(t):
    return V.audio_track_score(rows(t, "output_asset")).select("asset_id", "audio_score", "audio_level")


@query(
    "val10_final_status",
    f"""WITH {cte('output_asset')}, {PLAY} SELECT asset_id, CASE WHEN width = 3840 AND height = 2160 AND score_v2 >= 50
      THEN 'success' WHEN width = 3840 AND height = 2160 THEN 'partial_success' ELSE 'failed' END AS final_status FROM play""",
)
def val10(t):
    return V.final_status(V.playback_score(rows(t, "output_asset"))).select("asset_id", "final_status")


@query(
    "val11_size_budget",
    f"""WITH {cte('output_asset')}, b AS (SELECT asset_id, size_bytes / 1048576e0 AS s,
      width::DOUBLE * height * frame_count * 0.1e0 / 8388608e0 AS hi, width::DOUBLE * height * frame_count * 0.05e0 / 8388608e0 AS me
      FROM output_asset)
    SELECT asset_id, {S6('s')} AS size_mb, {S6('hi')} AS expected_high_mb, {S6('me')} AS expected_medium_mb,
      CASE WHEN s > hi * 2 THEN 'optimise' WHEN s < me * 0.5e0 THEN 'check_quality' ELSE 'reasonable' END AS advice,
      {S6('CASE WHEN s > hi * 2 THEN s - hi ELSE 0 END')} AS savings_mb FROM b""",
)
def val11(t):
    df = V.size_budget(rows(t, "output_asset"))
    nums = ["size_mb", "expected_high_mb", "expected_medium_mb", "savings_mb"]
    return df.select("asset_id", "advice", *[r6(F.col(c)).alias(c) for c in nums])


@query(
    "val12_tune_recommendations",
    f"""WITH {cte('output_asset')}, {PLAY}, {TRACK.format('play')}
    SELECT asset_id, array_to_string(list_filter([
      CASE WHEN score < 70 THEN 'convert_format' END,
      CASE WHEN score < 90 AND container <> 'mov,mp4,m4a,3gp,3g2,mj2' THEN 'use_mp4' END,
      CASE WHEN audio_score < 90 AND audio_bitrate < 192000 THEN 'raise_audio_bitrate' END,
      CASE WHEN audio_score < 90 AND audio_rate < 48000 THEN 'raise_audio_rate' END,
      CASE WHEN round(size_bytes / 1048576e0, 2) > 100 THEN 'compress' END,
      CASE WHEN round(size_bytes / 1048576e0, 2) < 10 THEN 'raise_quality' END], lambda c: c IS NOT NULL), ',') AS advice FROM track""",
)
def val12(t):
    return V.tune_recommendations(rows(t, "output_asset")).select("asset_id", "advice")


PRESET_COLS = {
    "preset_id": "p_partkey",
    "venue": "CASE p_partkey % 4 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' WHEN 2 THEN 'large' ELSE 'arena' END",
    "quality": "CASE p_size % 3 WHEN 0 THEN 'fast' WHEN 1 THEN 'balanced' ELSE 'high' END",
    "dialogue_boost": "CAST(p_partkey % 25 AS DOUBLE)",
    "noise_reduction": "(p_size % 12) / 10e0",
    "denoise_strength": "(p_partkey % 13) / 11e0",
    "reverb_reduction": "(p_partkey % 9) / 8e0",
    "memory_usage": "(p_size % 11) / 10e0",
    "tile_size": "CAST(64 * (p_size % 20) AS INT)",
}


def preset_sql() -> str:
    return "preset AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PRESET_COLS.items()) + " FROM part)"


@query(
    "val13_validate_presets",
    f"""WITH {preset_sql()}, c AS (SELECT preset_id, array_to_string(list_filter([
      CASE WHEN venue NOT IN ('small','medium','large') THEN 'bad_venue' END,
      CASE WHEN quality NOT IN ('fast','balanced','high') THEN 'bad_quality' END,
      CASE WHEN NOT denoise_strength BETWEEN 0 AND 1 THEN 'range_denoise_strength' END,
      CASE WHEN NOT dialogue_boost BETWEEN 0 AND 20 THEN 'range_dialogue_boost' END,
      CASE WHEN NOT noise_reduction BETWEEN 0 AND 1 THEN 'range_noise_reduction' END,
      CASE WHEN NOT reverb_reduction BETWEEN 0 AND 1 THEN 'range_reverb_reduction' END,
      CASE WHEN NOT memory_usage BETWEEN 0.1e0 AND 0.9e0 THEN 'range_memory_usage' END], lambda c: c IS NOT NULL), ',') AS errors,
      array_to_string(list_filter([
      CASE WHEN abs(dialogue_boost - CASE venue WHEN 'small' THEN 6e0 WHEN 'medium' THEN 4e0 WHEN 'large' THEN 2e0 END) > 3 THEN 'boost' END,
      CASE WHEN abs(noise_reduction - CASE venue WHEN 'small' THEN 0.7e0 WHEN 'medium' THEN 0.5e0 WHEN 'large' THEN 0.3e0 END) > 0.3e0 THEN 'noise' END,
      CASE WHEN abs(tile_size - CASE quality WHEN 'fast' THEN 512 WHEN 'balanced' THEN 768 ELSE 1024 END) > 256 THEN 'tile' END],
      lambda c: c IS NOT NULL), ',') AS warnings FROM preset)
    SELECT preset_id, errors, warnings, errors = '' AS valid FROM c""",
)
def val13(t):
    preset = t.part.selectExpr(*[f"{e} AS {c}" for c, e in PRESET_COLS.items()])
    return V.validate_presets(preset).select("preset_id", "errors", "warnings", "valid")


CONFIG_PATHS = {
    "video.tile_size": ("p_partkey % 10 <> 3", "CASE WHEN p_partkey % 7 = 0 THEN '12.5' ELSE CAST(p_size * 50 AS STRING) END"),
    "video.width": ("p_partkey % 10 <> 3", "CAST(p_size * 80 AS STRING)"),
    "video.height": ("p_partkey % 10 <> 3", "CAST(p_partkey % 50 * 45 + 45 AS STRING)"),
    "video.ai_model": ("p_partkey % 10 <> 3", "CASE p_partkey % 3 WHEN 0 THEN 'real-cugan' WHEN 1 THEN 'esrgan-x4' ELSE 'other' END"),
    "performance.max_memory_usage": ("p_partkey % 6 <> 1", "CAST(p_partkey % 12 AS STRING)"),
    "performance.num_workers": ("p_partkey % 6 <> 1", "CAST(p_size AS STRING)"),
    "audio.noise_reduction_strength": ("p_partkey % 4 <> 2", "concat('0.', CAST(p_partkey % 10 AS STRING))"),
    "audio.dialogue_enhancement": ("p_partkey % 4 <> 2", "concat('0.', CAST(p_size % 10 AS STRING))"),
    "audio.dynamic_range_target": ("p_partkey % 4 <> 2", "CAST(-2 * p_size AS STRING)"),
    "plugins.extra": ("p_size % 5 = 0", "'x'"),
}


@query(
    "val14_validate_config",
    "WITH kv AS ("
    + " UNION ALL ".join(
        f"SELECT p_partkey AS config_id, '{p}' AS path, {v} AS value FROM part WHERE {c}" for p, (c, v) in CONFIG_PATHS.items()
    )
    + """), n AS (SELECT *, try_cast(value AS DOUBLE) AS num FROM kv),
    rules(path, lo, hi, whole) AS (VALUES ('video.tile_size', 64e0, 2048e0, true), ('performance.max_memory_usage', 0.1e0, 0.9e0, false),
      ('performance.num_workers', 1e0, 32e0, true), ('audio.noise_reduction_strength', 0e0, 1e0, false),
      ('audio.dialogue_enhancement', 0e0, 1e0, false), ('audio.dynamic_range_target', -60e0, 0e0, false)),
    g AS (SELECT config_id, bool_or(path LIKE 'video.%') AS v, bool_or(path LIKE 'audio.%') AS a,
      bool_or(path LIKE 'performance.%') AS p, max(CASE WHEN path = 'video.width' THEN num END) AS w,
      max(CASE WHEN path = 'video.height' THEN num END) AS h,
      max(CASE WHEN path = 'audio.noise_reduction_strength' THEN num END) AS nr,
      max(CASE WHEN path = 'audio.dialogue_enhancement' THEN num END) AS de FROM n GROUP BY config_id)
    SELECT config_id, 'error' AS level, concat('range:', n.path) AS code FROM n JOIN rules r ON n.path = r.path
      WHERE num IS NULL OR num < lo OR num > hi OR (whole AND num <> floor(num))
    UNION ALL SELECT config_id, 'error', 'model:video.ai_model' FROM kv WHERE path = 'video.ai_model' AND value = 'other'
    UNION ALL SELECT config_id, 'warning', 'unknown:plugins' FROM kv WHERE path LIKE 'plugins.%'
    UNION ALL SELECT config_id, 'warning', 'missing:video' FROM g WHERE NOT v
    UNION ALL SELECT config_id, 'warning', 'missing:audio' FROM g WHERE NOT a
    UNION ALL SELECT config_id, 'warning', 'missing:performance' FROM g WHERE NOT p
    UNION ALL SELECT config_id, 'error', 'aspect' FROM g WHERE (w / h < 1e0/3 OR w / h > 3)
      AND (w, h) NOT IN ((1280,720),(1920,1080),(2560,1440),(3840,2160),(7680,4320))
    UNION ALL SELECT config_id, 'error', 'over_processing' FROM g WHERE nr > 0.7e0 AND de > 0.7e0""",
)
def val14(t):
    pairs = F.array(
        *[
            F.expr(f"CASE WHEN {c} THEN named_struct('path', '{p}', 'value', {v}) END")
            for p, (c, v) in CONFIG_PATHS.items()
        ]
    )
    kv = t.part.select(F.col("p_partkey").alias("config_id"), F.explode(F.array_compact(pairs)).alias("m"))
    return V.validate_config(kv.select("config_id", "m.path", "m.value"))


@query(
    "frm21_size_analysis",
    f"""WITH {PAIR}, s AS (SELECT asset_id, in_size_bytes / 1048576e0 AS a, size_bytes / 1048576e0 AS b,
      in_width::DOUBLE * in_height AS p, width::DOUBLE * height AS q FROM pair)
    SELECT asset_id, {S6('a')} AS original_mb, {S6('b')} AS enhanced_mb, {S6('b / a')} AS size_ratio, {S6('q / p')} AS pixel_ratio,
      {S6('b / (q / 1e6)')} AS mb_per_megapixel, CASE WHEN b / a > 10 THEN 'compress' WHEN b / a < 2 THEN 'reasonable' END AS advice FROM s""",
)
def frm21(t):
    df = V.size_analysis(rows(t, "media_asset"), rows(t, "output_asset"))
    nums = ["original_mb", "enhanced_mb", "size_ratio", "pixel_ratio", "mb_per_megapixel"]
    return df.select("asset_id", "advice", *[r6(F.col(c)).alias(c) for c in nums])


@query(
    "aud35_av_sync",
    f"""WITH {cte('output_asset')}, d AS (SELECT *, abs(duration_s - audio_duration_s) AS diff, abs(start_s - audio_start_s) AS st FROM output_asset)
    SELECT asset_id, {S6('diff')} AS difference_s, CASE WHEN diff < 0.1e0 THEN 'good' ELSE 'needs_adjustment' END AS status,
      CASE WHEN diff < 0.1e0 AND st < 0.05e0 THEN 'good' ELSE 'needs_adjustment' END AS status_with_start,
      {S6('CASE WHEN has_audio THEN greatest(0e0, 1 - diff / 2) ELSE 1e0 END')} AS sync_score FROM d""",
)
def aud35(t):
    df = V.av_sync(rows(t, "output_asset"))
    return df.select("asset_id", "status", "status_with_start", r6(F.col("difference_s")).alias("difference_s"), r6(F.col("sync_score")).alias("sync_score"))
