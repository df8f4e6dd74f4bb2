"""Validation and scoring rules for inputs, stages and outputs.

All row rules are column expressions; joins are equi-joins on ``asset_id`` or on a full row key.
Problems are short codes, so reports can be grouped without parsing text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.functions.scalars import banded, clamp, codes, lookup, ratio

# Fixed values.
VIDEO_EXTENSIONS = ["mp4", "avi", "mkv", "mov", "wmv", "flv", "webm", "m4v", "mpg", "mpeg"]
MIN_BYTES = 1024
MAX_MB = 50000
MB = 1024 * 1024
GRADES = [(90, "excellent"), (70, "good"), (50, "fair")]


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))


def validate_assets(files: DataFrame) -> DataFrame:
    """First error wins; warnings accumulate independently of it."""
    mb = F.col("size_bytes") / MB
    error = (
        F.when(~extension().isin(VIDEO_EXTENSIONS), F.lit("unsupported_format"))
        .when(F.col("size_bytes") < MIN_BYTES, F.lit("too_small"))
    )
    return files.withColumn("error", error).withColumn(
        "warning", F.when(F.col("error").isNull() & (mb > MAX_MB), F.lit("very_large"))
    ).withColumn("valid", F.col("error").isNull())


def expected_frames(frames: DataFrame, job: str, idx: str, step: int = 65536) -> DataFrame:
    """Rows 1..max(idx) of every job; blocks of a long job are dealt to many tasks before they are generated."""
    top = frames.groupBy(job).agg(F.max(idx).cast("bigint").alias("__top"))
    blocks = top.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__top") - 1) / step))))
    blocks = blocks.repartition(job, "__b")
    lo = F.col("__b") * step + 1
    hi = F.least(F.col("__top"), (F.col("__b") + 1) * step)
    return blocks.select(job, F.explode(F.sequence(lo, hi)).alias(idx))


def frame_gaps(frames: DataFrame, job: str, idx: str, tolerance: float = 0.10) -> DataFrame:
    """Contiguity report per job: strict check and the variant that tolerates a share of gaps.

    Missing numbers are counted, not generated, so a wrong index costs nothing: distinct numbers are taken from the
    largest, and the first gap follows the lowest number (or 0) that has no successor.
    """
    found = frames.groupBy(job).agg(
        F.count(F.lit(1)).alias("n_found"), F.max(idx).cast("bigint").alias("n_expected")
    )
    present = frames.select(job, F.col(idx).cast("bigint").alias(idx)).where(F.col(idx) >= 1).distinct()
    after = present.unionByName(found.select(job, F.lit(0).cast("bigint").alias(idx)))
    gaps = after.withColumn(idx, F.col(idx) + 1).join(present, [job, idx], "left_anti")
    first = gaps.groupBy(job).agg(F.min(idx).alias("__first"))
    known = present.groupBy(job).agg(F.count(F.lit(1)).alias("__known"))
    missing = F.greatest(F.col("n_expected"), F.lit(0)) - F.coalesce("__known", F.lit(0))
    return (
        found.join(known, job, "left")
        .join(first, job, "left")
        .select(job, "n_found", "n_expected", missing.alias("n_missing"), F.when(missing > 0, F.col("__first")).alias("first_missing"))
        .withColumn("contiguous", F.col("n_missing") == 0)
        .withColumn("tolerated", F.col("n_missing") <= F.col("n_expected") * tolerance)
    )


def reconcile_outputs(
    expected: DataFrame, produced: DataFrame, recovered: DataFrame, key: list[str], job: str
) -> DataFrame:
    """Missing / corrupted / valid counts per job; ``produced.readable`` says if a frame decodes.

    ``recovered`` holds the keys a second attempt repaired.
    """
    state = (
        expected.join(produced.select(*key, "readable"), key, "left")
        .join(recovered.select(*key, F.lit(True).alias("__fixed")), key, "left")
        .withColumn("lost", F.coalesce(~F.col("readable"), F.lit(True)))
    )
    fixed = F.col("lost") & F.coalesce("__fixed", F.lit(False))
    out = state.groupBy(job).agg(
        F.count(F.lit(1)).alias("n_expected"),
        F.count_if(F.col("readable")).alias("n_valid"),
        F.count_if(F.col("readable").isNull()).alias("n_missing"),
        F.count_if(~F.col("readable")).alias("n_corrupted"),
        F.count_if(fixed).alias("n_recovered"),
    )
    ok = F.col("n_valid") + F.col("n_recovered")
    return out.withColumn("n_failed", F.col("n_expected") - ok).withColumn(
        "success", ok / F.col("n_expected") * 100 > 95.0
    )


def stage_problem(outputs: DataFrame) -> DataFrame:
    """One problem code per bad output file; files of any number, so no lists."""
    return outputs.withColumn(
        "problem",
        F.when(~F.col("exists"), F.lit("missing"))
        .when(F.col("size_bytes") == 0, F.lit("empty"))
        .when(~F.col("readable"), F.lit("unreadable")),
    )


def validate_stage(outputs: DataFrame, stage: str = "stage") -> DataFrame:
    """Problem counts per stage; success only when there is none."""
    p = F.col("problem")
    return (
        stage_problem(outputs)
        .groupBy(stage)
        .agg(
            F.count(F.lit(1)).alias("n_files"),
            F.count_if(p == "missing").alias("n_missing"),
            F.count_if(p == "empty").alias("n_empty"),
            F.count_if(p == "unreadable").alias("n_unreadable"),
        )
        .withColumn(
            "success", F.col("n_missing") + F.col("n_empty") + F.col("n_unreadable") == 0
        )
    )


def _pair(original: DataFrame, output: DataFrame) -> DataFrame:
    o = original.select(
        "asset_id", *[F.col(c).alias(f"in_{c}") for c in ("width", "height", "duration_s", "size_bytes")]
    )
    return output.join(o, "asset_id")


def validate_final(original: DataFrame, output: DataFrame) -> DataFrame:
    """Success needs the duration and the audio check only."""
    d_in, d_out, a = F.col("in_duration_s"), F.col("duration_s"), F.col("audio_duration_s")
    known = (d_in > 0) & (d_out > 0)
    return (
        _pair(original, output)
        .withColumn("duration_match", F.coalesce(known & (ratio(F.abs(d_in - d_out), d_in) < 0.01), F.lit(False)))
        .withColumn(
            "resolution_enhanced",
            (F.col("width") > F.col("in_width")) | (F.col("height") > F.col("in_height")),
        )
        .withColumn("audio_present", F.col("has_audio"))
        .withColumn(
            "sync_preserved",
            F.col("has_audio") & (d_out > 0) & (a > 0) & (ratio(F.abs(d_out - a), F.greatest(d_out, a)) < 0.02),
        )
        .withColumn("success", F.col("duration_match") & F.col("audio_present"))
    )


def validate_merge(original: DataFrame, merged: DataFrame) -> DataFrame:
    d_in, d_out = F.col("in_duration_s"), F.col("duration_s")
    drift = F.when((d_in > 0) & (d_out > 0), ratio(F.abs(d_in - d_out), d_in)).otherwise(0.0)
    return _pair(original, merged).withColumn(
        "merge_ok",
        F.col("has_video") & F.col("has_audio") & (drift <= 0.05) & (F.col("size_bytes") >= MIN_BYTES),
    )


def _points(*rules: tuple[Column, int]) -> Column:
    total = F.lit(0)
    for hit, points in rules:
        total = total + F.when(hit, points).otherwise(0)
    return total


def is_4k() -> Column:
    return (F.col("width") == 3840) & (F.col("height") == 2160)


def integration_score(output: DataFrame) -> DataFrame:
    score = _points(
        (is_4k(), 30),
        (F.col("bitrate") > 5000000, 25),
        (F.col("audio_bitrate") > 200000, 20),
        (F.abs(F.col("duration_s") - F.col("audio_duration_s")) < 0.1, 25),
    )
    return output.withColumn("score", score).withColumn("grade", banded(F.col("score"), GRADES, "poor"))


# Players that can open each codec, and support by container.
PLAYERS = {
    "h264": ["VLC", "Windows Media Player", "QuickTime", "Chrome", "Firefox"],
    "hevc": ["VLC", "Modern browsers", "Hardware players"],
    "vp9": ["Chrome", "Firefox", "VLC"],
}
CONTAINER_SUPPORT = {"mp4": "Universal MP4 support", "mkv": "MKV players", "avi": "Legacy AVI support"}
CODEC_POINTS = {"h264": 30, "hevc": 25, "vp9": 20}
CONTAINER_POINTS = {"mp4": 25, "mkv": 20, "avi": 15}


def playback_score(output: DataFrame) -> DataFrame:
    """Six-part score, plus the codec/container variant with its distinct player list."""
    score = _points(
        (F.lower("container").contains("mp4"), 20),
        (F.col("codec") == "h264", 25),
        (F.col("has_audio") & (F.col("audio_codec") == "aac"), 20),
        (is_4k(), 15),
        (F.col("bitrate").between(100000, 50000000), 10),
        (F.col("has_audio") & (F.col("channels") == 2), 10),
    )
    codec, container = F.lower("codec"), F.lower("container")
    family = (
        F.when(codec.contains("h264") | codec.contains("avc"), F.lit("h264"))
        .when(codec.contains("h265") | codec.contains("hevc"), F.lit("hevc"))
        .when(codec.contains("vp9"), F.lit("vp9"))
    )
    box = F.lit(None).cast("string")
    for name in reversed(CONTAINER_POINTS):
        box = F.when(container.contains(name), F.lit(name)).otherwise(box)
    players = F.lit(None).cast("array<string>")
    for name, names in PLAYERS.items():
        players = F.when(family == name, F.array(*[F.lit(n) for n in names])).otherwise(players)
    support = F.when(box.isNotNull(), F.array(lookup(box, CONTAINER_SUPPORT, "")))
    empty = F.array().cast("array<string>")
    return (
        output.withColumn("score", score)
        .withColumn("level", banded(F.col("score"), GRADES, "poor"))
        .withColumn(
            "score_v2", lookup(family, CODEC_POINTS, 0) + lookup(box, CONTAINER_POINTS, 0)
        )
        .withColumn(
            "players",
            F.array_join(
                F.array_sort(
                    F.array_distinct(
                        F.flatten(F.array(F.coalesce(players, empty), F.coalesce(support, empty)))
                    )
                ),
                ",",
            ),
        )
    )


def audio_track_score(track: DataFrame) -> DataFrame:
    rate = banded(F.col("audio_rate"), [(48000, 25), (44100, 20)], 0)
    bits = banded(F.col("audio_bitrate"), [(192000, 25), (128000, 20)], 0)
    layout = lookup(F.col("channels"), {2: 25, 1: 15}, 0)
    score = rate + bits + layout + F.when(F.col("audio_codec") == "aac", 25).otherwise(0)
    return track.withColumn("audio_score", score).withColumn(
        "audio_level", banded(F.col("audio_score"), GRADES, "poor")
    )


def final_status(scored: DataFrame) -> DataFrame:
    """Needs ``score_v2`` of :func:`playback_score`."""
    return scored.withColumn(
        "final_status",
        F.when(is_4k() & (F.col("score_v2") >= 50), F.lit("success"))
        .when(is_4k(), F.lit("partial_success"))
        .otherwise(F.lit("failed")),
    )


def size_budget(output: DataFrame) -> DataFrame:
    size = F.col("size_bytes") / MB
    load = F.col("width").cast("double") * F.col("height") * F.col("frame_count")
    high, medium = load * 0.1 / (8 * MB), load * 0.05 / (8 * MB)
    return output.select(
        "*",
        size.alias("size_mb"),
        high.alias("expected_high_mb"),
        medium.alias("expected_medium_mb"),
        F.when(size > high * 2, F.lit("optimise"))
        .when(size < medium * 0.5, F.lit("check_quality"))
        .otherwise(F.lit("reasonable"))
        .alias("advice"),
        F.when(size > high * 2, size - high).otherwise(0.0).alias("savings_mb"),
    )


def tune_recommendations(output: DataFrame) -> DataFrame:
    """Advice codes from both scores; three general tips always apply and are left to the caller."""
    df = audio_track_score(playback_score(output))
    mb = F.round(F.col("size_bytes") / MB, 2)
    weak, weak_audio = F.col("score") < 90, F.col("audio_score") < 90
    return df.withColumn(
        "advice",
        codes(
            F.when(F.col("score") < 70, F.lit("convert_format")),
            F.when(weak & (F.col("container") != "mov,mp4,m4a,3gp,3g2,mj2"), F.lit("use_mp4")),
            F.when(weak_audio & (F.col("audio_bitrate") < 192000), F.lit("raise_audio_bitrate")),
            F.when(weak_audio & (F.col("audio_rate") < 48000), F.lit("raise_audio_rate")),
            F.when(mb > 100, F.lit("compress")),
            F.when(mb < 10, F.lit("raise_quality")),
        ),
    )


# Recommended audio settings by venue and tile side by quality.
VENUE_BOOST = {"small": 6.0, "medium": 4.0, "large": 2.0}
VENUE_NOISE = {"small": 0.7, "medium": 0.5, "large": 0.3}
QUALITY_TILE = {"fast": 512, "balanced": 768, "high": 1024}
# Allowed closed ranges.
PRESET_RANGES = {
    "denoise_strength": (0.0, 1.0),
    "dialogue_boost": (0.0, 20.0),
    "noise_reduction": (0.0, 1.0),
    "reverb_reduction": (0.0, 1.0),
    "memory_usage": (0.1, 0.9),
}


def validate_presets(preset: DataFrame) -> DataFrame:
    """Errors are range and enum violations; warnings are distances from the recommendation."""
    venue, quality = F.col("venue"), F.col("quality")
    errors = [
        F.when(venue.isNull() | ~venue.isin(list(VENUE_BOOST)), F.lit("bad_venue")),
        F.when(quality.isNull() | ~quality.isin(list(QUALITY_TILE)), F.lit("bad_quality")),
    ]
    for name, (lo, hi) in PRESET_RANGES.items():
        errors.append(F.when(~F.col(name).between(lo, hi), F.lit(f"range_{name}")))
    warnings = [
        F.when(F.abs(F.col("dialogue_boost") - lookup(venue, VENUE_BOOST)) > 3.0, F.lit("boost")),
        F.when(F.abs(F.col("noise_reduction") - lookup(venue, VENUE_NOISE)) > 0.3, F.lit("noise")),
        F.when(F.abs(F.col("tile_size") - lookup(quality, QUALITY_TILE)) > 256, F.lit("tile")),
    ]
    return (
        preset.withColumn("errors", codes(*errors))
        .withColumn("warnings", codes(*warnings))
        .withColumn("valid", F.col("errors") == "")
    )


# Numeric rules of a flattened configuration.
CONFIG_RANGES = {
    "video.tile_size": (64.0, 2048.0),
    "performance.max_memory_usage": (0.1, 0.9),
    "performance.num_workers": (1.0, 32.0),
    "audio.noise_reduction_strength": (0.0, 1.0),
    "audio.dialogue_enhancement": (0.0, 1.0),
    "audio.dynamic_range_target": (-60.0, 0.0),
}
CONFIG_INTEGERS = ["video.tile_size", "performance.num_workers"]
CONFIG_SECTIONS = ["video", "audio", "performance"]
CONFIG_KNOWN = [
    "video", "audio", "performance", "logging", "paths", "ui", "_metadata", "log_level", "log_file",
    "temp_dir", "models_dir", "presets_dir", "progress_update_interval", "auto_cleanup",
    "save_processing_logs",
]
CONFIG_MODELS = [
    "realesrgan-x4plus", "realesrgan-x4plus-anime", "real-cugan", "waifu2x-cunet", "waifu2x-photo",
    "esrgan-x4", "srmd-ncnn",
]
COMMON_SIZES = [(1280, 720), (1920, 1080), (2560, 1440), (3840, 2160), (7680, 4320)]


def validate_config(kv: DataFrame) -> DataFrame:
    """Problem rows ``(config_id, level, code)`` of flattened (config_id, path, value) rows."""
    path, value = F.col("path"), F.col("value")
    number = F.expr("try_cast(value AS DOUBLE)")
    bad = F.lit(None).cast("string")
    for name, (lo, hi) in CONFIG_RANGES.items():
        wrong = number.isNull() | ~number.between(lo, hi)
        if name in CONFIG_INTEGERS:
            wrong = wrong | (number != F.floor(number))
        bad = F.when((path == name) & wrong, F.concat(F.lit("range:"), path)).otherwise(bad)
    bad = F.when(
        (path == "video.ai_model") & ~value.isin(CONFIG_MODELS), F.lit("model:video.ai_model")
    ).otherwise(bad)
    row_errors = kv.select("config_id", F.lit("error").alias("level"), bad.alias("code")).where("code IS NOT NULL")

    top = F.element_at(F.split(path, r"\."), 1)
    unknown = kv.select("config_id", top.alias("__top")).where(~top.isin(CONFIG_KNOWN)).distinct()
    unknown = unknown.select("config_id", F.lit("warning").alias("level"), F.concat(F.lit("unknown:"), "__top").alias("code"))

    def pick(name: str) -> Column:
        return F.max(F.when(path == name, number))

    shape = kv.groupBy("config_id").agg(
        *[F.max((top == s).cast("int")).alias(f"has_{s}") for s in CONFIG_SECTIONS],
        pick("video.width").alias("w"),
        pick("video.height").alias("h"),
        pick("audio.noise_reduction_strength").alias("nr"),
        pick("audio.dialogue_enhancement").alias("de"),
    )
    common = F.lit(False)
    for w, h in COMMON_SIZES:
        common = common | ((F.col("w") == w) & (F.col("h") == h))
    aspect = ratio(F.col("w"), F.col("h"))
    odd = ~common & ((aspect < 1 / 3) | (aspect > 3))
    marks = F.array(
        *[
            F.when(F.col(f"has_{s}") == 0, F.struct(F.lit("warning").alias("level"), F.lit(f"missing:{s}").alias("code")))
            for s in CONFIG_SECTIONS
        ],
        F.when(odd, F.struct(F.lit("error").alias("level"), F.lit("aspect").alias("code"))),
        F.when(
            (F.col("nr") > 0.7) & (F.col("de") > 0.7),
            F.struct(F.lit("error").alias("level"), F.lit("over_processing").alias("code")),
        ),
    )
    whole = shape.select("config_id", F.explode(F.array_compact(marks)).alias("m")).select("config_id", "m.*")
    return row_errors.unionByName(unknown).unionByName(whole)


def size_analysis(original: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Size and pixel ratios with the advice threshold on size."""
    df = _pair(original, enhanced)
    in_mb, out_mb = F.col("in_size_bytes") / MB, F.col("size_bytes") / MB
    in_px = F.col("in_width").cast("double") * F.col("in_height")
    out_px = F.col("width").cast("double") * F.col("height")
    growth = ratio(out_mb, in_mb)
    return df.select(
        "asset_id",
        in_mb.alias("original_mb"),
        out_mb.alias("enhanced_mb"),
        growth.alias("size_ratio"),
        ratio(out_px, in_px).alias("pixel_ratio"),
        ratio(out_mb, out_px / 1e6).alias("mb_per_megapixel"),
        F.when(growth > 10, F.lit("compress")).when(growth < 2, F.lit("reasonable")).alias("advice"),
    )


def av_sync(output: DataFrame) -> DataFrame:
    """Duration sync status, its score, and the variant that also compares start times."""
    diff = F.abs(F.col("duration_s") - F.col("audio_duration_s"))
    start = F.abs(F.col("start_s") - F.col("audio_start_s"))
    good, fix = F.lit("good"), F.lit("needs_adjustment")
    return output.select(
        "asset_id",
        diff.alias("difference_s"),
        F.when(diff < 0.1, good).otherwise(fix).alias("status"),
        F.when((diff < 0.1) & (start < 0.05), good).otherwise(fix).alias("status_with_start"),
        F.when(F.col("has_audio"), clamp(1.0 - diff / 2.0, 0.0, 1.0)).otherwise(1.0).alias("sync_score"),
    )
