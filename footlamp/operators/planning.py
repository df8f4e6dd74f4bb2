"""Planning rules over an asset table.

Presets, factors and model needs are small fixed tables and enter as literal expressions, so every plan
is a narrow projection: no join, no shuffle. Only host and model choice join, on bounded tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.functions.scalars import clamp, codes, lookup, ratio, trunc
from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import running_sums

HD, FULL_HD, UHD = 1280 * 720, 1920 * 1080, 3840 * 2160
MB = 1024 * 1024

# Quality presets.
TILE_SIZE = {"fast": 512, "balanced": 768, "high": 1024}
DENOISE = {"fast": 0.5, "balanced": 0.7, "high": 0.9}
BATCH = {"fast": 4, "balanced": 2, "high": 1}
MEMORY_USAGE = {"fast": 0.6, "balanced": 0.7, "high": 0.8}
TILE_FACTOR = {"fast": 0.8, "balanced": 1.0, "high": 1.2}
BATCH_FACTOR = {"fast": 1.5, "balanced": 1.0, "high": 0.8}
LOAD_FACTOR = {"fast": 1.0, "balanced": 1.5, "high": 2.0}
TIME_FACTOR = {"fast": 1.0, "balanced": 2.0, "high": 4.0}
# Venues.
VENUE_DISTANCE = {"small": 8.0, "medium": 15.0, "large": 25.0}
VENUE_REVERB = {"small": 1.2, "medium": 1.8, "large": 2.5}
VENUE_NOISE_LEVEL = {"small": 0.3, "medium": 0.4, "large": 0.5}
VENUE_BOOST = {"small": 6.0, "medium": 4.0, "large": 2.0}
VENUE_NOISE_CUT = {"small": 0.7, "medium": 0.5, "large": 0.3}
VENUE_TIME = {"small": 0.8, "medium": 1.0, "large": 1.2}
VENUE_DENOISE = {"small": 0.8, "medium": 1.0, "large": 1.2}
VENUE_BATCH = {"small": 1.2, "medium": 1.0, "large": 0.8}
RECOMMENDED = [
    ("small", "fast"), ("small", "balanced"), ("medium", "balanced"),
    ("medium", "high"), ("large", "balanced"), ("large", "high"),
]


def pixels(w: str = "width", h: str = "height") -> Column:
    return F.col(w).cast("bigint") * F.col(h)


def aspect(w: str = "width", h: str = "height") -> Column:
    return ratio(F.col(w), F.col(h))


def _grid8(value: Column, lo: int = 256, hi: int = 1024) -> Column:
    """Round down to a multiple of 8, then clamp."""
    return clamp(F.floor(value / 8) * 8, lo, hi)


def _shape_tile(side: Column) -> tuple[Column, Column]:
    wide, tall = aspect() > 2.0, aspect() < 0.8
    w = F.when(wide, trunc(side * 1.2)).when(tall, trunc(side * 0.8)).otherwise(side)
    h = F.when(wide, trunc(side * 0.8)).when(tall, trunc(side * 1.2)).otherwise(side)
    return _grid8(w), _grid8(h)


def _tile_mb(w: str, h: str) -> Column:
    return F.col(w).cast("double") * F.col(h) * 3 * 2 * 4 / MB


def plan_tiles(assets: DataFrame, mem_mb: Column, max_usage: float = 0.7) -> DataFrame:
    """Tile size, overlap, batch size and memory for an asset at a memory budget."""
    w, h = _shape_tile(lookup(F.col("quality"), TILE_SIZE, 768))
    fit = trunc((mem_mb * max_usage - 500) / _tile_mb("tile_w", "tile_h"))
    return (
        assets.withColumn("tile_w", w)
        .withColumn("tile_h", h)
        .withColumn("overlap", clamp(F.floor(F.col("tile_w") / 16), 32, 64))
        .withColumn("batch", F.least(F.lit(8), F.greatest(F.lit(1), fit)))
        .withColumn("tile_memory_mb", trunc(_tile_mb("tile_w", "tile_h") * F.col("batch") + 500))
    )


def plan_strategy(assets: DataFrame, mem_mb: int = 4000, max_usage: float = 0.7) -> DataFrame:
    """Target resolution, GPU use and memory limit on top of the tile plan."""
    base = trunc(F.lit(float(mem_mb)) * max_usage)
    limit = (
        F.when(pixels() >= UHD, trunc(base * 1.5)).when(pixels() <= HD, trunc(base * 0.7)).otherwise(base)
    )
    return (
        plan_tiles(assets, F.lit(mem_mb), max_usage)
        .withColumn("target_w", F.when(aspect() >= 16 / 9 - 0.1, 3840).otherwise(2880))
        .withColumn("target_h", F.lit(2160))
        .withColumn(
            "use_gpu",
            ((pixels() >= FULL_HD) & F.col("quality").isin("balanced", "high")) | (pixels() >= UHD),
        )
        .withColumn("memory_limit_mb", F.greatest(limit, F.col("tile_memory_mb") + 1000))
        .withColumn("denoise", lookup(F.col("quality"), DENOISE, 0.7))
    )


def plan_adaptive(assets: DataFrame, max_usage: float = 0.7) -> DataFrame:
    """Plan from pixels, duration, quality and ``mem_mb`` of the asset row."""
    mem, q = F.col("mem_mb"), F.col("quality")
    complexity = (
        F.when(pixels() >= UHD, F.lit("high"))
        .when(pixels() >= FULL_HD, F.when(F.col("duration_s") > 3600, F.lit("high")).otherwise(F.lit("medium")))
        .otherwise(F.lit("low"))
    )
    by_width = F.when(F.col("width") >= 3840, 1.2).when(F.col("width") >= 1920, 1.0).otherwise(0.8)
    by_memory = F.when(mem < 4000, 0.8).when(mem > 8000, 1.2).otherwise(1.0)
    side = _grid8(trunc(lookup(q, TILE_SIZE, 768) * by_width * by_memory))
    w, h = _shape_tile(side)
    base_overlap = F.floor(F.floor((F.col("tile_w") + F.col("tile_h")) / 2) / 16)
    overlap = trunc(base_overlap * lookup(F.col("complexity_level"), {"low": 0.8, "medium": 1.0, "high": 1.2}))
    fit = F.greatest(F.lit(1), trunc((mem * max_usage - 1000) / _tile_mb("tile_w", "tile_h")))
    batch = clamp(trunc(fit * lookup(q, BATCH_FACTOR, 1.0)), 1, 8)
    base = trunc(mem * max_usage)
    limit = F.when(pixels() >= UHD, 1.3).when(pixels() >= FULL_HD, 1.0).otherwise(0.7)
    frames = trunc(F.col("duration_s") * F.col("fps"))
    load = pixels().cast("double") * frames * lookup(q, LOAD_FACTOR, 1.0)
    is_4k = (F.col("width") >= 3840) & (F.col("height") >= 2160)
    other_w = F.floor(trunc(F.lit(2160) * aspect()) / 2) * 2
    target_w = (
        F.when(is_4k, F.col("width").cast("bigint"))
        .when(aspect() >= 16 / 9 - 0.1, F.lit(3840).cast("bigint"))
        .when(aspect() >= 4 / 3 - 0.1, F.lit(2880).cast("bigint"))
        .otherwise(other_w)
    )
    return (
        assets.withColumn("complexity_level", complexity)
        .withColumn("tile_w", w)
        .withColumn("tile_h", h)
        .withColumn("overlap", clamp(overlap, 16, 128))
        .withColumn("batch", batch)
        .withColumn("memory_limit_mb", F.greatest(F.lit(2000), trunc(base * limit)))
        .withColumn("target_w", target_w)
        .withColumn("target_h", F.when(is_4k, F.col("height").cast("bigint")).otherwise(2160))
        .withColumn("load", load)
        .withColumn("hours", load / (FULL_HD * 30.0 * 3600))
        .withColumn("use_gpu", ~((pixels() < FULL_HD) & (q == "fast")))
    )


def rescale_plan(plan: DataFrame, quality: str = "quality") -> DataFrame:
    """Multiply tile, overlap and batch by the quality factors and clamp again."""
    f, b = lookup(F.col(quality), TILE_FACTOR, 1.0), lookup(F.col(quality), BATCH_FACTOR, 1.0)
    return (
        plan.withColumn("tile_w", _grid8(trunc(F.col("tile_w") * f)))
        .withColumn("tile_h", _grid8(trunc(F.col("tile_h") * f)))
        .withColumn("overlap", clamp(trunc(F.col("overlap") * f), 16, 128))
        .withColumn("batch", clamp(trunc(F.col("batch") * b), 1, 16))
        .withColumn("denoise", lookup(F.col(quality), DENOISE, 0.7))
    )


def estimate_cost(assets: DataFrame, input_gb: Column | None = None) -> DataFrame:
    """Scale, tile, time, memory and output size of an offline run; input size is a parameter."""
    gb = F.lit(0.76) if input_gb is None else input_gb
    grow = ratio(3840.0, F.col("width"))
    scale = F.when(grow <= 1.5, 1).when(grow <= 2.5, 2).when(grow <= 3.5, 3).otherwise(4)
    base = F.when(pixels() > FULL_HD, 400).when(pixels() < HD, 640).otherwise(512)
    cx = F.col("complexity")
    tile = (
        F.when(cx == "complex", F.least(base, F.lit(400)))
        .when(cx == "simple", F.least(base + 128, F.lit(640)))
        .otherwise(base)
    )
    df = assets.withColumn("scale", scale).withColumn("tile", tile)
    t, s = F.col("tile"), F.col("scale")
    per_frame = (
        F.lit(0.5) * (pixels() / FULL_HD) * F.pow(s, 1.5)
        * lookup(cx, {"complex": 1.3, "simple": 0.8}, 1.0) * (F.lit(512.0) / t)
    )
    gib = 1024.0**3
    return (
        df.withColumn("batch", F.when(t >= 512, 1).when(t >= 400, 2).otherwise(4))
        .withColumn("denoise_level", F.when(F.col("lighting") == "stage", 2).otherwise(1))
        .withColumn("memory_optimised", (pixels() > FULL_HD) | (F.col("duration_s") > 1800))
        .withColumn("hours", F.round(F.col("duration_s") * 25 * per_frame / 3600, 1))
        .withColumn("memory_gb", F.round(2.0 + pixels() * 12 / gib + t * t * 24 / gib, 1))
        .withColumn("output_gb", F.round(gb * s * s * 1.2, 1))
        .withColumn(
            "tool",
            F.when(
                (F.col("lighting") == "natural") & (cx == "simple"), F.lit("fast_denoise")
            ).otherwise(F.lit("general_upscale")),
        )
    )


def upscale_path(assets: DataFrame, plan: Column) -> DataFrame:
    """Fold x2 / x4 steps over the size; a step that passes 4K lands exactly on 3840x2160."""
    start = F.struct(F.col("width").cast("bigint").alias("w"), F.col("height").cast("bigint").alias("h"))

    def step(size: Column, name: Column) -> Column:
        k = F.when(name == "x2", 2).otherwise(4)
        w, h = size["w"] * k, size["h"] * k
        over = (w > 3840) | (h > 2160)
        done = (size["w"] >= 3840) & (size["h"] >= 2160)
        return F.struct(
            F.when(done, size["w"]).when(over, F.lit(3840).cast("bigint")).otherwise(w).alias("w"),
            F.when(done, size["h"]).when(over, F.lit(2160).cast("bigint")).otherwise(h).alias("h"),
        )

    out = F.aggregate(plan, start, step)
    return assets.withColumn("out_w", out["w"]).withColumn("out_h", out["h"])


def resolution_plan() -> Column:
    """Two x2 steps up to 1080p input, else one."""
    small = (F.col("width") <= 1920) & (F.col("height") <= 1080)
    return F.when(small, F.array(F.lit("x2"), F.lit("x2"))).otherwise(F.array(F.lit("x2")))


# Memory profile per model class (base, per tile, gpu, temporary file factor).
PROFILES = {
    "ai": (500, 50, 1000, 2.0),
    "video": (200, 20, 500, 1.5),
    "audio": (100, 5, 0, 1.2),
}


def plan_tiles_by_memory(assets: DataFrame, safety: float = 0.7) -> DataFrame:
    """Largest tiles that fit ``free_mb`` / ``gpu_mb`` next to a model of ``model_mb``."""
    need = F.col("model_mb")
    kind = F.when(need > 800, F.lit("ai")).when(need > 200, F.lit("video")).otherwise(F.lit("audio"))
    df = assets.withColumn("profile", kind)
    part = [lookup(F.col("profile"), {k: v[i] for k, v in PROFILES.items()}) for i in range(4)]
    safe, safe_gpu = trunc(F.col("free_mb") * safety), trunc(F.col("gpu_mb") * safety)
    df = df.withColumn("mode", F.when((safe_gpu >= need) & (F.col("gpu_mb") > 0), F.lit("gpu")).otherwise(F.lit("cpu")))
    gpu = F.col("mode") == "gpu"
    df = df.withColumn("per_tile", F.when(gpu, part[1]).otherwise(part[1] * 2))
    df = df.withColumn(
        "for_tiles", F.greatest(F.when(gpu, safe_gpu - part[2]).otherwise(safe - part[0]), F.col("per_tile"))
    )
    df = df.withColumn("max_tiles", F.greatest(F.lit(1), F.floor(F.col("for_tiles") / F.col("per_tile"))))
    side = trunc(F.sqrt(pixels() / F.col("max_tiles")))
    a = aspect()
    w = F.when(a > 1, trunc(side * F.sqrt(a))).otherwise(trunc(side / F.sqrt(1 / a)))
    h = F.when(a > 1, trunc(side / F.sqrt(a))).otherwise(trunc(side * F.sqrt(1 / a)))
    df = df.withColumn("tile_w", F.floor(F.greatest(F.least(w, F.col("width")), F.lit(64)) / 8) * 8)
    df = df.withColumn("tile_h", F.floor(F.greatest(F.least(h, F.col("height")), F.lit(64)) / 8) * 8)
    area = F.col("tile_w") * F.col("tile_h")
    cap = F.when(area > MB, 2).when(area > 512 * 512, 4).otherwise(8)
    overlap = clamp(trunc(F.least("tile_w", "tile_h") * 0.05), 16, 128)
    temp = F.greatest(F.lit(100), F.floor(pixels() * 3 / MB) * 2)
    return (
        df.withColumn("batch", F.least(F.col("max_tiles"), cap))
        .withColumn("overlap", F.floor(overlap / 8) * 8)
        .withColumn("memory_mb", part[0] + F.col("batch") * F.col("per_tile") + trunc(temp * part[3]))
    )


# Model registry in preference order (name, need in MB, runs on GPU, is neural).
MODELS = [
    ("real_esrgan_x4", 1000, True, True),
    ("real_esrgan_x2", 800, True, True),
    ("opencv_cubic", 50, False, False),
]


def choose_model(assets: DataFrame) -> DataFrame:
    """Best model that fits ``free_mb``; GPU models first when the row has one.

    The registry is a fixed handful of models, so the theta join is a filter over a literal array.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("priority"), F.lit(n).alias("model"), F.lit(mb).alias("need_mb"),
                F.lit(g).alias("on_gpu"), F.lit(x).alias("neural"),
            )
            for i, (n, mb, g, x) in enumerate(MODELS)
        ]
    )
    fits = F.filter(rows, lambda m: m["need_mb"] <= F.col("free_mb"))
    df = assets.withColumn("__fits", fits)
    on_gpu = F.filter("__fits", lambda m: m["on_gpu"])
    df = df.withColumn("__fits", F.when(F.col("has_gpu") & (F.size(on_gpu) > 0), on_gpu).otherwise(F.col("__fits")))
    neural = F.filter("__fits", lambda m: m["neural"])
    best = F.when(F.size(neural) > 0, F.get(neural, F.lit(0))["model"]).when(
        F.size("__fits") > 0, F.get(F.col("__fits"), F.lit(0))["model"]
    )
    return df.withColumn("model", F.coalesce(best, F.lit("opencv_cubic"))).drop("__fits")


def preset_fields(df: DataFrame) -> DataFrame:
    """Preset values of the (venue, quality) pair of each row."""
    v, q = F.col("venue"), F.col("quality")
    tile, batch = lookup(q, TILE_SIZE), lookup(q, BATCH)
    est = F.floor(tile * tile * 12 * batch / MB)
    recommended = F.lit(False)
    for venue, quality in RECOMMENDED:
        recommended = recommended | ((v == venue) & (q == quality))
    return df.select(
        "*",
        tile.alias("tile_size"),
        batch.alias("batch"),
        lookup(q, DENOISE).alias("denoise"),
        lookup(q, MEMORY_USAGE).alias("memory_usage"),
        lookup(v, VENUE_BOOST).alias("dialogue_boost"),
        lookup(v, VENUE_NOISE_CUT).alias("noise_reduction"),
        F.least(F.lit(0.9), lookup(v, VENUE_REVERB) / 3.0).alias("reverb_reduction"),
        F.least(F.lit(0.8), F.lit(0.3) + lookup(v, VENUE_DISTANCE) / 50.0).alias("spatial"),
        (F.lit(0.2) + lookup(v, VENUE_NOISE_LEVEL) * 0.3).alias("compression"),
        est.alias("estimated_mb"),
        trunc(est / lookup(q, MEMORY_USAGE)).alias("system_mb"),
        (lookup(q, TIME_FACTOR) * lookup(v, VENUE_TIME)).alias("time_factor"),
        recommended.alias("recommended"),
    )


def preset_matrix(assets: DataFrame) -> DataFrame:
    """Every venue and quality pair with its preset and number of assets, 0 for pairs that no asset has."""
    used = assets.groupBy("venue", "quality").agg(F.count(F.lit(1)).alias("n_assets"))
    pairs = ", ".join(f"('{v}', '{q}')" for v in VENUE_TIME for q in TIME_FACTOR)
    every = assets.sparkSession.sql(f"SELECT * FROM VALUES {pairs} AS t(venue, quality)")
    return preset_fields(every.join(used, ["venue", "quality"], "left").withColumn("n_assets", F.coalesce("n_assets", F.lit(0).cast("bigint"))))


def adjust_for_venue(plan: DataFrame) -> DataFrame:
    """Scale denoise and batch by venue; an unknown venue counts as medium."""
    v = F.col("venue")
    return plan.withColumn("denoise", F.col("denoise") * lookup(v, VENUE_DENOISE, 1.0)).withColumn(
        "batch", F.greatest(F.lit(1), trunc(F.col("batch") * lookup(v, VENUE_BATCH, 1.0)))
    )


# Override validators (closed ranges; whole numbers where marked).
OVERRIDES = {
    "denoise_strength": (0.0, 1.0, False),
    "dialogue_boost": (0.0, 20.0, False),
    "noise_reduction": (0.0, 1.0, False),
    "reverb_reduction": (0.0, 1.0, False),
    "tile_size": (64.0, 2048.0, True),
    "batch_size": (1.0, 16.0, True),
    "memory_usage": (0.1, 0.9, False),
}


def apply_overrides(preset: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replace base values by valid overrides; one invalid value rejects the whole override set.

    ``preset`` has one column per parameter, ``overrides`` is (preset_id, key, value). Unknown keys are
    ignored.
    """
    key, value = F.col("key"), F.col("value")
    ok = F.lit(None).cast("boolean")
    for name, (lo, hi, whole) in OVERRIDES.items():
        fine = value.between(lo, hi)
        if whole:
            fine = fine & (value == F.floor(value))
        ok = F.when(key == name, F.coalesce(fine, F.lit(False))).otherwise(ok)
    judged = overrides.select("preset_id", "key", "value", ok.alias("ok")).where(F.col("ok").isNotNull())
    wide = judged.groupBy("preset_id").agg(
        F.bool_and("ok").alias("accepted"),
        *[F.max(F.when(key == n, value)).alias(f"o_{n}") for n in OVERRIDES],
    )
    joined = preset.join(wide, "preset_id", "left")
    accepted = F.coalesce("accepted", F.lit(True))
    base = {n: F.col(n).cast("double") for n in OVERRIDES if n in preset.columns}
    return joined.select(
        "preset_id",
        accepted.alias("accepted"),
        *[
            F.when(accepted, F.coalesce(F.col(f"o_{n}"), c)).otherwise(c).alias(n)
            for n, c in base.items()
        ],
    )


def space_check(files: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per file: need = 4 x size against 1.2 x need free, alone and after all files queued before it.

    The queue of a volume may be long, so the running need is carried over chunks of file ids.
    """
    queued = running_sums(
        files, ["volume"], ["file_id"], F.floor(F.col("file_id") / 65536).cast("bigint"),
        {"queued_bytes": F.col("size_bytes").cast("decimal(38,0)") * 4},
    )
    need = F.col("size_bytes").cast("double") * 4
    return (
        join_per_key(queued, volumes, ["volume"], "file_id")
        .withColumn("fits_alone", F.col("free_bytes") > need * 1.2)
        .withColumn("fits_in_queue", F.col("free_bytes") > F.col("queued_bytes").cast("double") * 1.2)
    )


REQUIRED_DEPENDENCIES = 5


def score_hosts(hosts: DataFrame, min_version: str = "4.5") -> DataFrame:
    """Ten-point suitability score with feature and speed tiers and a dotted version check."""
    ram, cores = F.col("ram_gb"), F.col("cores")
    cuda = F.col("gpu") & F.col("cuda")
    found = F.least(F.col("deps_found"), F.lit(REQUIRED_DEPENDENCIES))
    score = (
        F.when(F.col("os").isin("Windows", "Linux", "Darwin"), 2.0).otherwise(0.0)
        + F.when(ram >= 16, 2.0).when(ram >= 8, 1.5).when(ram >= 4, 1.0).otherwise(0.0)
        + F.when(cores >= 8, 2.0).when(cores >= 4, 1.5).when(cores >= 2, 1.0).otherwise(0.0)
        + F.when(cuda, 2.0).when(F.col("gpu"), 1.0).otherwise(0.0)
        + found / F.lit(float(REQUIRED_DEPENDENCIES)) * 2.0
    )
    parts = F.transform(F.split("version", r"\."), lambda p: p.try_cast("int"))
    wanted = [int(p) for p in min_version.split(".")]
    newest = F.lit(True)
    for i in reversed(range(max(3, len(wanted)))):
        have = F.coalesce(F.get(parts, F.lit(i)), F.lit(0))
        want = wanted[i] if i < len(wanted) else 0
        newest = F.when(have > want, True).when(have < want, False).otherwise(newest)
    missing = F.lit(REQUIRED_DEPENDENCIES) - found
    return hosts.select(
        "*",
        F.least(F.lit(10.0), score).alias("score"),
        codes(
            F.when(~F.col("os").isin("Windows", "Linux", "Darwin"), F.lit("platform")),
            F.when(ram < 4, F.lit("memory")),
            F.when(cores < 2, F.lit("cores")),
            F.when(missing > 0, F.concat(F.lit("dependencies:"), missing.cast("string"))),
        ).alias("issues"),
        F.when(ram >= 8, F.lit("full")).when(ram >= 4, F.lit("limited")).otherwise(F.lit("basic")).alias("video_tier"),
        F.when(cuda, F.lit("gpu")).when(ram >= 16, F.lit("cpu")).otherwise(F.lit("none")).alias("upscale_tier"),
        F.when((cores >= 4) & (ram >= 8), F.lit("efficient")).otherwise(F.lit("sequential")).alias("batch_tier"),
        F.when(
            cuda,
            F.when(F.col("gpu_gb") >= 8, F.lit("very_fast"))
            .when(F.col("gpu_gb") >= 4, F.lit("fast"))
            .otherwise(F.lit("moderate")),
        )
        .when(cores >= 8, F.lit("moderate"))
        .otherwise(F.lit("slow"))
        .alias("speed_tier"),
        F.when(ram >= 32, F.lit("excellent"))
        .when(ram >= 16, F.lit("good"))
        .when(ram >= 8, F.lit("adequate"))
        .otherwise(F.lit("limited"))
        .alias("memory_tier"),
        F.when(missing == 0, F.lit("high")).when(missing <= 2, F.lit("medium")).otherwise(F.lit("low")).alias("stability"),
        newest.alias("version_ok"),
    )
