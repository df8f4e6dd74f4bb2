"""Frame sampling, measures, classes and quality scores.

Input is frame(asset_id, frame_no, w, h, luma) with packed pixels. Pixel work happens in the task that
reads the frame; only per-frame rows are shuffled. Operators that look at the frame before use the
chunked window helper, so a long recording is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footlamp.functions import kernels as K
from footlamp.functions.pixels import at, explode_pixels, laplacian, sobel_magnitude
from footlamp.functions.scalars import clamp
from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import sliding

KEY = ["asset_id", "frame_no"]
FRAME_BLOCK = 1024
STATIC_BELOW = 0.02

edge_share = K.frame_udf(K.edge_share, "double")


# Sampling -----------------------------------------------------------------------------------------


def _with_total(frames: DataFrame, total: DataFrame | None) -> DataFrame:
    """Add ``total``, the frame count of the asset.

    ``total`` is (asset_id, total) when the asset table already knows it. The join is one lazy plan at any size: Spark
    sends the summary out where it is small and else splits an asset over many tasks.
    """
    if total is None:
        total = frames.groupBy("asset_id").agg((F.max("frame_no") + 1).alias("total"))
    return join_per_key(frames, total, ["asset_id"], "frame_no")


def sample_frames(frames: DataFrame, n: int | None, total: DataFrame | None = None) -> DataFrame:
    """All frames when there are at most ``n`` or ``n`` is None, else every ``total // n``-th; adds ``sample_no``."""
    df = _with_total(frames, total)
    if n is None:
        return df.withColumn("sample_no", F.col("frame_no"))
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n)).cast("bigint")
    idx = F.floor(F.col("frame_no") / step).cast("bigint")
    keep = (F.col("frame_no") % step == 0) & ((F.col("total") <= n) | (idx < n))
    return df.where(keep).withColumn("sample_no", idx)


def sample_linspace(frames: DataFrame, n: int = 10, total: DataFrame | None = None) -> DataFrame:
    """Frames at the truncated points of an even grid from first to last."""
    df = _with_total(frames, total)
    step = (F.col("total") - 1) / F.lit(float(n - 1))
    grid = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * step).cast("bigint"))
    return df.where(F.array_contains(grid, F.col("frame_no")))


def sample_every(frames: DataFrame, step: int, limit: int | None = None) -> DataFrame:
    """Every ``step``-th frame, the first ``limit`` of them if given; needs no totals."""
    idx = F.floor(F.col("frame_no") / step).cast("bigint")
    keep = F.col("frame_no") % step == 0
    return frames.where(keep if limit is None else keep & (idx < limit)).withColumn("sample_no", idx)


def sample_stride(frames: DataFrame, n: int = 50, total: DataFrame | None = None) -> DataFrame:
    """The first ``n`` frames at stride max(1, total // n)."""
    df = _with_total(frames, total)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n)).cast("bigint")
    idx = F.floor(F.col("frame_no") / step).cast("bigint")
    return df.where((F.col("frame_no") % step == 0) & (idx < n)).withColumn("sample_no", idx)


def with_previous(frames: DataFrame, seq: str = "frame_no", array: str = "luma", n: int = 1) -> DataFrame:
    """Add the packed frame(s) before as ``prev`` (and ``prev2``)."""

    def make(w):
        out = {"prev": F.lag(array, 1).over(w)}
        if n > 1:
            out["prev2"] = F.lag(array, 2).over(w)
        return out

    return sliding(frames, ["asset_id"], seq, make, before=n, size=FRAME_BLOCK)


# Measures -----------------------------------------------------------------------------------------


def frame_measures(frames: DataFrame) -> DataFrame:
    """All pixel measures of a frame in one pass; ``prev`` is optional."""
    keys = [c for c in (*KEY, "sample_no", "total", "w", "h") if c in frames.columns]
    v = F.col("v")
    share = v / 255.0
    top, bottom = F.floor(F.col("h") / 3), F.floor(F.col("h") * 2 / 3)
    mag = F.col("__mag")
    aggs = [
        F.avg((share > 0.85).cast("int")).alias("highlight"),
        F.avg((share < 0.15).cast("int")).alias("dark"),
        F.avg(v).alias("brightness"),
        F.stddev_pop(v).alias("contrast"),
        F.var_pop("__lap").alias("laplacian_var"),
        F.avg(mag).alias("sharpness"),
        F.avg(F.when(F.col("y") < top, mag)).alias("top"),
        F.avg(F.when((F.col("y") >= top) & (F.col("y") < bottom), mag)).alias("middle"),
        F.avg(F.when(F.col("y") >= bottom, mag)).alias("bottom"),
    ]
    px = explode_pixels(frames).withColumn("__lap", laplacian()).withColumn("__mag", sobel_magnitude())
    if "prev" in frames.columns:
        aggs.append(F.avg(F.abs(v - F.get("prev", F.col("p")))).alias("change"))
    if "edges" in frames.columns:
        aggs.append(F.first("edges").alias("edges"))
    return px.groupBy(*keys).agg(*aggs)


def lighting_ratios(frames: DataFrame) -> DataFrame:
    v = F.col("v") / 255.0
    per = explode_pixels(frames.select(*KEY, "w", "h", "luma")).groupBy(*KEY).agg(
        F.avg((v > 0.85).cast("int")).alias("hi"), F.avg((v < 0.15).cast("int")).alias("lo")
    )
    return per.groupBy("asset_id").agg(
        F.avg("hi").alias("highlight"),
        F.avg("lo").alias("dark"),
        F.avg(1.0 - F.col("hi") - F.col("lo")).alias("midtone"),
    )


def edge_density(frames: DataFrame) -> DataFrame:
    return frames.groupBy("asset_id").agg(F.avg(edge_share("luma", "w", "h")).alias("edge_density"))


def frame_change(frames: DataFrame, seq: str = "sample_no") -> DataFrame:
    """Mean change between consecutive samples; a single frame counts as 0 and as static."""
    pairs = with_previous(frames.select("asset_id", seq, "w", "h", "luma"), seq)
    px = explode_pixels(pairs)
    diff = F.abs(F.col("v") - F.get("prev", F.col("p"))) / 255.0
    per = px.groupBy("asset_id", seq).agg(F.avg(diff).alias("d"))
    out = per.groupBy("asset_id").agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("frame_change"))
    return out.withColumn("is_static", F.col("frame_change") < STATIC_BELOW)


def noise_score(frames: DataFrame) -> DataFrame:
    # a moment aggregate reads its argument many times, so the stencil is computed in a projection first
    px = explode_pixels(frames.select(*KEY, "w", "h", "luma")).select(*KEY, laplacian().alias("lap"))
    per = px.groupBy(*KEY).agg(F.least(F.lit(1.0), F.var_pop("lap") / 1000.0).alias("n"))
    return per.groupBy("asset_id").agg(F.avg("n").alias("noise_score"))


def structure_features(frames: DataFrame, n: int | None = None, fps: float = 25.0, total: DataFrame | None = None) -> DataFrame:
    """The feature record of an asset: every measure in one pass over all its frames, or over ``n`` samples."""
    sampled = with_previous(sample_frames(frames, n, total), "sample_no")
    sampled = sampled.withColumn("edges", edge_share("luma", "w", "h"))
    per = frame_measures(sampled)
    out = per.groupBy("asset_id").agg(
        F.max("w").alias("width"),
        F.max("h").alias("height"),
        F.max("total").alias("total_frames"),
        F.avg("highlight").alias("highlight"),
        F.avg("dark").alias("dark"),
        F.avg(1.0 - F.col("highlight") - F.col("dark")).alias("midtone"),
        F.avg("edges").alias("edge_density"),
        F.coalesce(F.avg(F.col("change") / 255.0), F.lit(0.0)).alias("frame_change"),
        F.avg(F.least(F.lit(1.0), F.col("laplacian_var") / 1000.0)).alias("noise_score"),
    )
    return (
        out.withColumn("fps", F.lit(fps))
        .withColumn("duration_s", F.col("total_frames") / fps)
        .withColumn("is_static", F.col("frame_change") < STATIC_BELOW)
    )


def plan_enhancement(features: DataFrame) -> DataFrame:
    """Enhancement plan per asset; the derived venue is kept as a column."""
    w, h = F.col("width"), F.col("height")
    px = w.cast("bigint") * h
    hi, edge, noise = F.col("highlight"), F.col("edge_density"), F.col("noise_score")
    lock = F.col("is_static") & (F.col("frame_change") < STATIC_BELOW)

    def f3(name: str) -> Column:
        return F.expr(f"replace(format_number({name}, '0.000'), ',', '')")

    text = F.concat(
        w.cast("string"), F.lit("x"), h.cast("string"),
        F.lit("_"), F.expr("format_number(fps, '0.00')"), F.lit("fps_static:"),
        F.when(F.col("is_static"), F.lit("True")).otherwise(F.lit("False")),
        F.lit("_highlight:"), f3("highlight"), F.lit("_edge:"), f3("edge_density"),
        F.lit("_motion:"), f3("frame_change"), F.lit("_noise:"), f3("noise_score"),
    )
    two = (w <= 1920) & (h <= 1080)
    return features.select(
        "asset_id",
        F.when(two, F.lit("x2,x2")).otherwise(F.lit("x2")).alias("resolution_plan"),
        (hi <= 0.2).alias("gan_allowed"),
        F.when(hi > 0.2, F.lit("medium"))
        .when(noise > 0.25, F.lit("weak"))
        .when(edge > 0.3, F.lit("strong"))
        .otherwise(F.lit("medium"))
        .alias("gan_strength"),
        lock.alias("background_lock"),
        F.when(lock, F.lit("high")).otherwise(F.lit("medium")).alias("temporal_strength"),
        F.when(px > 1920 * 1080, 256).when(px > 1280 * 720, 384).otherwise(512).alias("tile_size"),
        F.when(edge > 0.2, F.lit("small")).when(hi > 0.15, F.lit("large")).otherwise(F.lit("medium")).alias("venue"),
        F.substring(F.md5(text), 1, 16).alias("features_hash"),
    )


def blockiness(frames: DataFrame, block: int = 8, limit: int | None = None) -> DataFrame:
    """Step across the right and bottom border of the inner blocks, per block, as ``blockiness``.

    ``blockiness_wrapped`` keeps the 8-bit wrap-around of unsigned subtraction. ``limit`` keeps the first blocks only.
    """
    px = explode_pixels(frames.select(*KEY, "w", "h", "luma"))
    cols = F.ceil((F.col("w") - block) / block)
    rows = F.ceil((F.col("h") - block) / block)
    by, bx = F.floor(F.col("y") / block), F.floor(F.col("x") / block)
    used = (bx < cols) & (by < rows)
    if limit is not None:
        used = used & (by * cols + bx < limit)
    last_x, last_y = F.col("x") % block == block - 1, F.col("y") % block == block - 1

    right, down = F.col("v") - at(0, 1), F.col("v") - at(1, 0)

    def total(of) -> Column:
        return F.when(used & last_x, of(right)).otherwise(0) + F.when(used & last_y, of(down)).otherwise(0)

    n = F.greatest(cols * rows, F.lit(0))
    n = n if limit is None else F.least(F.lit(limit), n)
    px = px.select(*KEY, total(F.abs).alias("t"), total(lambda d: F.pmod(d, F.lit(256))).alias("wrapped"), n.alias("n"))
    per = px.groupBy(*KEY).agg(F.sum("t").alias("t"), F.sum("wrapped").alias("wrapped"), F.max("n").alias("n"))

    def score(of: str) -> Column:
        return F.col(of) / block / 255.0 / F.greatest(F.col("n"), F.lit(1))

    return per.select(*KEY, score("t").alias("blockiness"), score("wrapped").alias("blockiness_wrapped"))


def quality_levels(frames: DataFrame, step: int = 1, block: int = 8, limit: int | None = None) -> DataFrame:
    """Average noise, sharpness, brightness, contrast and blockiness of all frames, or of every ``step``-th, with labels."""
    s = sample_every(frames, step, limit)
    per = frame_measures(s.drop("sample_no")).join(blockiness(s, block), KEY)
    avg = per.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        *[
            F.avg(c).alias(a)
            for c, a in (
                ("laplacian_var", "noise"), ("sharpness", "sharpness"), ("blockiness", "artifacts"),
                ("brightness", "brightness"), ("contrast", "contrast"),
            )
        ],
    )
    noise, sharp, art = F.col("noise"), F.col("sharpness"), F.col("artifacts")
    df = (
        avg.withColumn("noise_level", F.when(noise > 500, F.lit("low")).when(noise > 200, F.lit("moderate")).otherwise(F.lit("high")))
        .withColumn("sharpness_level", F.when(sharp > 30, F.lit("high")).when(sharp > 15, F.lit("moderate")).otherwise(F.lit("low")))
        .withColumn("artifact_level", F.when(art < 0.1, F.lit("low")).when(art < 0.2, F.lit("moderate")).otherwise(F.lit("high")))
    )
    issues = F.array_compact(
        F.array(
            F.when(F.col("noise_level") == "high", F.lit("noise")),
            F.when(F.col("sharpness_level") == "low", F.lit("sharpness")),
            F.when(F.col("artifact_level") == "high", F.lit("artifacts")),
        )
    )
    verdict = F.when(F.size(issues) == 0, F.lit("good")).when(F.size(issues) == 1, F.lit("moderate")).otherwise(F.lit("poor"))
    return df.withColumn("summary", F.concat_ws(":", verdict, F.array_join(issues, ",")))


# Classes ------------------------------------------------------------------------------------------


def lighting_class(frames: DataFrame, peaks: bool = False) -> DataFrame:
    """Per frame stage / natural / mixed from packed ``b``, ``g``, ``r``.

    ``peaks`` adds the variant that also limits strict local peaks of the 256-bin brightness histogram.
    """
    px = frames.select(*KEY, "b", "g", "r", F.posexplode("b").alias("p", "__b"))
    value = F.greatest(F.col("__b"), F.get("g", F.col("p")), F.get("r", F.col("p")))
    px = px.select(*KEY, value.alias("v"), F.col("__b"), F.get("r", F.col("p")).alias("__r"))
    per = px.groupBy(*KEY).agg(
        F.avg("v").alias("mean_v"),
        F.stddev_pop("v").alias("std_v"),
        (F.avg("__r") / (F.avg("__b") + 1)).alias("warmth"),
    )
    stage = (F.col("std_v") > 60) & (F.col("warmth") > 1.2)
    natural = (F.col("mean_v") > 120) & (F.col("std_v") < 40)
    per = per.withColumn("lighting", F.when(stage, F.lit("stage")).when(natural, F.lit("natural")).otherwise(F.lit("mixed")))
    if not peaks:
        return per
    # at most 256 bins per frame, so a per-frame window is bounded
    w = Window.partitionBy(*KEY).orderBy("v")
    bins = px.groupBy(*KEY, "v").agg(F.count(F.lit(1)).alias("n"))
    left = F.when(F.lag("v").over(w) == F.col("v") - 1, F.lag("n").over(w)).otherwise(0)
    right = F.when(F.lead("v").over(w) == F.col("v") + 1, F.lead("n").over(w)).otherwise(0)
    marked = bins.withColumn("__l", left).withColumn("__r", right)
    is_peak = F.col("v").between(1, 254) & (F.col("n") > F.col("__l")) & (F.col("n") > F.col("__r"))
    counted = marked.groupBy(*KEY).agg(F.count_if(is_peak).alias("n_peaks"))
    few = (stage & (F.col("n_peaks") <= 3), natural & (F.col("n_peaks") <= 2))
    return per.join(counted, KEY).withColumn(
        "lighting_peaks", F.when(few[0], F.lit("stage")).when(few[1], F.lit("natural")).otherwise(F.lit("mixed"))
    )


def complexity_class(measures: DataFrame) -> DataFrame:
    """Needs ``edges`` and ``laplacian_var``; with ``colour_std`` it also gives the colour variant."""
    e, lap = F.col("edges"), F.col("laplacian_var")

    def cls(high: Column, mid: Column) -> Column:
        return F.when(high, F.lit("complex")).when(mid, F.lit("moderate")).otherwise(F.lit("simple"))

    high, mid = (e > 0.15) | (lap > 1000), (e > 0.08) | (lap > 500)
    out = measures.withColumn("complexity", cls(high, mid))
    if "colour_std" in measures.columns:
        c = F.col("colour_std")
        out = out.withColumn("complexity_colour", cls(high | (c > 40), mid | (c > 25)))
    return out


def colour_std(frames: DataFrame) -> DataFrame:
    """Mean over channels of the per-channel deviation of each frame."""
    px = frames.select(*KEY, "g", "r", F.posexplode("b").alias("p", "b"))
    per = px.groupBy(*KEY).agg(
        F.stddev_pop("b").alias("__b"),
        F.stddev_pop(F.get("g", F.col("p"))).alias("__g"),
        F.stddev_pop(F.get("r", F.col("p"))).alias("__r"),
    )
    return per.select(*KEY, ((F.col("__b") + F.col("__g") + F.col("__r")) / 3).alias("colour_std"))


def depth_class(measures: DataFrame) -> DataFrame:
    ratio = (F.col("top") + F.col("middle")) / (F.col("bottom") + 1)
    return (
        measures.withColumn("depth_ratio", ratio)
        .withColumn("depth", F.when(ratio > 1.5, F.lit("deep")).when(ratio > 0.8, F.lit("medium")).otherwise(F.lit("shallow")))
        .withColumn("depth_score", F.least(ratio / 2.0, F.lit(1.0)))
    )


def composition_class(frames: DataFrame) -> DataFrame:
    """Centre cell against four overlapping border bands, so corners weigh twice."""
    px = explode_pixels(frames.select(*KEY, "w", "h", "luma"))
    y1, y2 = F.floor(F.col("h") / 3), F.floor(F.col("h") * 2 / 3)
    x1, x2 = F.floor(F.col("w") / 3), F.floor(F.col("w") * 2 / 3)
    y, x, v = F.col("y"), F.col("x"), F.col("v")
    band = sum(((c).cast("int") for c in (y < y1, y >= y2, x < x1, x >= x2)), F.lit(0))
    centre = (y >= y1) & (y < y2) & (x >= x1) & (x < x2)
    per = px.groupBy(*KEY).agg(
        F.avg(F.when(centre, v)).alias("__c"), (F.sum(v * band) / F.sum(band)).alias("__e")
    )
    ratio = F.col("__c") / (F.col("__e") + 1)
    return per.select(
        *KEY,
        ratio.alias("composition_ratio"),
        F.when(ratio > 1.3, F.lit("proscenium")).when(ratio > 0.8, F.lit("thrust")).otherwise(F.lit("arena")).alias("composition"),
    )


# Declaration order of the classes decides ties.
VOTE_ORDER = {
    "lighting": ["stage", "natural", "mixed"],
    "complexity": ["simple", "moderate", "complex"],
    "depth": ["shallow", "medium", "deep"],
}


def scene_vote(classified: DataFrame) -> DataFrame:
    """Most frequent class per asset, actor estimate, model and priority.

    Votes are conditional counts over the closed class lists: one aggregation, no window.
    """
    counts = [
        F.count_if(F.col(kind) == name).alias(f"{kind}_{name}") for kind, names in VOTE_ORDER.items() for name in names
    ]
    df = classified.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_frames"), *counts)
    for kind, names in VOTE_ORDER.items():
        best = F.greatest(*[F.col(f"{kind}_{n}") for n in names])
        pick = F.lit(names[-1])
        for n in reversed(names[:-1]):
            pick = F.when(F.col(f"{kind}_{n}") == best, F.lit(n)).otherwise(pick)
        df = df.withColumn(kind, pick)
    complex_share = F.col("complexity_complex") / F.col("n_frames")
    moderate_share = F.col("complexity_moderate") / F.col("n_frames")
    return df.select(
        "asset_id",
        "n_frames",
        *VOTE_ORDER,
        F.when(complex_share > 0.6, 5).when((complex_share > 0.3) | (moderate_share > 0.7), 3).otherwise(2).alias("actors"),
        F.when((F.col("lighting") == "natural"), F.lit("real-cugan")).otherwise(F.lit("realesrgan-x4plus")).alias("model"),
        F.when((F.col("complexity") == "complex") | (F.col("depth") == "deep"), F.lit("quality"))
        .when(F.col("complexity") == "simple", F.lit("speed"))
        .otherwise(F.lit("balanced"))
        .alias("priority"),
    )


# Stability and pairs ------------------------------------------------------------------------------


def _stability(per: DataFrame, value: str, factor: float) -> DataFrame:
    agg = per.groupBy("asset_id").agg(F.count(value).alias("__n"), F.stddev_pop(value).alias("__s"))
    return agg.select(
        "asset_id", F.when(F.col("__n") < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("__s") * factor)).alias("score")
    )


def _head(frames: DataFrame, n: int | None) -> DataFrame:
    return frames if n is None else frames.where(F.col("frame_no") < n)


def brightness_stability(frames: DataFrame, n: int | None = None) -> DataFrame:
    head = _head(frames, n)
    per = explode_pixels(head.select(*KEY, "w", "h", "luma")).groupBy(*KEY).agg((F.avg("v") / 255.0).alias("m"))
    return _stability(per, "m", 5.0)


def edge_stability(frames: DataFrame, n: int | None = None) -> DataFrame:
    head = _head(frames, n)
    return _stability(head.select("asset_id", edge_share("luma", "w", "h").alias("e")), "e", 10.0)


def highlight_clipping(frames: DataFrame, n: int | None = None) -> DataFrame:
    """Needs packed ``b``, ``g``, ``r``; every channel value counts."""
    px = _head(frames, n).select(*KEY, "g", "r", F.posexplode("b").alias("p", "b"))
    clipped = sum(((c >= 250).cast("int") for c in (F.col("b"), F.get("g", F.col("p")), F.get("r", F.col("p")))), F.lit(0))
    per = px.groupBy(*KEY).agg((F.sum(clipped) / (F.count(F.lit(1)) * 3)).alias("c"))
    return per.groupBy("asset_id").agg(F.greatest(F.lit(0.0), 1.0 - F.avg("c") * 20).alias("score"))


def flicker(frames: DataFrame) -> DataFrame:
    """Spread of the change between consecutive frames."""
    px = explode_pixels(with_previous(frames.select(*KEY, "w", "h", "luma")))
    per = px.groupBy(*KEY).agg(F.avg(F.abs(F.col("v") - F.get("prev", F.col("p"))).cast("double")).alias("d"))
    agg = per.groupBy("asset_id").agg(F.count("d").alias("n_pairs"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s"))
    some = F.col("n_pairs") > 0
    return agg.select(
        "asset_id",
        "n_pairs",
        F.coalesce(F.col("s") > F.col("m") * 0.5, F.lit(False)).alias("flickering"),
        F.when(some, F.greatest(F.lit(0.0), 1.0 - F.col("s") / 255.0)).otherwise(0.0).alias("temporal_consistency"),
    )


def pair_frames(original: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Join two packed frame tables on their key; the enhanced pixels become ``other``."""
    return original.select(*KEY, "w", "h", "luma").join(enhanced.select(*KEY, F.col("luma").alias("other")), KEY)


def psnr(pairs: DataFrame) -> DataFrame:
    """Mean and deviation over frames; the capped variant gives 100 to identical frames and at most 100."""
    px = explode_pixels(pairs)
    d = (F.col("v") - F.get("other", F.col("p"))).cast("double")
    per = px.groupBy(*KEY).agg(F.avg(d * d).alias("mse"))
    value = F.when(F.col("mse") > 0, F.lit(10.0) * F.log10(F.lit(255.0 * 255.0) / F.col("mse")))
    per = per.withColumn("psnr", value).withColumn("capped", F.least(F.lit(100.0), F.coalesce(value, F.lit(100.0))))
    return per.groupBy("asset_id").agg(
        F.avg("psnr").alias("psnr_mean"), F.stddev_pop("psnr").alias("psnr_std"), F.avg("capped").alias("psnr_capped")
    )


def ssim(pairs: DataFrame, win: int = 7) -> DataFrame:
    similarity = K.frame_udf(lambda a, b: K.ssim(a, b, win), "double")
    per = pairs.select("asset_id", similarity("luma", "other", "w", "h").alias("s"))
    return per.groupBy("asset_id").agg(F.avg("s").alias("ssim_mean"), F.stddev_pop("s").alias("ssim_std"))


def improvement(pairs: DataFrame) -> DataFrame:
    """Relative gain in edge pixels and in contrast, averaged over frames."""
    marked = pairs.withColumn("__e0", edge_share("luma", "w", "h")).withColumn("__e1", edge_share("other", "w", "h"))
    px = explode_pixels(marked)
    per = px.groupBy(*KEY).agg(
        F.first("__e0").alias("e0"),
        F.first("__e1").alias("e1"),
        F.stddev_pop("v").alias("s0"),
        F.stddev_pop(F.get("other", F.col("p"))).alias("s1"),
    )
    detail = F.when(F.col("e0") > 0, (F.col("e1") - F.col("e0")) / F.col("e0")).otherwise(0.0)
    clarity = F.when(F.col("s0") > 0, (F.col("s1") - F.col("s0")) / F.col("s0")).otherwise(0.0)
    out = per.groupBy("asset_id").agg(F.avg(detail).alias("detail"), F.avg(clarity).alias("clarity"))
    return out.withColumn("overall", (F.col("detail") + F.col("clarity") + 1.0) / 3)


# Quality rollups ----------------------------------------------------------------------------------


def quality_metrics(wide: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Wide scores to quality_metric(asset_id, grp, name, value)."""
    cells = [
        F.struct(F.lit(g).alias("grp"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
        for g, cols in groups.items()
        for c in cols
    ]
    return wide.select("asset_id", F.explode(F.array(*cells)).alias("m")).select("asset_id", "m.*")


def overall_score(metrics: DataFrame) -> DataFrame:
    """Unweighted mean per asset and per (asset, group); the error marker does not count."""
    used = metrics.where((F.col("name") != "validation_error") & F.col("value").isNotNull())
    return used.groupingSets([["asset_id", "grp"], ["asset_id"]], "asset_id", "grp").agg(
        F.count(F.lit(1)).alias("n_metrics"), F.avg("value").alias("score")
    )


def master_metrics(scores: DataFrame) -> DataFrame:
    """Needs in/out sizes, ``n_steps`` and the three stability scores."""
    ratio = F.col("out_w") * F.col("out_h") / (F.col("width") * F.col("height"))
    target = F.when(F.col("n_steps") >= 2, 4.0).otherwise(2.0)
    return scores.withColumn("pixel_ratio", ratio).withColumn(
        "compliance", clamp(ratio / target, 0.0, 1.0)
    ).withColumn(
        "stability", (F.col("brightness_score") + F.col("edge_score") + F.col("clipping_score")) / 3
    )


# Limits of the quality advice.
PSNR_BAND = (25.0, 35.0)
SSIM_BAND = (0.8, 0.9)
SIZE_BAND = (2.0, 10.0)
LEAST_IMPROVEMENT = 0.1


def quality_advice(measures: DataFrame) -> DataFrame:
    """Advice codes from ``psnr_mean``, ``ssim_mean``, ``size_ratio``, ``overall`` and ``flickering``; a null measure gives none."""

    def band(value: str, limits: tuple[float, float], below: str, above: str) -> Column:
        return F.when(F.col(value) < limits[0], F.lit(below)).when(F.col(value) > limits[1], F.lit(above))

    found = [
        band("psnr_mean", PSNR_BAND, "psnr_low", "psnr_excellent"),
        band("ssim_mean", SSIM_BAND, "ssim_low", "ssim_excellent"),
        band("size_ratio", SIZE_BAND, "size_reasonable", "compress"),
        F.when(F.col("overall") > LEAST_IMPROVEMENT, F.lit("improved")).when(F.col("overall").isNotNull(), F.lit("improvement_limited")),
        F.when(F.col("flickering"), F.lit("flickering")),
    ]
    return measures.select("asset_id", F.array_join(F.array_compact(F.array(*found)), ",").alias("advice"))
