"""Frame filters, masks and tiles.

Filters keep frames packed and run in the task that holds the frame. What needs an earlier frame uses the
chunked window helper; what needs a statistic over frames groups by (asset, pixel), which is bounded by
the number of sampled frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.functions import kernels as K
from footlamp.operators.frames import KEY, sample_stride, with_previous
from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import sliding
from footlamp.plans.storage import cut_lineage

# Share of the earlier frame by strength.
SMOOTH_ALPHA = {"high": 0.1, "medium": 0.3, "low": 0.5}
# Diameter and sigma by denoise level.
BILATERAL_LEVELS = {1: (5, 50.0), 2: (7, 75.0), 3: (9, 100.0)}
SHARPEN_3X3 = [[-1, -1, -1], [-1, 9, -1], [-1, -1, -1]]


def apply_kernel(frames: DataFrame, fn, returns: str, name: str = "luma", *extra: str) -> DataFrame:
    """Replace or add the packed column ``name`` by ``fn`` of each frame."""
    return frames.withColumn(name, K.frame_udf(fn, returns)("luma", *extra, "w", "h"))


def pack(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Pixel rows back to one packed row per key; a key holds one frame."""
    cells = F.array_sort(F.collect_list(F.struct("p", F.col(value).alias("c"))))
    return pixels.groupBy(*keys).agg(F.transform(cells, lambda s: s["c"]).alias(value))


# Background and motion ----------------------------------------------------------------------------


def background_model(frames: DataFrame, n: int | None = None, total: DataFrame | None = None) -> DataFrame:
    """Median of all softly blurred frames per pixel, or of ``n`` samples, truncated; one packed row per asset.

    A pixel has at most 256 values, so its median comes from counts that are summed per task first.
    """
    soft = K.gaussian_kernel(3, 0.5)

    def blur(img):
        return np.floor(K.weighted_sum(img, soft) + 0.5).astype(np.int64)

    s = apply_kernel(frames if n is None else sample_stride(frames, n, total), blur, "array<int>")
    px = s.select("asset_id", "w", "h", F.posexplode("luma").alias("p", "v"))
    counts = px.groupBy("asset_id", "w", "h", "p", "v").agg(F.count(F.lit(1)).alias("n"))
    med = counts.groupBy("asset_id", "w", "h", "p").agg(F.floor(F.percentile("v", F.lit(0.5), F.col("n"))).cast("int").alias("background"))
    return pack(med, ["asset_id", "w", "h"], "background")


def motion_mask(frames: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Add the packed ``motion`` mask against the frame before."""
    df = with_previous(frames)
    return apply_kernel(df, lambda a, b: K.motion(a, b, threshold), "array<boolean>", "motion", "prev")


def motion_mask_multi(frames: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Add the packed ``motion`` mask against the last two frames."""
    df = with_previous(frames, n=2)
    return apply_kernel(df, lambda a, b, c: K.motion_recent(a, b, c, threshold), "array<boolean>", "motion", "prev", "prev2")


def background_lock(frames: DataFrame, background: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Static pixels take the background value of their asset."""
    df = motion_mask_multi(frames, threshold).drop("prev", "prev2")
    df = join_per_key(df, background.select("asset_id", "background"), ["asset_id"], "frame_no", spread=8)
    return apply_kernel(df, K.lock_static, "array<int>", "luma", "motion", "background").drop("background")


def temporal_smooth(frames: DataFrame, strength: str = "medium", threshold: float = 0.05) -> DataFrame:
    """Static pixels are mixed with the frame before."""
    alpha = SMOOTH_ALPHA.get(strength, 0.3)
    df = with_previous(frames)
    return apply_kernel(df, lambda a, b: K.smooth_static(a, b, threshold, alpha), "array<int>", "luma", "prev").drop("prev")


def temporal_fir(frames: DataFrame) -> DataFrame:
    """Three-tap mean over time on the original frames; first and last stay as they are."""
    df = sliding(
        frames, ["asset_id"], "frame_no",
        lambda w: {"prev": F.lag("luma").over(w), "next": F.lead("luma").over(w)}, before=1, after=1, size=1024,
    )
    return apply_kernel(df, K.three_tap, "array<int>", "luma", "prev", "next").drop("prev", "next")


def temporal_in_place(frames: DataFrame, chunk: int = 1024, warm: int = 6, block: int = 4096) -> DataFrame:
    """The three-tap mean where each step sees the already smoothed frame before it.

    The recursion runs along time, so time is cut into chunks. A chunk starts ``warm`` frames early, once from the
    lowest and once from the highest possible value. A step keeps the order of two values and takes a 0.15 part of
    their difference, so after four steps the two runs differ by one at most, and the true run is one of them. Which
    one, pixel by pixel, is settled by a chain over the chunks' end values, a row per chunk. Frames are cut into
    blocks of pixels, so a task holds ``chunk + warm`` block rows at a time.
    """
    last = frames.groupBy("asset_id").agg(F.max("frame_no").alias("last"))
    n_blocks = F.ceil(F.size("luma") / block).cast("int")
    df = join_per_key(frames, last, ["asset_id"], "frame_no")
    df = df.withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    df = df.withColumn("luma", F.slice("luma", F.col("block") * block + 1, F.lit(block)))
    lo = F.greatest(F.lit(0), F.floor((F.col("frame_no") - 1) / chunk))
    hi = F.floor((F.col("frame_no") + warm) / chunk)
    df = df.withColumn("chunk", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_no")
        x = np.stack(pdf["luma"].to_numpy()).astype(np.float64)
        no, end, c = pdf["frame_no"].to_numpy(), int(pdf["last"].iloc[0]), int(pdf["chunk"].iloc[0])
        low, high = np.zeros_like(x[0]), np.full_like(x[0], 255.0)
        rows, lows, highs, starts = [], [], [], []
        for i in range(len(no)):
            before = low
            if no[i] == 0 or no[i] == end:
                low = high = x[i]
            elif i + 1 < len(no):
                low = K.truncated(0.15 * low + 0.70 * x[i] + 0.15 * x[i + 1])
                high = K.truncated(0.15 * high + 0.70 * x[i] + 0.15 * x[i + 1])
            else:
                break
            if no[i] // chunk == c:
                starts.append(None if rows or no[i] == 0 else before.astype(np.int64))
                rows.append(i)
                lows.append(np.asarray(low, dtype=np.int64))
                highs.append(np.asarray(high, dtype=np.int64))
        out = pdf.iloc[rows][["asset_id", "frame_no", "w", "h", "block", "chunk"]].copy()
        for name, values in (("low", lows), ("high", highs), ("start", starts)):
            out[name] = pd.Series(values, index=out.index, dtype=object)
        return out

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        state, picks = None, []
        for start, low, high in zip(pdf["start"], pdf["low"], pdf["high"]):
            pick = np.zeros(len(low), dtype=bool) if state is None or start is None else state != np.asarray(start)
            state = np.where(pick, high, low)
            picks.append(pick)
        out = pdf[["asset_id", "block", "chunk"]].copy()
        out["pick"] = pd.Series(picks, index=out.index, dtype=object)
        return out

    schema = "asset_id INT, frame_no BIGINT, w INT, h INT, block INT, chunk BIGINT, low ARRAY<INT>, high ARRAY<INT>, start ARRAY<INT>"
    both = cut_lineage(df.groupBy("asset_id", "chunk", "block").applyInPandas(run, schema))
    ends = both.groupBy("asset_id", "block", "chunk").agg(
        *[F.max_by(c, "frame_no").alias(c) for c in ("low", "high")], F.min_by("start", "frame_no").alias("start")
    )
    picks = ends.groupBy("asset_id", "block").applyInPandas(chain, "asset_id INT, block INT, chunk BIGINT, pick ARRAY<BOOLEAN>")
    value = F.transform("low", lambda v, i: F.when(F.get("pick", i), F.get("high", i)).otherwise(v))
    parts = both.join(picks, ["asset_id", "block", "chunk"]).select(*KEY, "w", "h", "block", value.alias("luma"))
    whole = F.array_sort(F.collect_list(F.struct("block", "luma")))
    return parts.groupBy(*KEY, "w", "h").agg(F.flatten(F.transform(whole, lambda s: s["luma"])).alias("luma"))


def block_motion(frames: DataFrame, block: int, reach: int, threshold: float = 0.05, static_share: float = 0.5) -> DataFrame:
    """Median shift of the static blocks of a frame and the blend factor.

    A block is static when at most ``static_share`` of its pixels changed. The median is held within two
    deviations of the shifts; frames without a static block or without an earlier frame get nulls.
    """
    shifts = K.frame_udf(lambda a, b: K.block_shift(a, b, block, reach), "array<double>")

    def moved(img, prev):
        if prev is None:
            return np.zeros(0)
        return (np.abs(img - prev) / 255.0 > threshold).astype(float)

    df = with_previous(frames).where(F.col("prev").isNotNull())
    df = df.withColumn("__s", shifts("luma", "prev", "w", "h")).withColumn(
        "__m", K.frame_udf(moved, "array<double>")("luma", "prev", "w", "h")
    )
    nx = F.floor(F.col("w") / block).cast("int")
    px = df.select(*KEY, "w", "h", "__s", F.posexplode("__m").alias("p", "m"))
    by, bx = F.floor(F.floor(F.col("p") / F.col("w")) / block), F.floor((F.col("p") % F.col("w")) / block)
    whole = (by < F.floor(F.col("h") / block)) & (bx < nx)
    bid = F.when(whole, (by * nx + bx).cast("int"))
    per = px.groupBy(*KEY, bid.alias("b")).agg(
        F.sum("m").alias("n_moved"),
        F.count(F.lit(1)).alias("n"),
        F.first(F.get("__s", 2 * bid)).alias("dy"),
        F.first(F.get("__s", 2 * bid + 1)).alias("dx"),
    )
    static = F.col("b").isNotNull() & (F.col("n_moved") <= F.col("n") * static_share)

    def pick(c: str) -> Column:
        return F.when(static, F.col(c))

    out = per.groupBy(*KEY).agg(
        (F.sum("n_moved") / F.sum("n")).alias("motion_ratio"),
        *[F.percentile(pick(c), F.lit(0.5)).alias(f"m_{c}") for c in ("dy", "dx")],
        *[F.stddev_pop(pick(c)).alias(f"s_{c}") for c in ("dy", "dx")],
    )

    def held(c: str) -> Column:
        return F.when(
            F.col(f"m_{c}").isNotNull(), F.least(2 * F.col(f"s_{c}"), F.greatest(-2 * F.col(f"s_{c}"), F.col(f"m_{c}")))
        )

    alpha = F.least(F.lit(0.8), F.greatest(F.lit(0.3), 0.8 - 0.3 * F.col("motion_ratio")))
    return out.select(*KEY, "motion_ratio", held("dy").alias("shift_y"), held("dx").alias("shift_x"), alpha.alias("alpha"))


# Masks --------------------------------------------------------------------------------------------


def safe_mask(
    frames: DataFrame,
    strength: str,
    box: int = 15,
    highlight: float = 0.85,
    shadow: float = 0.15,
    edge: float = 0.1,
    moving: float = 0.05,
) -> DataFrame:
    """Add the packed ``mask`` of pixels that may be enhanced."""
    dense = K.frame_udf(lambda a: K.box_mean(K.edges(a), box), "array<double>")
    df = with_previous(frames).withColumn("__d", dense("luma", "w", "h"))

    def rule(v: Column, i: Column) -> Column:
        share = v / 255.0
        bright, dark = share > highlight, share < shadow
        changed = F.coalesce(F.abs(v - F.get("prev", i)) / 255.0 > moving, F.lit(True))
        base = (F.get("__d", i) > edge) & ~bright & ~dark
        if strength == "weak":
            return base & changed
        if strength == "strong":
            return base | (~bright & ~dark)
        return base | (changed & ~bright)

    return df.withColumn("mask", F.transform("luma", rule)).drop("prev", "__d")


def smooth_mask(masks: DataFrame, size: int = 5) -> DataFrame:
    k = K.ellipse(size)
    fn = K.frame_udf(lambda m: K.opened(K.closed(m.astype(bool), k), k), "array<boolean>")
    return masks.withColumn("mask", fn("mask", "w", "h"))


def mask_regions(masks: DataFrame, min_side: int = 32, max_side: int = 1024, min_fill: float = 0.1) -> DataFrame:
    """Connected regions whose box reaches ``min_side`` both ways; ``selected`` also bounds size and fill."""
    label = K.frame_udf(lambda m: K.label_regions(m.astype(bool)), "array<int>")
    px = masks.select(*KEY, "w", F.posexplode(label("mask", "w", "h")).alias("p", "region")).where("region >= 0")
    y, x = F.floor(F.col("p") / F.col("w")).cast("int"), (F.col("p") % F.col("w")).cast("int")
    box = px.groupBy(*KEY, "region").agg(
        F.min(x).alias("x"),
        F.min(y).alias("y"),
        (F.max(x) - F.min(x) + 1).alias("box_w"),
        (F.max(y) - F.min(y) + 1).alias("box_h"),
        F.count(F.lit(1)).alias("area"),
    )
    kept = box.where((F.col("box_w") >= min_side) & (F.col("box_h") >= min_side))
    fill = F.col("area") / (F.col("box_w") * F.col("box_h"))
    ok = (F.col("box_w") <= max_side) & (F.col("box_h") <= max_side) & (fill >= min_fill)
    return kept.withColumn("fill", fill).withColumn("selected", ok)


def mask_quality(masks: DataFrame) -> DataFrame:
    """Safe share and region statistics per frame; area counts pixels."""
    share = F.size(F.filter("mask", lambda m: m)) / F.size("mask")
    base = masks.select(*KEY, share.alias("safe_ratio"))
    regions = mask_regions(masks, min_side=1).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_regions"),
        F.avg("area").alias("avg_region"),
        F.max("area").alias("max_region"),
        F.min("area").alias("min_region"),
    )
    r = F.col("safe_ratio")
    return (
        base.join(regions, KEY, "left")
        .na.fill(0, ["n_regions", "avg_region", "max_region", "min_region"])
        .withColumn(
            "quality",
            F.when(r < 0.05, F.lit("very_conservative"))
            .when(r < 0.15, F.lit("conservative"))
            .when(r < 0.35, F.lit("balanced"))
            .when(r < 0.60, F.lit("aggressive"))
            .otherwise(F.lit("very_aggressive")),
        )
    )


# Pixel filters ------------------------------------------------------------------------------------


def bilateral(frames: DataFrame, level: int = 1) -> DataFrame:
    d, sigma = BILATERAL_LEVELS[min(level, 3)]
    return apply_kernel(frames, lambda a: K.bilateral(a, d, sigma), "array<double>")


def tone_correct(frames: DataFrame, clip: float = 1.5, tiles: int = 6, gamma: float = 1.1) -> DataFrame:
    return apply_kernel(frames, lambda a: K.tone_curve(a, clip, tiles, gamma), "array<int>")


def convolve(frames: DataFrame, kernel: list[list[float]], hold: bool = True) -> DataFrame:
    """Weighted sum with any small odd kernel, held in 0..255 unless ``hold`` is off."""

    def fn(img):
        out = K.weighted_sum(img, np.asarray(kernel, dtype=float))
        return np.clip(out, 0, 255) if hold else out

    return apply_kernel(frames, fn, "array<double>")


def unsharp(frames: DataFrame, sigma: float = 1.0) -> DataFrame:
    return apply_kernel(frames, lambda a: K.sharpen_soft(a, sigma), "array<double>")


def resample(frames: DataFrame, scale: int, method: str) -> DataFrame:
    """Enlarge by ``cubic`` or ``lanczos4`` weights, held in 0..255; w and h follow."""
    df = apply_kernel(frames, lambda a: np.clip(K.resample(a, scale, method), 0, 255), "array<double>")
    return df.withColumn("w", F.col("w") * scale).withColumn("h", F.col("h") * scale)


def blend_masked(base: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Enhanced pixels where ``base.mask`` holds, else base pixels; frames without a partner stay."""
    other = enhanced.select(*KEY, F.col("luma").alias("__e"))
    df = base.join(other, KEY, "left")
    mixed = F.transform(
        "luma", lambda v, i: F.when(F.get("mask", i) & F.get("__e", i).isNotNull(), F.get("__e", i)).otherwise(v)
    )
    return df.withColumn("luma", mixed).drop("__e")


# Tiles --------------------------------------------------------------------------------------------


def _count(side: Column, tile: int, overlap: int) -> Column:
    return F.when(side <= tile, 1).otherwise(1 + F.ceil((side - tile) / (tile - overlap))).cast("int")


def make_tiles(sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Tiles of every row's w x h in row-major order; inner sides widened by half the overlap."""
    nx, ny = _count(F.col("w"), tile, overlap), _count(F.col("h"), tile, overlap)
    df = sizes.withColumn("__nx", nx).withColumn("__ny", ny)
    df = df.withColumn("tile_id", F.explode(F.sequence(F.lit(0), F.col("__nx") * F.col("__ny") - 1)))
    half, step = overlap // 2, tile - overlap

    def axis(i: Column, n: Column, side: Column) -> tuple[Column, Column, Column, Column]:
        before, after = F.when(i > 0, half).otherwise(0), F.when(i < n - 1, half).otherwise(0)
        start = F.greatest(F.lit(0), i * step - before)
        length = F.least(F.least(F.lit(tile), side - i * step) + before + after, side - start)
        return start, length, before, after

    col = (F.col("tile_id") % F.col("__nx")).cast("int")
    row = F.floor(F.col("tile_id") / F.col("__nx")).cast("int")
    x, tw, left, right = axis(col, F.col("__nx"), F.col("w"))
    y, th, top, bottom = axis(row, F.col("__ny"), F.col("h"))
    named = {"tx": x, "ty": y, "tw": tw, "th": th, "left": left, "right": right, "top": top, "bottom": bottom}
    return df.select("*", *[c.cast("int").alias(n) for n, c in named.items()]).drop("__nx", "__ny")


def make_tiles_pinned(sizes: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Variant whose last tile sits at the border and whose sides carry the full overlap."""
    step = tile - overlap

    def starts(side: Column) -> Column:
        grid = F.sequence(F.lit(0), F.greatest(F.lit(0), side - tile), F.lit(step))
        short = F.element_at(grid, -1) + tile < side
        return F.when(short, F.concat(grid, F.array(side - tile))).otherwise(grid)

    df = sizes.select("*", starts(F.col("w")).alias("__xs"), F.posexplode(starts(F.col("h"))).alias("__row", "ty"))
    df = df.select("*", F.posexplode("__xs").alias("__col", "tx"))
    w, h = F.least(F.lit(tile), F.col("w")), F.least(F.lit(tile), F.col("h"))

    def flag(c: Column) -> Column:
        return F.when(c, overlap).otherwise(0)

    return df.select(
        *sizes.columns,
        (F.col("__row") * F.size("__xs") + F.col("__col")).alias("tile_id"),
        "tx", "ty", w.cast("int").alias("tw"), h.cast("int").alias("th"),
        flag(F.col("tx") > 0).alias("left"), flag(F.col("tx") + tile < F.col("w")).alias("right"),
        flag(F.col("ty") > 0).alias("top"), flag(F.col("ty") + tile < F.col("h")).alias("bottom"),
    )


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """One row per tile pixel with its position inside the tile (iy, ix) and in the frame (y, x)."""
    n = F.col("tw") * F.col("th")
    df = tiles.withColumn("__q", F.explode(F.sequence(F.lit(0), n - 1)))
    iy, ix = F.floor(F.col("__q") / F.col("tw")).cast("int"), (F.col("__q") % F.col("tw")).cast("int")
    return (
        df.withColumn("iy", iy)
        .withColumn("ix", ix)
        .withColumn("y", F.col("ty") + F.col("iy"))
        .withColumn("x", F.col("tx") + F.col("ix"))
        .drop("__q")
    )


def tile_weight() -> Column:
    """Linear ramp over the overlapped sides; corners multiply."""

    def ramp(pos: Column, size: str) -> Column:
        o = F.col(size)
        return F.when((o > 0) & (pos < o), pos / o).otherwise(1.0)

    return (
        ramp(F.col("ix"), "left")
        * ramp(F.col("tw") - 1 - F.col("ix"), "right")
        * ramp(F.col("iy"), "top")
        * ramp(F.col("th") - 1 - F.col("iy"), "bottom")
    )


def tile_weight_gaussian(fade: int) -> Column:
    """Variant with a bell-shaped fade on all four sides."""
    f = F.least(F.lit(fade), F.floor(F.least("tw", "th") / 4))

    def side(pos: Column) -> Column:
        d = F.try_divide(f - pos, f / 3.0)
        return F.when((f > 0) & (pos < f), F.exp(-d * d)).otherwise(1.0)

    return side(F.col("ix")) * side(F.col("tw") - 1 - F.col("ix")) * side(F.col("iy")) * side(F.col("th") - 1 - F.col("iy"))


def assemble_tiles(pixels: DataFrame, value: str = "v", weight: str = "weight") -> DataFrame:
    """Weighted mean of overlapping tiles; a pixel with no weight at all takes the plain mean.

    Tiles of a frame leave the same task, so partial sums merge most overlaps before the shuffle.
    """
    per = pixels.groupBy(*KEY, "y", "x").agg(
        F.sum(F.col(weight) * F.col(value)).alias("__s"), F.sum(weight).alias("__w"), F.avg(value).alias("__m")
    )
    return per.select(*KEY, "y", "x", F.when(F.col("__w") > 0, F.col("__s") / F.col("__w")).otherwise(F.col("__m")).alias("v"))


def tile_batches(tiles: DataFrame, batch: int) -> DataFrame:
    """Per-batch counts in tile order; needs ``success``."""
    return tiles.groupBy(*KEY, F.floor(F.col("tile_id") / batch).cast("int").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.count_if("success").alias("n_ok"), F.count_if(~F.col("success")).alias("n_failed")
    )
