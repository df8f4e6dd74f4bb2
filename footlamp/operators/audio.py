"""Audio in the time domain, on audio_sample(asset_id, ch, n, amp).

A channel of a long recording is one key with hundreds of millions of rows, so neighbours come from the
chunked window helper, percentiles from the exact histogram helper, and everything else is a partial
aggregate per channel that is joined back as one row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.functions.scalars import EPS, clamp, db, ratio
from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import CHUNK, exact_percentiles, sliding

KEY = ["asset_id", "ch"]

# Fixed values.
VENUE_WIDTH = {"small": 0.8, "medium": 1.0, "large": 1.3}
VENUE_COMPRESSION = {  # threshold, ratio, attack and release in seconds
    "small": (0.8, 2.0, 0.003, 0.1),
    "medium": (0.7, 3.0, 0.005, 0.15),
    "large": (0.6, 4.0, 0.01, 0.2),
}
VENUE_CROSSTALK = {"small": (0.0002, 0.05), "medium": (0.0005, 0.03), "large": (0.001, 0.02)}  # seconds, level
ECHO_TAPS = [(0.02, 0.3), (0.05, 0.2), (0.08, 0.15), (0.12, 0.1)]  # seconds, gain
STAGE_TAPS = [(0.02, 0.3), (0.04, 0.25), (0.08, 0.2), (0.15, 0.15), (0.25, 0.1)]


def _levels(samples: DataFrame, keys: list[str] = KEY, value: str = "amp") -> DataFrame:
    y = F.col(value)
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sqrt(F.avg(y * y)).alias("rms"), F.max(F.abs(y)).alias("peak")
    )


# Measures -----------------------------------------------------------------------------------------

PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def signal_stats(samples: DataFrame) -> DataFrame:
    """Level, crest, zero crossings, noise floor, SNR and amplitude percentiles per channel."""
    mag = samples.withColumn("mag", F.abs("amp"))
    pct = exact_percentiles(mag, KEY, "mag", {"p20": 0.20, **PERCENTILES})
    crossed = sliding(samples, KEY, "n", lambda w: {"__prev": F.lag("amp").over(w)}, before=1)
    flip = F.coalesce((F.col("amp") < 0) != (F.col("__prev") < 0), F.lit(False))
    y = F.col("amp")
    levels = crossed.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_samples"), F.sqrt(F.avg(y * y)).alias("rms"), F.max(F.abs(y)).alias("peak"),
        F.avg(flip.cast("int")).alias("zcr"),
    )
    quiet = (
        join_per_key(mag, pct.select(*KEY, "p20"), KEY, "n")
        .groupBy(*KEY)
        .agg(F.avg(F.when(F.col("mag") < F.col("p20"), F.col("mag"))).alias("__q"))
    )
    df = levels.join(quiet, KEY).join(pct, KEY)
    floor = F.coalesce("__q", "p20")
    return df.select(
        *KEY,
        "n_samples",
        "rms",
        "peak",
        db(F.col("peak") / (F.col("rms") + EPS)).alias("crest_db"),
        "zcr",
        floor.alias("noise_floor"),
        (F.lit(10.0) * F.log10(F.col("rms") * F.col("rms") / (floor * floor + EPS))).alias("snr_db"),
        *PERCENTILES,
    )


def frame_rms(samples: DataFrame, size: int = 2048, hop: int = 512) -> DataFrame:
    """RMS of the complete frames of a channel; ``size`` is a multiple of ``hop``.

    Samples are first summed per hop block, so the shuffle carries one row per block and not one row
    per sample and frame.
    """
    k = size // hop
    blocks = samples.groupBy(*KEY, F.floor(F.col("n") / hop).cast("bigint").alias("hop")).agg(
        F.sum(F.col("amp") * F.col("amp")).alias("__s"), F.count(F.lit(1)).alias("__n"), F.max("n").alias("__last")
    )

    def make(w):
        span = w.rowsBetween(0, k - 1)
        return {"__ss": F.sum("__s").over(span), "__nn": F.sum("__n").over(span)}

    out = sliding(blocks, KEY, "hop", make, after=k - 1)
    return out.where(F.col("__nn") == size).select(*KEY, "hop", F.sqrt(F.col("__ss") / size).alias("rms"))


def reverb_time(frames: DataFrame, hop: int = 512, rate: int = 22050, drop: float = 1000.0) -> DataFrame:
    """Seconds from the loudest frame to the first later one below max / ``drop``, and the venue."""
    peak = frames.groupBy("asset_id", "ch").agg(
        F.max_by("hop", F.struct("rms", -F.col("hop"))).alias("peak_hop"), F.max("rms").alias("top")
    )
    later = join_per_key(frames, peak, KEY, "hop").where((F.col("hop") >= F.col("peak_hop")) & (F.col("rms") < F.col("top") / drop))
    found = later.groupBy(*KEY).agg(F.min(F.col("hop") - F.col("peak_hop")).alias("__d"))
    rt = F.coalesce(F.least(F.col("__d") * hop / float(rate), F.lit(5.0)), F.lit(1.5))
    return (
        peak.join(found, KEY, "left")
        .select(*KEY, rt.alias("reverb_s"))
        .withColumn(
            "venue",
            F.when(F.col("reverb_s") < 1.0, F.lit("small")).when(F.col("reverb_s") < 2.5, F.lit("medium")).otherwise(F.lit("large")),
        )
    )


def noise_floor(frames: DataFrame) -> DataFrame:
    """Mean of the quietest tenth of the frames in dB, not below -80."""
    p = exact_percentiles(frames, KEY, "rms", {"p10": 0.10})
    quiet = join_per_key(frames, p, KEY, "hop").where(F.col("rms") <= F.col("p10"))
    level = quiet.groupBy(*KEY).agg(F.avg("rms").alias("__m"))
    return level.select(*KEY, F.coalesce(F.greatest(db(F.col("__m") + EPS), F.lit(-80.0)), F.lit(-60.0)).alias("noise_floor_db"))


def dynamic_range(frames: DataFrame) -> DataFrame:
    p = exact_percentiles(frames, KEY, "rms", {"hi": 0.95, "lo": 0.05})
    return p.select(*KEY, F.least(db((F.col("hi") + EPS) / (F.col("lo") + EPS)), F.lit(60.0)).alias("dynamic_range_db"))


def stereo(samples: DataFrame) -> DataFrame:
    """One row per sample with both channels, trimmed to the shorter channel."""
    side = samples.groupBy("asset_id", "n").agg(
        F.max(F.when(F.col("ch") == 0, F.col("amp"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("amp"))).alias("r")
    )
    return side.where(F.col("l").isNotNull() & F.col("r").isNotNull())


def stereo_features(samples: DataFrame) -> DataFrame:
    """Width and centre focus; an asset without a second channel is mono: 0 and 1."""
    s = stereo(samples)
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    both = s.groupBy("asset_id").agg(
        F.corr("l", "r").alias("correlation"),
        F.avg(mid * mid).alias("__m"),
        F.avg(side * side).alias("__s"),
        F.avg(F.col("l") * F.col("l")).alias("__l"),
        F.avg(F.col("r") * F.col("r")).alias("__r"),
    )
    every = samples.groupBy("asset_id").agg(F.count_distinct("ch").alias("channels"))
    df = every.join(both, "asset_id", "left")
    return df.select(
        "asset_id",
        "channels",
        F.coalesce(1.0 - F.abs(F.col("correlation")), F.lit(0.0)).alias("width"),
        F.coalesce(F.col("__m") / (F.col("__m") + F.col("__s") + EPS), F.lit(1.0)).alias("centre_focus"),
        ((F.col("__r") - F.col("__l")) / (F.col("__r") + F.col("__l") + EPS)).alias("balance"),
    )


def peak_levels(samples: DataFrame, rate: int) -> DataFrame:
    """Peak of every whole second; the unfinished last second is dropped."""
    per = samples.groupBy(*KEY, F.floor(F.col("n") / rate).cast("bigint").alias("second")).agg(
        F.max(F.abs("amp")).alias("peak"), F.count(F.lit(1)).alias("__n")
    )
    return per.where(F.col("__n") == rate).drop("__n")


def pair_samples(original: DataFrame, processed: DataFrame) -> DataFrame:
    """Both signals on one row, trimmed to the shorter; ``amp`` and ``out``."""
    return original.join(processed.select(*KEY, "n", F.col("amp").alias("out")), [*KEY, "n"])


def snr_gain(pairs: DataFrame) -> DataFrame:
    """Change of rms over the 10th amplitude percentile in dB."""
    # both signals share one percentile pass, told apart by ``side``
    two = F.array(
        F.struct(F.lit("a").alias("side"), F.abs("amp").alias("mag")), F.struct(F.lit("b").alias("side"), F.abs("out").alias("mag"))
    )
    sides = pairs.select(*KEY, F.explode(two).alias("s")).select(*KEY, "s.*")
    p = exact_percentiles(sides, [*KEY, "side"], "mag", {"p10": 0.10})
    noise = p.groupBy(*KEY).agg(
        F.max(F.when(F.col("side") == "a", F.col("p10"))).alias("na"), F.max(F.when(F.col("side") == "b", F.col("p10"))).alias("nb")
    )
    lv = pairs.groupBy(*KEY).agg(
        F.sqrt(F.avg(F.col("amp") * F.col("amp"))).alias("ra"), F.sqrt(F.avg(F.col("out") * F.col("out"))).alias("rb")
    )
    j = lv.join(noise, KEY)
    before, after = db(F.col("ra") / (F.col("na") + EPS)), db(F.col("rb") / (F.col("nb") + EPS))

    def quiet60(rms: str, noise: str) -> Column:
        return F.when(F.col(noise) > 0, db(F.col(rms) / F.col(noise))).otherwise(60.0)

    return j.select(
        *KEY,
        before.alias("snr_before_db"),
        after.alias("snr_after_db"),
        (after - before).alias("gain_db"),
        (quiet60("rb", "nb") - quiet60("ra", "na")).alias("gain_quiet60_db"),
    )


def clip_share(samples: DataFrame, limit: float = 0.95) -> DataFrame:
    return samples.groupBy(*KEY).agg(
        F.avg((F.abs("amp") > limit).cast("int")).alias("clip_share"), F.max(F.abs("amp")).alias("peak")
    )


def distortion_flags(samples: DataFrame, thd: DataFrame) -> DataFrame:
    """``thd`` is (asset_id, thd); more than 0.1% clipped or more than 5% high-band energy."""
    df = clip_share(samples).join(thd, "asset_id")
    return df.withColumn("distorted", (F.col("clip_share") > 0.001) | (F.col("thd") > 0.05))


def distortion_pair(pairs: DataFrame, thd: DataFrame) -> DataFrame:
    """Stricter form on a processed signal; ``thd`` is (asset_id, thd_before, thd_after)."""
    out = pairs.select(*KEY, F.col("out").alias("amp"))
    df = clip_share(out, 0.99).join(thd, "asset_id")
    rise = F.col("thd_after") - F.col("thd_before")
    return df.select(
        *KEY,
        "clip_share",
        "peak",
        rise.alias("thd_rise"),
        ((F.col("clip_share") > 0.001) | (rise > 0.02) | (F.col("peak") > 0.99)).alias("distorted"),
    )


def loudness_range(samples: DataFrame, size: int = 4800, hop: int = 2400) -> DataFrame:
    """Spread of frame loudness (95th minus 10th percentile) and peak to average.

    A frame that ends exactly at the last sample is not counted; silent frames are dropped.
    """
    lv = _levels(samples)
    f = join_per_key(frame_rms(samples, size, hop), lv.select(*KEY, "n_samples"), KEY, "hop")
    f = f.where((F.col("hop") * hop < F.col("n_samples") - size) & (F.col("rms") > 0))
    p = exact_percentiles(f.withColumn("level", db(F.col("rms"))), KEY, "level", {"hi": 0.95, "lo": 0.10})
    df = lv.join(p, KEY, "left")
    return df.select(
        *KEY,
        F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)).alias("loudness_range_db"),
        F.when(F.col("rms") > 0, db(F.col("peak") / F.col("rms"))).otherwise(0.0).alias("peak_to_average_db"),
    )


def volume_consistency(samples: DataFrame) -> DataFrame:
    lv = _levels(samples)
    r = db(ratio(F.col("peak"), F.col("rms")))
    score = (
        F.when((F.col("rms") <= 0) | F.col("rms").isNull(), 0.5)
        .when((r >= 6) & (r <= 20), 1.0)
        .when(r < 6, F.greatest(F.lit(0.0), r / 6))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (r - 20) / 20))
    )
    return lv.select(*KEY, r.alias("range_db"), score.alias("score"))


# Lag products -------------------------------------------------------------------------------------


def lag_sums(pairs: DataFrame, keys: list[str], a: str, b: str, max_lag: int, min_lag: int = 0, size: int = CHUNK) -> DataFrame:
    """Sums of products of a[n] and b[n + lag] for every lag, as one row per key and lag.

    A key is cut into chunks that also see the neighbours they need; a chunk is one numpy task, and only a few sums
    per chunk are shuffled.
    """
    reach = max(abs(min_lag), abs(max_lag))
    first = F.greatest(F.lit(0), F.floor((F.col("n") - reach) / size)).cast("bigint")
    last = F.floor((F.col("n") + reach) / size).cast("bigint")
    df = pairs.select(*keys, "n", F.col(a).alias("a"), F.col(b).alias("b"))
    df = df.withColumn("chunk", F.explode(F.sequence(first, last)))
    stats = ["lag", "m", "sa", "sb", "saa", "sbb", "sab"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        n, x, y = pdf["n"].to_numpy(), pdf["a"].to_numpy(), pdf["b"].to_numpy()
        home = n // size == pdf["chunk"].iloc[0]
        rows = []
        for lag in range(min_lag, max_lag + 1):
            at = np.searchsorted(n, n[home] + lag)
            ok = at < len(n)
            ok[ok] = n[at[ok]] == (n[home] + lag)[ok]
            u, v = x[home][ok], y[at[ok]]
            rows.append((lag, len(u), u.sum(), v.sum(), (u * u).sum(), (v * v).sum(), (u * v).sum()))
        out = pd.DataFrame(rows, columns=stats)
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", lag INT, m BIGINT, sa DOUBLE, sb DOUBLE, saa DOUBLE, sbb DOUBLE, sab DOUBLE"
    part = df.groupBy(*keys, "chunk").applyInPandas(run, schema)
    return part.groupBy(*keys, "lag").agg(*[F.sum(c).alias(c) for c in stats[1:]])


def sync_offset(stereo_pairs: DataFrame, max_lag: int, rate: int) -> DataFrame:
    """Lag of ``r`` against ``l`` with the highest correlation; ties go to the smaller shift."""
    s = lag_sums(stereo_pairs, ["asset_id"], "l", "r", max_lag, -max_lag)
    m = F.col("m")

    def moment(both: str, u: str, v: str) -> Column:
        return F.col(both) - ratio(F.col(u) * F.col(v), m)

    spread = F.sqrt(moment("saa", "sa", "sa") * moment("sbb", "sb", "sb"))
    c = s.withColumn("corr", F.when((m > 2) & (spread > 0), F.round(ratio(moment("sab", "sa", "sb"), spread), 9)))
    best = c.where(F.col("corr").isNotNull()).groupBy("asset_id").agg(
        F.max_by(F.struct("lag", "corr"), F.struct(F.col("corr"), -F.abs("lag"), F.col("lag"))).alias("b")
    )
    return best.select(
        "asset_id", F.col("b.lag").alias("lag"), F.col("b.corr").alias("correlation"), (F.col("b.lag") * 1000.0 / rate).alias("offset_ms")
    )


def autocorr_decay(samples: DataFrame, max_lag: int, rate: int) -> DataFrame:
    """First lag where the left channel's autocorrelation falls below a tenth of its maximum, and width."""
    left = samples.where(F.col("ch") == 0).withColumn("again", F.col("amp"))
    s = lag_sums(left, ["asset_id"], "amp", "again", max_lag)
    top = s.groupBy("asset_id").agg(F.max("sab").alias("top"))
    low = s.join(top, "asset_id").where(F.col("sab") < 0.1 * F.col("top")).groupBy("asset_id").agg(F.min("lag").alias("lag"))
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2
    w = stereo(samples).groupBy("asset_id").agg(
        F.sqrt(F.avg(mid * mid)).alias("__m"), F.sqrt(F.avg(side * side)).alias("__s"),
        F.sqrt(F.avg(F.col("l") * F.col("l"))).alias("__l"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("__r"),
    )
    width = F.col("__s") / (F.col("__m") + EPS)
    return (
        top.join(low, "asset_id", "left")
        .join(w, "asset_id", "left")
        .select(
            "asset_id",
            F.coalesce(F.col("lag") / F.lit(float(rate)), F.lit(0.5)).alias("decay_s"),
            width.alias("width"),
            F.when(width > 0.3, F.lit("good")).otherwise(F.lit("needs_enhancement")).alias("quality"),
            db((F.col("__l") + EPS) / (F.col("__r") + EPS)).alias("balance_db"),
        )
    )


# Level and dynamics -------------------------------------------------------------------------------


def _limit(value: Column, threshold: float = 0.95) -> Column:
    return F.tanh(value / threshold) * threshold


def loudness_normalise(samples: DataFrame, target: float = -23.0) -> DataFrame:
    """Gain to a target loudness; gains above 1 pass a soft limiter; peaks above 0.99 are scaled to 0.95.

    The limiter grows with its input, so the peak after it follows from the peak before: one pass.
    """
    goal = (10 ** ((target + 0.691) / 10)) ** 0.5
    gain = F.when(F.col("rms") > 0, F.lit(goal) / F.col("rms")).otherwise(1.0)

    def shape(value: Column) -> Column:
        return F.when(F.col("gain") > 1.0, _limit(value * F.col("gain"))).otherwise(value * F.col("gain"))

    lv = _levels(samples).withColumn("gain", gain)
    lv = lv.withColumn("__top", F.when(F.col("rms") > 0, shape(F.col("peak"))).otherwise(F.col("peak")))
    scale = F.when((F.col("rms") > 0) & (F.col("__top") > 0.99), F.lit(0.95) / F.col("__top")).otherwise(1.0)
    lv = lv.select(*KEY, "rms", "gain", scale.alias("__scale"))
    df = join_per_key(samples, lv, KEY, "n")
    out = F.when(F.col("rms") > 0, shape(F.col("amp")) * F.col("__scale")).otherwise(F.col("amp"))
    return df.select(*KEY, "n", out.alias("amp"))


def _squeeze(mag: Column, threshold: float, ratio: float) -> Column:
    return F.when(mag > threshold, threshold + (mag - threshold) / ratio).otherwise(mag)


def compress_static(samples: DataFrame, threshold: float = 0.7, ratio: float = 3.0) -> DataFrame:
    y = F.col("amp")
    return samples.withColumn("amp", F.when(F.abs(y) > threshold, F.signum(y) * _squeeze(F.abs(y), threshold, ratio)).otherwise(y))


def soft_limit(samples: DataFrame, threshold: float = 0.95) -> DataFrame:
    return samples.withColumn("amp", _limit(F.col("amp"), threshold))


def compress_smoothed(samples: DataFrame, threshold: float = 0.7, ratio: float = 2.0, window: int = 1024) -> DataFrame:
    """Gain from a centred moving average of the level; outside the clip counts as silence."""
    before, after = window // 2, (window - 1) // 2

    def make(w):
        return {"__e": F.sum(F.abs("amp")).over(w.rowsBetween(-before, after)) / window}

    df = sliding(samples, KEY, "n", make, before=before, after=after)
    e = F.col("__e")
    gain = F.when(e > threshold, _squeeze(e, threshold, ratio) / e).otherwise(1.0)
    return df.select(*KEY, "n", (F.col("amp") * gain).alias("amp"))


def envelope(samples: DataFrame, attack_s: float, release_s: float, rate: int, size: int = CHUNK) -> DataFrame:
    """Add the attack / release envelope ``env`` of |amp|.

    The recursion runs along one channel. Each step shrinks the distance of any two starting values at
    least by the release factor, so a chunk that starts ``warm`` samples early has forgotten its start to
    below 1e-12. Chunks are packed arrays and the recursion runs over all chunks of a batch at once.
    """
    up, down = float(np.exp(-1.0 / (attack_s * rate))), float(np.exp(-1.0 / (release_s * rate)))
    warm = int(np.ceil(np.log(1e-12) / np.log(max(up, down))))
    size = max(size, 2 * warm)
    first = F.floor(F.col("n") / size).cast("bigint")
    last = F.floor((F.col("n") + warm) / size).cast("bigint")
    df = samples.withColumn("chunk", F.explode(F.sequence(first, last)))
    packed = df.groupBy(*KEY, "chunk").agg(F.array_sort(F.collect_list(F.struct("n", "amp"))).alias("s"))
    packed = packed.select(*KEY, "chunk", F.transform("s", lambda p: p["n"]).alias("ns"), F.transform("s", lambda p: p["amp"]).alias("amps"))

    @F.pandas_udf("array<double>")
    def follow(amps: pd.Series) -> pd.Series:
        lengths = amps.map(len).to_numpy()
        level = np.zeros((len(amps), lengths.max() if len(amps) else 0))
        for i, a in enumerate(amps):
            level[i, : len(a)] = np.abs(a)
        for j in range(1, level.shape[1]):
            was, now = level[:, j - 1], level[:, j]
            k = np.where(now > was, up, down)
            level[:, j] = k * was + (1 - k) * now
        return pd.Series([level[i, :m] for i, m in enumerate(lengths)], dtype=object)

    cells = F.arrays_zip(F.col("ns"), F.col("amps"), F.col("env"))
    rows = packed.withColumn("env", follow("amps")).select(*KEY, "chunk", F.explode(cells).alias("c"))
    home = F.floor(F.col("c.ns") / size).cast("bigint") == F.col("chunk")
    return rows.where(home).select(*KEY, F.col("c.ns").alias("n"), F.col("c.amps").alias("amp"), F.col("c.env").alias("env"))


def compress_envelope(samples: DataFrame, venue: str = "medium", rate: int = 22050, size: int = CHUNK) -> DataFrame:
    """Compression by the envelope; the crest factor is then restored within 0.8..1.2."""
    threshold, ratio, attack, release = VENUE_COMPRESSION.get(venue, VENUE_COMPRESSION["medium"])
    e = F.col("env")
    df = envelope(samples, attack, release, rate, size).withColumn("out", F.col("amp") * (_squeeze(e, threshold, ratio) / (e + EPS)))
    lv = df.groupBy(*KEY).agg(
        (F.max(F.abs("amp")) / (F.sqrt(F.avg(F.col("amp") * F.col("amp"))) + EPS)).alias("__c0"),
        (F.max(F.abs("out")) / (F.sqrt(F.avg(F.col("out") * F.col("out"))) + EPS)).alias("__c1"),
        F.max("n").alias("__last"),
    )
    fix = F.when(F.col("__c1") > 0, clamp(F.col("__c0") / F.col("__c1"), 0.8, 1.2)).otherwise(1.0)
    return join_per_key(df, lv, KEY, "n", last=F.col("__last")).select(*KEY, "n", (F.col("out") * fix).alias("amp"))


def smooth_and_normalise(samples: DataFrame, target: float = 0.95) -> DataFrame:
    """Nine parts signal, one part three-sample mean with repeated ends; loud results are scaled."""

    def make(w):
        y = F.col("amp")
        return {"__m": (F.coalesce(F.lag("amp").over(w), y) + y + F.coalesce(F.lead("amp").over(w), y)) / 3}

    df = sliding(samples, KEY, "n", make, before=1, after=1).withColumn("amp", 0.9 * F.col("amp") + 0.1 * F.col("__m")).drop("__m")
    return scale_peak(df, KEY, ["amp"], target)


def scale_peak(df: DataFrame, keys: list[str], cols: list[str], target: float = 0.95) -> DataFrame:
    """Scale all ``cols`` of a key so that its peak is at most ``target``."""
    top = F.greatest(*[F.abs(c) for c in cols]) if len(cols) > 1 else F.abs(cols[0])
    lv = df.groupBy(*keys).agg(F.max(top).alias("__p"), F.max("n").alias("__last"))
    k = F.when(F.col("__p") > target, F.lit(target) / F.col("__p")).otherwise(1.0)
    out = join_per_key(df, lv, keys, "n", last=F.col("__last"))
    for c in cols:
        out = out.withColumn(c, F.col(c) * k)
    return out.drop("__p", "__last")


# Space --------------------------------------------------------------------------------------------


def mid_side_width(pairs: DataFrame, venue: str = "medium") -> DataFrame:
    mid, side = (F.col("l") + F.col("r")) / 2, (F.col("l") - F.col("r")) / 2 * VENUE_WIDTH.get(venue, 1.0)
    return scale_peak(pairs.select("asset_id", "n", (mid + side).alias("l"), (mid - side).alias("r")), ["asset_id"], ["l", "r"])


def echo_taps(samples: DataFrame, rate: int, depth: float = 1.0, mix: float = 0.15, taps: list | None = None) -> DataFrame:
    """Add delayed copies; a tap longer than the clip adds nothing."""
    delays = [(int(s * rate), g) for s, g in (taps or ECHO_TAPS)]
    reach = max(d for d, _ in delays)

    def make(w):
        echo = sum((F.coalesce(F.lag("amp", d).over(w), F.lit(0.0)) * (g * depth) for d, g in delays), F.lit(0.0))
        return {"__e": echo}

    df = sliding(samples, KEY, "n", make, before=max(reach, 1))
    return df.select(*KEY, "n", (F.col("amp") + mix * F.col("__e")).alias("amp"))


def spatial_adjust(pairs: DataFrame, rate: int, venue: str = "medium", focus: float = 0.7) -> DataFrame:
    """Delayed crosstalk, centre focus, and an inverted right channel when the sides oppose each other."""
    delay_s, level = VENUE_CROSSTALK.get(venue, VENUE_CROSSTALK["medium"])
    d = int(delay_s * rate)
    df = pairs
    if d > 0:
        df = sliding(df, ["asset_id"], "n", lambda w: {"__l": F.lag("l", d).over(w), "__r": F.lag("r", d).over(w)}, before=d)
        df = df.select(
            "asset_id",
            "n",
            (F.col("l") + level * F.coalesce("__r", F.lit(0.0))).alias("l"),
            (F.col("r") + level * F.coalesce("__l", F.lit(0.0))).alias("r"),
        )
    centre = (F.col("l") + F.col("r")) / 2
    df = df.select(
        "asset_id", "n", (centre * focus + F.col("l") - centre).alias("l"), (centre * focus + F.col("r") - centre).alias("r")
    )
    c = df.groupBy("asset_id").agg(F.corr("l", "r").alias("__c"))
    flip = F.when(F.col("__c") < -0.5, -F.col("r")).otherwise(F.col("r"))
    return join_per_key(df, c, ["asset_id"], "n").select("asset_id", "n", "l", flip.alias("r"))


def shift_audio(samples: DataFrame, delay_ms: float, rate: int) -> DataFrame:
    """Positive delays prepend silence, negative ones drop the head; a drop beyond the clip does nothing."""
    if abs(delay_ms) < 1.0:
        return samples
    d = int(delay_ms * rate / 1000.0)
    if d > 0:
        keys = samples.select(*KEY).distinct()
        pad = keys.select(*KEY, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(d - 1).cast("bigint"))).alias("n"), F.lit(0.0).alias("amp"))
        return samples.withColumn("n", F.col("n") + d).unionByName(pad)
    total = samples.groupBy(*KEY).agg((F.max("n") + 1).alias("__t"))
    df = join_per_key(samples, total, KEY, "n", last=F.col("__t") - 1)
    short = F.lit(-d) >= F.col("__t")
    kept = df.where(short | (F.col("n") >= -d))
    return kept.select(*KEY, F.when(short, F.col("n")).otherwise(F.col("n") + d).alias("n"), "amp")


def split_sources(samples: DataFrame) -> DataFrame:
    """Vocals L-R and accompaniment (L+R)/2; mono gives the signal and 0.3 of it."""
    side = samples.groupBy("asset_id", "n").agg(
        F.max(F.when(F.col("ch") == 0, F.col("amp"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("amp"))).alias("r")
    )
    lone = samples.groupBy("asset_id").agg(F.count_distinct("ch").alias("__c"))
    mono = F.col("__c") == 1
    y = F.coalesce("l", "r")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    return (
        join_per_key(side, lone, ["asset_id"], "n")
        .where(mono | both)
        .select(
            "asset_id",
            "n",
            F.when(mono, y).otherwise(F.col("l") - F.col("r")).alias("vocals"),
            F.when(mono, y * 0.3).otherwise((F.col("l") + F.col("r")) / 2).alias("accompaniment"),
        )
    )


def remix(dialogue: DataFrame, music: DataFrame, dialogue_db: float = 0.0, music_db: float = -6.0, headroom_db: float = 1.0) -> DataFrame:
    """Overlay at the dialogue's length, scaled to leave ``headroom_db``."""
    a, b = 10 ** (dialogue_db / 20), 10 ** (music_db / 20)
    m = music.select("asset_id", "n", F.col("amp").alias("__m"))
    df = dialogue.join(m, ["asset_id", "n"], "left")
    df = df.select("asset_id", "n", (F.col("amp") * a + F.coalesce("__m", F.lit(0.0)) * b).alias("amp"))
    top = df.groupBy("asset_id").agg(F.max(F.abs("amp")).alias("__p"), F.max("n").alias("__last"))
    k = F.when(F.col("__p") > 0, F.lit(10 ** (-headroom_db / 20)) / F.col("__p")).otherwise(1.0)
    return join_per_key(df, top, ["asset_id"], "n", last=F.col("__last")).select("asset_id", "n", (F.col("amp") * k).alias("amp"))


# Choices ------------------------------------------------------------------------------------------


def choose_noise_level(stats: DataFrame) -> DataFrame:
    """Denoise settings from SNR and noise floor."""
    snr = F.col("snr_db")
    level = F.when(snr < 10, F.lit("heavy")).when(snr < 20, F.lit("medium")).otherwise(F.lit("light"))
    df = stats.withColumn("level", level)
    lv = F.col("level")
    return df.select(
        *KEY,
        "level",
        F.when(lv == "light", 0.5).when(lv == "medium", 1.0).otherwise(1.5).alias("strength"),
        F.when(lv == "light", -45).when(lv == "medium", -40).otherwise(-35).alias("floor_db"),
        F.greatest(F.lit(-60.0), db(F.col("noise_floor") * 3)).alias("gate_db"),
    )


def noise_result(gain: DataFrame) -> DataFrame:
    g = F.col("gain_db")
    return gain.withColumn(
        "result",
        F.when(g > 2, F.lit("strong")).when(g > 0.5, F.lit("moderate")).when(g > -0.5, F.lit("kept")).otherwise(F.lit("overdone")),
    )


def choose_dynamics(stats: DataFrame) -> DataFrame:
    """Compressor settings: firm above 18 dB of crest, else gentle."""
    hard = F.col("crest_db") > 18
    return stats.select(
        *KEY,
        F.when(hard, -18).otherwise(-20).alias("threshold_db"),
        F.when(hard, 4.0).otherwise(2.5).alias("ratio"),
        F.when(hard, 3).otherwise(5).alias("attack_ms"),
        F.when(hard, 100).otherwise(150).alias("release_ms"),
    )


def dynamics_effect(before: DataFrame, after: DataFrame) -> DataFrame:
    """How far the crest factor fell and the loudness rose, with a label: marked above 2 dB, moderate above 1, else kept."""
    j = before.select(*KEY, "crest_db", "rms").join(after.select(*KEY, F.col("crest_db").alias("__c"), F.col("rms").alias("__r")), KEY)
    less = F.col("crest_db") - F.col("__c")
    label = F.when(less > 2, F.lit("marked")).when(less > 1, F.lit("moderate")).otherwise(F.lit("kept"))
    return j.select(*KEY, less.alias("range_reduction_db"), db(F.col("__r") / (F.col("rms") + EPS)).alias("loudness_gain_db"), label.alias("label"))


def compare_audio(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deltas of two :func:`signal_stats` tables with status words and an overall grade.

    A ``centroid`` column on both sides is compared too when present.
    """
    cols = [c for c in ("snr_db", "crest_db", "rms", "centroid") if c in before.columns]
    j = before.select(*KEY, *cols).join(after.select(*KEY, *[F.col(c).alias(f"__{c}") for c in cols]), KEY)
    snr, rng = F.col("__snr_db") - F.col("snr_db"), F.col("__crest_db") - F.col("crest_db")

    def word(delta: Column) -> Column:
        return F.when(delta > 1, F.lit("better")).when(delta > 0, F.lit("slightly_better")).otherwise(F.lit("same"))

    out = [
        snr.alias("snr_delta_db"),
        rng.alias("range_delta_db"),
        db(F.col("__rms") / (F.col("rms") + EPS)).alias("rms_delta_db"),
        word(snr).alias("snr_status"),
        word(rng).alias("range_status"),
        F.when((snr > 3) & (rng > 2), F.lit("major"))
        .when((snr > 1) | (rng > 1), F.lit("medium"))
        .when((snr > 0) | (rng > 0), F.lit("minor"))
        .otherwise(F.lit("none"))
        .alias("overall"),
    ]
    if "centroid" in cols:
        shift = F.col("__centroid") - F.col("centroid")
        out += [
            shift.alias("centroid_delta"),
            F.when(shift < -100, F.lit("effective")).when(shift < 0, F.lit("slight")).otherwise(F.lit("none")).alias("noise_status"),
        ]
    return j.select(*KEY, *out)
