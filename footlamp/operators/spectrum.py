"""Audio spectra, on packed blocks audio_block(asset_id, hop, samples) and spectrum(asset_id, hop, mag, phase).

A block is one packed row; the transform is a vectorised FFT in the task that holds it. Averages explode
bins and fold them with partial aggregation to one row per (asset, bin) before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footlamp.functions.scalars import EPS, clamp, db, ratio
from footlamp.plans.joins import join_per_key
from footlamp.plans.ordered import exact_percentiles, number_rows, sliding

BLOCK = 1024

# Bands in Hz.
AMBIENT_BANDS = [(0, 200), (200, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 8000)]
TEN_BANDS = {
    "sub_bass": (20, 60), "bass": (60, 250), "low_mid": (250, 500), "mid": (500, 1000), "voice": (1000, 2000),
    "formant": (2000, 4000), "clarity": (4000, 6000), "presence": (6000, 8000), "high": (8000, 12000),
    "very_high": (12000, 20000),
}
SEVEN_BANDS = {
    "sub_bass": (20, 60), "bass": (60, 250), "low_mid": (250, 500), "mid": (500, 2000),
    "high_mid": (2000, 4000), "presence": (4000, 6000), "brilliance": (6000, 20000),
}
# Speech bands in Hz with their gain in dB.
SPEECH_BANDS = [("fundamental", 80, 250, 1.0), ("vowel_clarity", 250, 800, 2.0), ("consonant_clarity", 800, 2500, 3.0),
                ("presence", 2500, 4000, 2.5), ("brilliance", 4000, 8000, 1.5)]
# Factor of each speech band's gain by venue.
VENUE_FACTORS = {
    "small": {"fundamental": 0.8, "vowel_clarity": 0.9, "consonant_clarity": 1.0, "presence": 1.1, "brilliance": 1.2},
    "medium": {"fundamental": 1.0, "vowel_clarity": 1.0, "consonant_clarity": 1.0, "presence": 1.0, "brilliance": 1.0},
    "large": {"fundamental": 1.2, "vowel_clarity": 1.1, "consonant_clarity": 1.0, "presence": 0.9, "brilliance": 0.8},
}
# Harmonic band in Hz and its factor.
HARMONIC_BAND = (80, 400, 1.2)
# Sharpening strength by venue.
SHARPEN = {"small": 0.1, "medium": 0.2, "large": 0.3}
# Formant ranges in Hz, and the boost of each in dB by venue.
FORMANTS = [(300, 800), (800, 2500), (2500, 3500)]
FORMANT_BOOSTS = {"small": [1.0, 1.5, 1.0], "medium": [1.5, 2.0, 1.5], "large": [2.0, 2.5, 2.0]}

# Factors of the side signal from 1 kHz and from 4 kHz on, by venue.
WIDTH_BANDS = (1000, 4000)
WIDTH_CURVE = {"small": (1.1, 1.05), "medium": (1.2, 1.1), "large": (1.3, 1.15)}

DOUBLES = T.ArrayType(T.DoubleType())
SPECTRUM = T.StructType([T.StructField("mag", DOUBLES), T.StructField("phase", DOUBLES)])


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


@F.pandas_udf(SPECTRUM)
def _forward(samples: pd.Series) -> pd.DataFrame:
    if not len(samples):
        return pd.DataFrame({"mag": pd.Series([], dtype=object), "phase": pd.Series([], dtype=object)})
    x = np.stack(samples.to_numpy())
    z = np.fft.rfft(x * hann(x.shape[1]), axis=1)
    return pd.DataFrame({"mag": list(np.abs(z)), "phase": list(np.angle(z))})


@F.pandas_udf(DOUBLES)
def _inverse(mag: pd.Series, phase: pd.Series) -> pd.Series:
    if not len(mag):
        return pd.Series([], dtype=object)
    z = np.stack(mag.to_numpy()) * np.exp(1j * np.stack(phase.to_numpy()))
    return pd.Series(list(np.fft.irfft(z, axis=1)), dtype=object)


# Transform ----------------------------------------------------------------------------------------


def frame_samples(samples: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Complete frames of ``size`` samples at every ``hop`` (a divisor of it), packed in sample order.

    Samples are packed once per hop block and frames are joined from neighbouring blocks, so each
    sample is shuffled once as a row and not once per frame that contains it.
    """
    k = size // hop
    cells = F.array_sort(F.collect_list(F.struct("n", "amp")))
    blocks = samples.groupBy(*keys, F.floor(F.col("n") / hop).cast("bigint").alias("hop")).agg(
        F.transform(cells, lambda c: c["amp"]).alias("part")
    )

    def make(w):
        parts = [F.when(F.lead("hop", i).over(w) == F.col("hop") + i, F.lead("part", i).over(w)) for i in range(1, k)]
        return {"samples": F.concat(F.col("part"), *parts) if parts else F.col("part")}

    framed = sliding(blocks, keys, "hop", make, after=max(k - 1, 0), size=BLOCK)
    return framed.where(F.size("samples") == size).select(*keys, "hop", "samples")


def stft(blocks: DataFrame) -> DataFrame:
    """Magnitude and phase of each packed block (Hann window, one block length per table)."""
    keep = [c for c in blocks.columns if c != "samples"]
    return blocks.withColumn("__z", _forward("samples")).select(*keep, "__z.mag", "__z.phase")


def istft(spectra: DataFrame, keys: list[str], size: int, hop: int) -> DataFrame:
    """Overlap-add resynthesis; samples without window weight are 0."""
    w = F.array(*[F.lit(float(v)) for v in hann(size)])
    parts = spectra.select(*keys, "hop", F.posexplode(_inverse("mag", "phase")).alias("i", "v"))
    weight = F.get(w, F.col("i"))
    per = parts.groupBy(*keys, (F.col("hop") * hop + F.col("i")).alias("n")).agg(
        F.sum(F.col("v") * weight).alias("__s"), F.sum(weight * weight).alias("__w")
    )
    return per.select(*keys, "n", F.when(F.col("__w") > 1e-8, F.col("__s") / F.col("__w")).otherwise(0.0).alias("amp"))


def _freq(i: Column, step: float) -> Column:
    return i * F.lit(float(step))


def bins(spectra: DataFrame, step: float) -> DataFrame:
    return spectra.select("asset_id", "hop", F.posexplode("mag").alias("bin", "mag")).withColumn("freq", _freq(F.col("bin"), step))


def mean_spectrum(spectra: DataFrame, step: float) -> DataFrame:
    """Mean magnitude per (asset, bin)."""
    return bins(spectra, step).groupBy("asset_id", "bin", "freq").agg(F.avg("mag").alias("mag"))


# Measures -----------------------------------------------------------------------------------------


def _between(lo: float, hi: float) -> Column:
    return (F.col("freq") >= lo) & (F.col("freq") <= hi)


def ambient_profile(blocks: DataFrame, step: float) -> DataFrame:
    """Mean magnitude per half-open band over the quietest fifth of the blocks."""
    level = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples"))
    leveled = blocks.withColumn("rms", level)
    p = exact_percentiles(leveled, ["asset_id"], "rms", {"p20": 0.20})
    quiet = join_per_key(leveled, p, ["asset_id"], "hop").where(F.col("rms") <= F.col("p20")).select("asset_id", "hop", "samples")
    m = mean_spectrum(stft(quiet), step)
    f = F.col("freq")
    return m.groupBy("asset_id").agg(
        *[F.avg(F.when((f >= lo) & (f < hi), F.col("mag"))).alias(f"band_{i}") for i, (lo, hi) in enumerate(AMBIENT_BANDS)]
    )


def band_energy(spectra: DataFrame, step: float, bands: dict | None = None) -> DataFrame:
    """Mean magnitude per named band, closed at both ends, and the two speech ratios."""
    bands = bands or TEN_BANDS
    m = mean_spectrum(spectra, step)
    df = m.groupBy("asset_id").agg(*[F.avg(F.when(_between(*b), F.col("mag"))).alias(n) for n, b in bands.items()])
    if "formant" not in bands:
        return df
    return df.withColumn("speech_to_bass", F.coalesce("formant", F.lit(0.0)) / (F.coalesce("bass", F.lit(1.0)) + EPS)).withColumn(
        "clarity_to_speech", F.coalesce("clarity", F.lit(0.0)) / (F.coalesce("formant", F.lit(0.0)) + EPS)
    )


def design_eq(bands: DataFrame) -> DataFrame:
    """Filter settings from :func:`band_energy`."""

    def c(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    deep, bright = c("bass") > c("mid"), c("high") > c("formant")
    s, k = F.col("speech_to_bass"), F.col("clarity_to_speech")
    return bands.select(
        "asset_id",
        F.when(deep, 100).otherwise(80).alias("low_cut_hz"),
        F.when(deep, -6).otherwise(-3).alias("low_cut_db"),
        F.when(s < 1.0, 5).when(s < 1.5, 3).otherwise(2).alias("speech_db"),
        F.when(s < 1.0, 1.2).when(s < 1.5, 1.0).otherwise(0.8).alias("speech_q"),
        F.when(k < 1.2, 5000).otherwise(4500).alias("clarity_hz"),
        F.when(k < 0.8, 4).when(k < 1.2, 2).otherwise(1).alias("clarity_db"),
        F.when(k < 0.8, 0.8).when(k < 1.2, 0.7).otherwise(0.6).alias("clarity_q"),
        F.when(bright, 10000).otherwise(12000).alias("high_cut_hz"),
        F.when(bright, -4).otherwise(-2).alias("high_cut_db"),
    )


def hop_descriptors(spectra: DataFrame, step: float, share: float = 0.85) -> DataFrame:
    """Centroid, bandwidth and roll-off of each hop, from the packed magnitudes."""
    m = F.col("mag")
    total = F.aggregate(m, F.lit(0.0), lambda a, v: a + v)
    df = spectra.select("asset_id", "hop", "mag", total.alias("__t"))
    zero = F.lit(0.0)
    weighted = F.aggregate(F.transform(m, lambda v, i: v * _freq(i, step)), zero, lambda a, v: a + v)
    df = df.withColumn("centroid", F.when(F.col("__t") > 0, weighted / F.col("__t")).otherwise(0.0))
    spread = F.aggregate(
        F.transform(m, lambda v, i: v * F.pow(_freq(i, step) - F.col("centroid"), 2)), zero, lambda a, v: a + v
    )
    df = df.withColumn("bandwidth", F.when(F.col("__t") > 0, F.sqrt(spread / F.col("__t"))).otherwise(0.0))
    start = F.struct(zero.alias("c"), F.lit(0).alias("n"))
    walked = F.aggregate(
        m,
        start,
        lambda a, v: F.struct(
            (a["c"] + v).alias("c"), (a["n"] + F.when(a["c"] + v < F.col("__t") * share, 1).otherwise(0)).alias("n")
        ),
    )
    return df.select("asset_id", "hop", "centroid", "bandwidth", (walked["n"] * step).alias("rolloff"))


def spectral_descriptors(spectra: DataFrame, step: float) -> DataFrame:
    """Mean and deviation of the hop descriptors, and SNR against the lowest tenth of all magnitudes."""
    per = hop_descriptors(spectra, step)
    out = per.groupBy("asset_id").agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("centroid", "bandwidth", "rolloff")],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in ("centroid", "bandwidth", "rolloff")],
    )
    cells = bins(spectra, step)
    k = exact_percentiles(cells, ["asset_id"], "mag", {"edge": lambda n: F.greatest(F.lit(0), F.floor(n * 0.1) - 1)})
    lv = join_per_key(cells, k, ["asset_id"], "hop").groupBy("asset_id").agg(
        F.avg("mag").alias("signal"),
        F.floor(F.count(F.lit(1)) * 0.1).alias("__k"),
        F.sum(F.when(F.col("mag") < F.col("edge"), F.col("mag")).otherwise(0.0)).alias("__s"),
        F.count_if(F.col("mag") < F.col("edge")).alias("__c"),
        F.max("edge").alias("__e"),
    )
    floor = ratio(F.col("__s") + (F.col("__k") - F.col("__c")) * F.col("__e"), F.col("__k"))
    lv = lv.select("asset_id", floor.alias("noise_floor"), db(F.col("signal") / (floor + EPS)).alias("snr_db"))
    return out.join(lv, "asset_id")


def mel_weights(n_bins: int, step: float, n_mels: int) -> np.ndarray:
    """Triangular filters, even on a scale that is linear to 1 kHz and logarithmic above, unit area."""

    def to_mel(f):
        return np.where(f < 1000, f * 3 / 200, 15 + 27 * np.log(np.maximum(f, 1e-12) / 1000) / np.log(6.4))

    def to_hz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))

    f = np.arange(n_bins) * step
    edges = to_hz(np.linspace(0, to_mel(np.array(f[-1])), n_mels + 2))
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    up, down = (f - lo) / (mid - lo), (hi - f) / (hi - mid)
    return np.maximum(0, np.minimum(up, down)) * (2 / (hi - lo))


def mfcc(spectra: DataFrame, step: float, n: int = 13, n_mels: int = 16) -> DataFrame:
    """Mean and deviation of ``n`` cepstral coefficients per asset (orthonormal cosine transform)."""

    @F.pandas_udf(DOUBLES)
    def coefficients(mag: pd.Series) -> pd.Series:
        if not len(mag):
            return pd.Series([], dtype=object)
        m = np.stack(mag.to_numpy())
        level = 10 * np.log10(np.maximum(1e-10, m**2 @ mel_weights(m.shape[1], step, n_mels).T))
        k, j = np.arange(n)[:, None], np.arange(n_mels)[None, :]
        basis = np.cos(np.pi * k * (2 * j + 1) / (2 * n_mels)) * np.sqrt(2 / n_mels)
        basis[0] /= np.sqrt(2)
        return pd.Series(list(level @ basis.T), dtype=object)

    px = spectra.select("asset_id", F.posexplode(coefficients("mag")).alias("coef", "v"))
    return px.groupBy("asset_id", "coef").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def dialogue_range(spectra: DataFrame, step: float, lo: float = 300, hi: float = 8000) -> DataFrame:
    """Frequencies where the running mean magnitude reaches a tenth and nine tenths; bins bound the window."""
    m = mean_spectrum(spectra, step).where(_between(lo, hi))
    w = Window.partitionBy("asset_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    c = m.withColumn("__c", F.sum("mag").over(w)).withColumn("__t", F.sum("mag").over(Window.partitionBy("asset_id")))
    return c.groupBy("asset_id").agg(
        F.min(F.when(F.col("__c") >= F.col("__t") * 0.1, F.col("freq"))).alias("low_hz"),
        F.min(F.when(F.col("__c") >= F.col("__t") * 0.9, F.col("freq"))).alias("high_hz"),
    )


def noise_profile(blocks: DataFrame, step: float, rate: int, seconds: float | None = None) -> DataFrame:
    """Mean spectrum of the quietest fifth of the samples, or of the first ``seconds`` of those.

    Assets whose samples are all equally loud use the blocks with the lowest tenth of energy instead.
    """
    size = F.size("samples")
    px = blocks.select("asset_id", (F.col("hop") * size).alias("__o"), F.posexplode("samples").alias("i", "amp"))
    px = px.select("asset_id", (F.col("__o") + F.col("i")).alias("n"), "amp", F.abs("amp").alias("mag"))
    p = exact_percentiles(px, ["asset_id"], "mag", {"p20": 0.20})
    quiet = join_per_key(px, p, ["asset_id"], "n").where(F.col("mag") < F.col("p20")).select("asset_id", "n", "amp")
    seq = number_rows(quiet, ["asset_id"], ["n"], F.floor(F.col("n") / 65536).cast("bigint"), "m")
    seq = seq if seconds is None else seq.where(F.col("m") < seconds * rate)
    length = int(round(rate / step))
    framed = frame_samples(seq.select("asset_id", F.col("m").alias("n"), "amp"), ["asset_id"], length, length)
    main = mean_spectrum(stft(framed), step)
    spectra = stft(blocks).withColumn("energy", F.aggregate("mag", F.lit(0.0), lambda a, v: a + v * v))
    rest = spectra.join(main.select("asset_id").distinct(), "asset_id", "left_anti")
    e = exact_percentiles(rest, ["asset_id"], "energy", {"p10": 0.10})
    low = join_per_key(rest, e, ["asset_id"], "hop").where(F.col("energy") < F.col("p10")).drop("energy", "p10")
    return main.unionByName(mean_spectrum(low, step))


def recommend_audio(analysis: DataFrame) -> DataFrame:
    """Needs ``noise_mean``, ``low_hz``, ``high_hz`` and ``dynamic_range_db``."""
    noise, width, r = F.col("noise_mean"), F.col("high_hz") - F.col("low_hz"), F.col("dynamic_range_db")
    return analysis.select(
        "asset_id",
        F.when(noise > 0.1, 0.8).when(noise > 0.05, 0.5).otherwise(0.2).alias("noise_reduction"),
        F.when(width < 2000, 0.6).when(width < 4000, 0.4).otherwise(0.2).alias("dialogue_enhancement"),
        F.when(r > 20, F.lit("large")).when(r > 15, F.lit("medium")).otherwise(F.lit("small")).alias("venue"),
    )


def block_levels(blocks: DataFrame) -> DataFrame:
    """Peak over rms per asset in dB, from packed blocks."""
    sq = F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v)
    lv = blocks.groupBy("asset_id").agg(
        F.sum(sq).alias("__s"), F.sum(F.size("samples")).alias("__n"), F.max(F.array_max(F.transform("samples", F.abs))).alias("peak")
    )
    rms = F.sqrt(F.col("__s") / F.col("__n"))
    return lv.select("asset_id", rms.alias("rms"), "peak", F.when(rms > 0, db(F.col("peak") / rms)).otherwise(0.0).alias("dynamic_range_db"))


def thd_estimate(spectra: DataFrame, step: float, split_hz: float = 5000) -> DataFrame:
    """High-band share of the audible energy, and the harmonic variant."""
    m2 = F.col("mag") * F.col("mag")

    def energy(cond: Column) -> Column:
        return F.sum(F.when(cond, m2).otherwise(0.0))

    per = bins(spectra, step).groupBy("asset_id").agg(
        energy(_between(20, 20000)).alias("__all"),
        energy(_between(20, 20000) & (F.col("freq") > split_hz)).alias("__high"),
        energy(_between(100, 1000)).alias("__base"),
        energy(_between(1000, 10000)).alias("__harm"),
    )
    both = F.col("__base") + F.col("__harm")
    return per.select(
        "asset_id",
        F.least(F.col("__high") / (F.col("__all") + EPS), F.lit(1.0)).alias("thd"),
        F.when(both > 0, F.least(F.col("__harm") / both, F.lit(1.0))).otherwise(0.0).alias("thd_harmonic"),
    )


def dialogue_clarity(spectra: DataFrame, step: float) -> DataFrame:
    per = bins(spectra, step).groupBy("asset_id").agg(
        F.avg(F.when(_between(300, 3400), F.col("mag"))).alias("__s"), F.avg("mag").alias("__a")
    )
    share = ratio(F.coalesce("__s", F.lit(0.0)), F.col("__a")) * 2
    return per.select("asset_id", F.when(F.col("__a") > 0, F.least(F.lit(1.0), share)).otherwise(0.0).alias("clarity"))


def clarity_gain(before: DataFrame, after: DataFrame, step: float) -> DataFrame:
    """Pairwise variant: change of the 2-4 kHz mean, at most doubled, halved."""

    def speech(s: DataFrame, name: str) -> DataFrame:
        return bins(s, step).where(_between(2000, 4000)).groupBy("asset_id").agg(F.avg("mag").alias(name))

    j = speech(before, "a").join(speech(after, "b"), "asset_id")
    gain = F.when(F.col("a") > 0, F.least(F.col("b") / F.col("a"), F.lit(2.0)) / 2.0).otherwise(0.5)
    return j.select("asset_id", gain.alias("clarity"))


def naturalness(before: DataFrame, after: DataFrame, step: float) -> DataFrame:
    """Correlation of the mean spectra (their scale does not matter), not below 0."""
    a, b = mean_spectrum(before, step), mean_spectrum(after, step).withColumnRenamed("mag", "other")
    j = a.join(b.drop("freq"), ["asset_id", "bin"])
    return j.groupBy("asset_id").agg(F.greatest(F.lit(0.0), F.corr("mag", "other")).alias("naturalness"))


def audio_quality(before: DataFrame, after: DataFrame, step: float) -> DataFrame:
    """Paired metrics of two packed block tables in one row per asset, with the overall score."""
    parts = []
    for name, blocks in (("before", before), ("after", after)):
        px = blocks.select("asset_id", F.explode("samples").alias("v")).select("asset_id", F.abs("v").alias("mag"))
        p = exact_percentiles(px, ["asset_id"], "mag", {"noise": 0.10})
        lv = block_levels(blocks).join(p, "asset_id")
        spectra = stft(blocks)
        thd = thd_estimate(spectra, step).select("asset_id", (F.col("thd_harmonic") * 100).alias(f"thd_pct_{name}"))
        centre = hop_descriptors(spectra, step).groupBy("asset_id").agg(F.avg("centroid").alias(f"centroid_{name}"))
        snr = F.when(F.col("noise") > 0, db(F.col("rms") / F.col("noise"))).otherwise(60.0)
        lv = lv.select("asset_id", snr.alias(f"snr_{name}"), F.col("dynamic_range_db").alias(f"range_{name}"))
        parts.append(lv.join(thd, "asset_id").join(centre, "asset_id"))
    a, b = stft(before), stft(after)
    df = parts[0].join(parts[1], "asset_id").join(naturalness(a, b, step), "asset_id").join(clarity_gain(a, b, step), "asset_id")
    df = (
        df.withColumn("snr_gain_db", F.col("snr_after") - F.col("snr_before"))
        .withColumn("range_change_db", F.col("range_after") - F.col("range_before"))
        .withColumn("centroid_shift_hz", F.col("centroid_after") - F.col("centroid_before"))
    )
    kept = F.greatest(F.lit(0.0), 1.0 - F.abs("range_change_db") / 10.0)
    score = (
        0.3 * F.least(F.col("snr_gain_db") / 10.0, F.lit(1.0)) + 0.25 * F.col("naturalness") + 0.25 * F.col("clarity") + 0.2 * kept
    )
    return df.withColumn("score", clamp(score, 0.0, 1.0))


def phase_difference(spectra: DataFrame) -> DataFrame:
    """Mean absolute phase difference of the two channels; ``spectra`` carries ``ch``."""
    pair = spectra.groupBy("asset_id", "hop").agg(
        F.max(F.when(F.col("ch") == 0, F.col("phase"))).alias("l"), F.max(F.when(F.col("ch") == 1, F.col("phase"))).alias("r")
    )
    cells = pair.where(F.col("l").isNotNull() & F.col("r").isNotNull()).select(
        "asset_id", F.explode(F.zip_with("l", "r", lambda a, b: F.abs(a - b))).alias("d")
    )
    return cells.groupBy("asset_id").agg(F.avg("d").alias("phase_difference"))


def mean_centroid(spectra: DataFrame, keys: list[str], step: float) -> DataFrame:
    """Spectral centroid in Hz, averaged over the blocks of each key; silent blocks do not count."""
    total = F.aggregate("mag", F.lit(0.0), lambda a, m: a + m)
    moment = F.aggregate(F.transform("mag", lambda m, i: m * i * F.lit(step)), F.lit(0.0), lambda a, m: a + m)
    return spectra.groupBy(*keys).agg(F.avg(F.try_divide(moment, total)).alias("centroid"))


# Filters ------------------------------------------------------------------------------------------


def width_curve(pairs: DataFrame, step: float, size: int, hop: int, venue: str = "medium") -> DataFrame:
    """Stereo width by frequency: the side signal's bins are scaled by the venue's curve, with middle and high bands apart.

    Frames are ``size`` samples at every ``hop``. Samples behind the last complete frame keep their side signal. The overall
    width and the peak limit are ``audio.mid_side_width`` on the result.
    """
    middle, high = WIDTH_CURVE.get(venue, WIDTH_CURVE["medium"])
    side = pairs.select("asset_id", "n", ((F.col("l") - F.col("r")) / 2).alias("amp"))
    bands = stft(frame_samples(side, ["asset_id"], size, hop))
    low_hz, high_hz = WIDTH_BANDS

    def scaled(m, i):
        hz = i * F.lit(step)
        return m * F.when(hz >= high_hz, F.lit(high)).when(hz >= low_hz, F.lit(middle)).otherwise(F.lit(1.0))

    wide = istft(bands.withColumn("mag", F.transform("mag", scaled)), ["asset_id"], size, hop)
    both = pairs.join(wide.withColumnRenamed("amp", "__side"), ["asset_id", "n"], "left")
    mid, width = (F.col("l") + F.col("r")) / 2, F.coalesce("__side", (F.col("l") - F.col("r")) / 2)
    return both.select("asset_id", "n", (mid + width).alias("l"), (mid - width).alias("r"))


def spectral_gate(spectra: DataFrame, noise_floor_db: float = -60.0, strength: float = 0.5, keep_speech: bool = True) -> DataFrame:
    """Attenuate bins below their own 20th percentile over time (never below the noise floor)."""
    cells = spectra.select("asset_id", F.posexplode("mag").alias("bin", "m"))
    p = exact_percentiles(cells, ["asset_id", "bin"], "m", {"p20": 0.20})
    floor = 10 ** (noise_floor_db / 20)
    rows = F.array_sort(F.collect_list(F.struct("bin", F.greatest(F.col("p20"), F.lit(floor)).alias("t"))))
    limits = p.groupBy("asset_id").agg(F.transform(rows, lambda r: r["t"]).alias("__t"))
    least = 0.1 if keep_speech else 0.05

    def gate(m: Column, t: Column) -> Column:
        r = m / (t + EPS)
        g = F.when(r > 1.0, 1.0).otherwise(F.pow(r, F.lit(1.0 + strength)))
        return m * F.greatest(g, F.lit(least))

    return join_per_key(spectra, limits, ["asset_id"], "hop").withColumn("mag", F.zip_with("mag", "__t", gate)).drop("__t")


def spectral_gain(spectra: DataFrame, step: float, table: list[tuple[float, float, float]], to: str = "mag") -> DataFrame:
    """Multiply bins by (low Hz, high Hz, dB) rows, closed at both ends: shared edges multiply twice."""

    def apply(m: Column, i: Column) -> Column:
        f = _freq(i, step)
        out = m
        for lo, hi, gain in table:
            out = out * F.when((f >= lo) & (f <= hi), F.lit(10 ** (gain / 20))).otherwise(1.0)
        return out

    return spectra.withColumn(to, F.transform("mag", apply))


def formant_table(venue: str = "medium") -> list[tuple[float, float, float]]:
    boosts = FORMANT_BOOSTS.get(venue, FORMANT_BOOSTS["medium"])
    return [(lo, hi, gain) for (lo, hi), gain in zip(FORMANTS, boosts)]


def speech_table(venue: str = "medium") -> list[tuple[float, float, float]]:
    factors = VENUE_FACTORS.get(venue, VENUE_FACTORS["medium"])
    return [(lo, hi, gain * factors[name]) for name, lo, hi, gain in SPEECH_BANDS]


def dialogue_mask(spectra: DataFrame, step: float, lo: float = 300.0, hi: float = 3400.0, to: str = "mag") -> DataFrame:
    """Soft roll-off on both sides of the dialogue range."""

    def apply(m: Column, i: Column) -> Column:
        f = _freq(i, step)
        return m * F.when(f < lo, F.exp(-(lo - f) / (lo * 0.3))).when(f > hi, F.exp(-(f - hi) / (hi * 0.3))).otherwise(1.0)

    return spectra.withColumn(to, F.transform("mag", apply))


def smoothing_matrix(n: int, sigma: float) -> np.ndarray:
    """Gaussian over bins, four deviations wide, borders mirrored with repetition."""
    r = int(4 * sigma + 0.5)
    d = np.arange(-r, r + 1)
    k = np.exp(-(d**2) / (2 * sigma * sigma))
    k /= k.sum()
    pos = np.arange(n)[:, None] + d[None, :]
    pos = np.mod(pos, 2 * n)
    pos = np.where(pos >= n, 2 * n - 1 - pos, pos)
    out = np.zeros((n, n))
    np.add.at(out, (np.repeat(np.arange(n), len(d)), pos.ravel()), np.tile(k, n))
    return out


def spectral_sharpen(spectra: DataFrame, venue: str = "medium", sigma: float = 2.0) -> DataFrame:
    power = 1.0 + SHARPEN.get(venue, 0.2)

    @F.pandas_udf(DOUBLES)
    def sharpen(mag: pd.Series) -> pd.Series:
        if not len(mag):
            return pd.Series([], dtype=object)
        m = np.stack(mag.to_numpy())
        soft = m @ smoothing_matrix(m.shape[1], sigma).T
        return pd.Series(list(soft * (m / (soft + EPS)) ** power), dtype=object)

    return spectra.withColumn("mag", sharpen("mag"))


def onsets(spectra: DataFrame) -> DataFrame:
    """Spectral flux per hop; an onset is a local peak above the asset's mean flux."""
    df = sliding(spectra.select("asset_id", "hop", "mag"), ["asset_id"], "hop", lambda w: {"__p": F.lag("mag").over(w)}, before=1, size=BLOCK)
    rise = F.zip_with("mag", "__p", lambda a, b: F.greatest(a - b, F.lit(0.0)))
    flux = F.coalesce(F.aggregate(rise, F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    df = df.select("asset_id", "hop", flux.alias("flux"))
    mean = df.groupBy("asset_id").agg(F.avg("flux").alias("__m"))
    near = sliding(df, ["asset_id"], "hop", lambda w: {"__l": F.lag("flux").over(w), "__r": F.lead("flux").over(w)}, before=1, after=1, size=BLOCK)
    f = F.col("flux")
    peak = (f > F.coalesce("__l", F.lit(-1.0))) & (f >= F.coalesce("__r", F.lit(-1.0))) & (f > F.col("__m"))
    return join_per_key(near, mean, ["asset_id"], "hop").select("asset_id", "hop", "flux", peak.alias("onset"))


def transient_boost(blocks: DataFrame, size: int, rate: int, factor: float = 1.15, window_s: float = 0.02) -> DataFrame:
    """Multiply the samples around each onset; windows that overlap multiply again."""
    half = int(window_s * rate) // 2
    reach = -(-half // size)
    marks = onsets(stft(blocks)).select("asset_id", "hop", F.col("onset").cast("int").alias("__o"))

    def make(w):
        out = {}
        for d in range(-reach, reach + 1):
            # an onset at hop + d reaches this block
            out[f"__o{d + reach}"] = F.coalesce(F.lead("__o", d).over(w), F.lit(0))
        return out

    near = sliding(marks, ["asset_id"], "hop", make, before=reach, after=reach, size=BLOCK)
    df = blocks.join(near, ["asset_id", "hop"])

    def boost(v: Column, i: Column) -> Column:
        hits = F.lit(0)
        for d in range(-reach, reach + 1):
            offset = i - d * size
            hits = hits + F.when((offset >= -half) & (offset < half), F.col(f"__o{d + reach}")).otherwise(0)
        return v * F.pow(F.lit(factor), hits)

    return df.select("asset_id", "hop", F.transform("samples", boost).alias("samples"))
