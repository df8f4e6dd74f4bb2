"""Queries: audio spectra (AUD7-14, 16, 18-21, 23, 27-30, 39)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from footlamp.catalog.audio import PROC, SAMPLE_CTE, STEREO, stats_sql
from footlamp.catalog.audio import processed as processed_samples
from footlamp.catalog.fixtures import SPECTRUM_CTE, audio_blocks, audio_samples
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.scalars import r6
from footlamp.operators import audio as A
from footlamp.operators import spectrum as S

STEP = 125.0
MEAN = "ms AS (SELECT asset_id, bin, freq, avg(mag) AS mag FROM spec GROUP BY asset_id, bin, freq)"


def rounded(df, *cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def spectra(t):
    return S.stft(audio_blocks(t))


def processed_blocks(t):
    return audio_blocks(t).withColumn("samples", F.transform("samples", lambda v: 0.6 * F.tanh(v * 3.0)))


# Spectrum of the processed blocks under the names block2 / spec2.
AFTER_CTE = "block2 AS (SELECT asset_id, hop, n, 0.6e0 * tanh(amp * 3) AS amp FROM block), " + (
    "spec2 AS (SELECT asset_id, hop, bin, bin * 125e0 AS freq, sqrt(sum(amp * c) * sum(amp * c) + sum(amp * s) * sum(amp * s)) AS mag "
    "FROM block2 JOIN basis USING (n) GROUP BY asset_id, hop, bin)"
)


def exploded(df, *arrays):
    first, *rest = arrays
    e = df.select("asset_id", "hop", *rest, F.posexplode(first).alias("bin", first))
    return e.select("asset_id", "hop", "bin", first, *[F.get(c, F.col("bin")).alias(c) for c in rest])


@query("aud7_stft", f"WITH {SPECTRUM_CTE} SELECT asset_id, hop, CAST(bin AS INT) AS bin, {S6('mag')} AS mag, {S6('mag * cos(atan2(im, re))')} AS re, {S6('mag * sin(atan2(im, re))')} AS im FROM spec")
def aud7(t):
    e = exploded(spectra(t), "mag", "phase")
    return e.select(
        "asset_id", "hop", "bin", r6(F.col("mag")).alias("mag"), r6(F.col("mag") * F.cos("phase")).alias("re"), r6(F.col("mag") * F.sin("phase")).alias("im")
    )


@query(
    "aud8_istft",
    f"""WITH {SAMPLE_CTE}, k AS (SELECT asset_id, ch, count(*) AS c FROM smp GROUP BY asset_id, ch)
    SELECT s.asset_id, s.ch, n, {S6('CASE WHEN n = 0 THEN 0 ELSE amp END')} AS amp FROM smp s JOIN k ON k.asset_id = s.asset_id AND k.ch = s.ch WHERE c >= 16 AND n < (c - 16) // 4 * 4 + 16""",
)
def aud8(t):
    keys = ["asset_id", "ch"]
    framed = S.frame_samples(audio_samples(t), keys, 16, 4)
    return rounded(S.istft(S.stft(framed), keys, 16, 4), "amp")


@query(
    "aud9_ambient_profile",
    f"""WITH {SPECTRUM_CTE}, b AS (SELECT asset_id, hop, sqrt(avg(amp * amp)) AS rms FROM block GROUP BY asset_id, hop), p AS (SELECT asset_id, quantile_cont(rms, 0.2) AS p20 FROM b GROUP BY asset_id),
    q AS (SELECT b.asset_id, b.hop FROM b JOIN p ON p.asset_id = b.asset_id AND rms <= p20), m AS (SELECT asset_id, bin, freq, avg(mag) AS mag FROM spec JOIN q USING (asset_id, hop) GROUP BY asset_id, bin, freq)
    SELECT asset_id, {', '.join(f"{S6(f'avg(mag) FILTER (WHERE freq >= {lo} AND freq < {hi})')} AS band_{i}" for i, (lo, hi) in enumerate(S.AMBIENT_BANDS))} FROM m GROUP BY asset_id""",
)
def aud9(t):
    return rounded(S.ambient_profile(audio_blocks(t), STEP), *[f"band_{i}" for i in range(len(S.AMBIENT_BANDS))])


def bands_sql(bands) -> str:
    return ", ".join(f"avg(mag) FILTER (WHERE freq BETWEEN {lo} AND {hi}) AS {n}" for n, (lo, hi) in bands.items())


RATIOS = "coalesce(formant, 0) / (coalesce(bass, 1) + 1e-10) AS speech_to_bass, coalesce(clarity, 0) / (coalesce(formant, 0) + 1e-10) AS clarity_to_speech"
TEN = f"be AS (SELECT asset_id, {bands_sql(S.TEN_BANDS)} FROM ms GROUP BY asset_id), br AS (SELECT *, {RATIOS} FROM be)"
TEN_COLS = [*S.TEN_BANDS, "speech_to_bass", "clarity_to_speech"]


@query("aud10_band_energy", f"WITH {SPECTRUM_CTE}, {MEAN}, {TEN} SELECT asset_id, {', '.join(f'{S6(c)} AS {c}' for c in TEN_COLS)} FROM br")
def aud10(t):
    return rounded(S.band_energy(spectra(t), STEP), *TEN_COLS)


@query(
    "aud10_seven_bands",
    f"WITH {SPECTRUM_CTE}, {MEAN}, b7 AS (SELECT asset_id, {bands_sql(S.SEVEN_BANDS)} FROM ms GROUP BY asset_id) SELECT asset_id, {', '.join(f'{S6(c)} AS {c}' for c in S.SEVEN_BANDS)} FROM b7",
)
def aud10_seven(t):
    return rounded(S.band_energy(spectra(t), STEP, S.SEVEN_BANDS), *S.SEVEN_BANDS)


@query(
    "aud39_design_eq",
    f"""WITH {SPECTRUM_CTE}, {MEAN}, {TEN}, v AS (SELECT asset_id, coalesce(bass, 0) > coalesce(mid, 0) AS dp, coalesce(high, 0) > coalesce(formant, 0) AS hg, speech_to_bass AS s, clarity_to_speech AS k FROM br)
    SELECT asset_id, CASE WHEN dp THEN 100 ELSE 80 END AS low_cut_hz, CASE WHEN dp THEN -6 ELSE -3 END AS low_cut_db, CASE WHEN s < 1 THEN 5 WHEN s < 1.5e0 THEN 3 ELSE 2 END AS speech_db,
      CASE WHEN s < 1 THEN 1.2e0 WHEN s < 1.5e0 THEN 1e0 ELSE 0.8e0 END AS speech_q, CASE WHEN k < 1.2e0 THEN 5000 ELSE 4500 END AS clarity_hz, CASE WHEN k < 0.8e0 THEN 4 WHEN k < 1.2e0 THEN 2 ELSE 1 END AS clarity_db,
      CASE WHEN k < 0.8e0 THEN 0.8e0 WHEN k < 1.2e0 THEN 0.7e0 ELSE 0.6e0 END AS clarity_q, CASE WHEN hg THEN 10000 ELSE 12000 END AS high_cut_hz, CASE WHEN hg THEN -4 ELSE -2 END AS high_cut_db FROM v""",
)
def aud39(t):
    return S.design_eq(S.band_energy(spectra(t), STEP))


HOPS = """hs AS (SELECT asset_id, hop, sum(mag * freq) / sum(mag) AS centroid, sum(mag) AS tot FROM spec GROUP BY asset_id, hop),
hd AS (SELECT s.asset_id, s.hop, centroid, sqrt(sum(mag * (freq - centroid) * (freq - centroid)) / max(tot)) AS bandwidth FROM spec s JOIN hs ON hs.asset_id = s.asset_id AND hs.hop = s.hop GROUP BY s.asset_id, s.hop, centroid),
hc AS (SELECT asset_id, hop, freq, sum(mag) OVER (PARTITION BY asset_id, hop ORDER BY bin ROWS UNBOUNDED PRECEDING) AS cum, sum(mag) OVER (PARTITION BY asset_id, hop) AS tot FROM spec),
hr AS (SELECT asset_id, hop, min(freq) AS rolloff FROM hc WHERE cum >= tot * 0.85e0 GROUP BY asset_id, hop)"""
DESC = [f"{c}_{k}" for c in ("centroid", "bandwidth", "rolloff") for k in ("mean", "std")]


@query(
    "aud11_spectral_descriptors",
    f"""WITH {SPECTRUM_CTE}, {HOPS}, d AS (SELECT asset_id, avg(centroid) AS centroid_mean, stddev_pop(centroid) AS centroid_std, avg(bandwidth) AS bandwidth_mean, stddev_pop(bandwidth) AS bandwidth_std,
      avg(rolloff) AS rolloff_mean, stddev_pop(rolloff) AS rolloff_std FROM hd JOIN hr USING (asset_id, hop) GROUP BY asset_id),
    o AS (SELECT asset_id, mag, row_number() OVER (PARTITION BY asset_id ORDER BY mag) AS rn, floor(count(*) OVER (PARTITION BY asset_id) * 0.1e0) AS k FROM spec),
    f AS (SELECT asset_id, avg(mag) FILTER (WHERE rn <= k) AS nf, avg(mag) AS sg FROM o GROUP BY asset_id)
    SELECT d.asset_id, {', '.join(f'{S6(c)} AS {c}' for c in DESC)}, {S6('nf')} AS noise_floor, {S6('20 * log10(sg / (nf + 1e-10))')} AS snr_db FROM d JOIN f ON f.asset_id = d.asset_id""",
)
def aud11(t):
    return rounded(S.spectral_descriptors(spectra(t), STEP), *DESC, "noise_floor", "snr_db")


MEL_TOP = "(15 + 27 * ln(4e0) / ln(6.4e0))"
MFCC = f"""ed AS (SELECT i, CASE WHEN m < 15 THEN m * 200e0 / 3 ELSE 1000 * exp((m - 15) * ln(6.4e0) / 27) END AS f FROM (SELECT i, i * {MEL_TOP} / 17 AS m FROM (SELECT unnest(range(18)) AS i))),
tr AS (SELECT a.i AS mel, a.f AS lo, b.f AS mid, c.f AS hi FROM ed a JOIN ed b ON b.i = a.i + 1 JOIN ed c ON c.i = a.i + 2),
mw AS (SELECT mel, k AS bin, greatest(0, least((k * 125e0 - lo) / (mid - lo), (hi - k * 125e0) / (hi - mid))) * 2 / (hi - lo) AS w FROM tr, (SELECT unnest(range(33)) AS k)),
ml AS (SELECT asset_id, hop, mel, 10 * log10(greatest(1e-10, sum(w * mag * mag))) AS lv FROM spec JOIN mw USING (bin) GROUP BY asset_id, hop, mel),
cf AS (SELECT asset_id, hop, coef, sum(lv * cos(pi() * coef * (2 * mel + 1) / 32)) * sqrt(2 / 16e0) * CASE WHEN coef = 0 THEN 1 / sqrt(2e0) ELSE 1 END AS v FROM ml, (SELECT unnest(range(13)) AS coef) GROUP BY asset_id, hop, coef)"""


@query("aud12_mfcc", f"WITH {SPECTRUM_CTE}, {MFCC} SELECT asset_id, CAST(coef AS INT) AS coef, {S6('avg(v)')} AS mean, {S6('stddev_pop(v)')} AS std FROM cf GROUP BY asset_id, coef")
def aud12(t):
    return rounded(S.mfcc(spectra(t), STEP), "mean", "std")


DIALOGUE = """dc AS (SELECT asset_id, freq, sum(mag) OVER (PARTITION BY asset_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS c, sum(mag) OVER (PARTITION BY asset_id) AS t FROM ms WHERE freq BETWEEN 300 AND 8000),
dg AS (SELECT asset_id, min(freq) FILTER (WHERE c >= t * 0.1e0) AS low_hz, min(freq) FILTER (WHERE c >= t * 0.9e0) AS high_hz FROM dc GROUP BY asset_id)"""


@query("aud13_dialogue_range", f"WITH {SPECTRUM_CTE}, {MEAN}, {DIALOGUE} SELECT asset_id, low_hz, high_hz FROM dg")
def aud13(t):
    return S.dialogue_range(spectra(t), STEP)


QUIET = """qp AS (SELECT asset_id, quantile_cont(abs(amp), 0.2) AS p20 FROM block GROUP BY asset_id),
qs AS (SELECT b.asset_id, amp, row_number() OVER (PARTITION BY b.asset_id ORDER BY hop, n) - 1 AS m FROM block b JOIN qp ON qp.asset_id = b.asset_id AND abs(amp) < p20),
qc AS (SELECT asset_id, count(*) AS c FROM qs GROUP BY asset_id),
qb AS (SELECT qs.asset_id, m // 64 AS hop, CAST(m % 64 AS INT) AS n, amp FROM qs JOIN qc ON qc.asset_id = qs.asset_id AND m // 64 < c // 64),
qz AS (SELECT asset_id, hop, bin, sqrt(sum(amp * c) * sum(amp * c) + sum(amp * s) * sum(amp * s)) AS mag FROM qb JOIN basis USING (n) GROUP BY asset_id, hop, bin),
np AS (SELECT asset_id, CAST(bin AS INT) AS bin, bin * 125e0 AS freq, avg(mag) AS mag FROM qz GROUP BY asset_id, bin)"""


@query("aud14_noise_profile", f"WITH {SPECTRUM_CTE}, {QUIET} SELECT asset_id, bin, freq, {S6('mag')} AS mag FROM np")
def aud14(t):
    return rounded(S.noise_profile(audio_blocks(t), STEP, 8000), "mag")


@query(
    "aud16_recommend_audio",
    f"""WITH {SPECTRUM_CTE}, {MEAN}, {DIALOGUE}, {QUIET}, nm AS (SELECT asset_id, avg(mag) AS noise FROM np GROUP BY asset_id),
    lv AS (SELECT asset_id, 20 * log10(max(abs(amp)) / sqrt(avg(amp * amp))) + asset_id AS r FROM block GROUP BY asset_id)
    SELECT nm.asset_id, CASE WHEN noise > 0.1e0 THEN 0.8e0 WHEN noise > 0.05e0 THEN 0.5e0 ELSE 0.2e0 END AS noise_reduction,
      CASE WHEN high_hz - low_hz < 2000 THEN 0.6e0 WHEN high_hz - low_hz < 4000 THEN 0.4e0 ELSE 0.2e0 END AS dialogue_enhancement,
      CASE WHEN r > 20 THEN 'large' WHEN r > 15 THEN 'medium' ELSE 'small' END AS venue FROM nm JOIN dg ON dg.asset_id = nm.asset_id JOIN lv ON lv.asset_id = nm.asset_id""",
)
def aud16(t):
    blocks = audio_blocks(t)
    noise = S.noise_profile(blocks, STEP, 8000).groupBy("asset_id").agg(F.avg("mag").alias("noise_mean"))
    level = S.block_levels(blocks).select("asset_id", (F.col("dynamic_range_db") + F.col("asset_id")).alias("dynamic_range_db"))
    return S.recommend_audio(noise.join(S.dialogue_range(S.stft(blocks), STEP), "asset_id").join(level, "asset_id"))


def thd_sql(src: str, out: str) -> str:
    return f"""{out} AS (SELECT asset_id, least(1, sum(CASE WHEN freq BETWEEN 20 AND 20000 AND freq > 2500 THEN mag * mag ELSE 0 END) / (sum(CASE WHEN freq BETWEEN 20 AND 20000 THEN mag * mag ELSE 0 END) + 1e-10)) AS thd,
least(1, sum(CASE WHEN freq BETWEEN 1000 AND 10000 THEN mag * mag ELSE 0 END) / (sum(CASE WHEN freq BETWEEN 100 AND 1000 THEN mag * mag ELSE 0 END) + sum(CASE WHEN freq BETWEEN 1000 AND 10000 THEN mag * mag ELSE 0 END))) AS thd_harmonic
FROM {src} GROUP BY asset_id)"""


@query("aud18_thd_estimate", f"WITH {SPECTRUM_CTE}, {thd_sql('spec', 'th')} SELECT asset_id, {S6('thd')} AS thd, {S6('thd_harmonic')} AS thd_harmonic FROM th")
def aud18(t):
    return rounded(S.thd_estimate(spectra(t), STEP, 2500), "thd", "thd_harmonic")


@query(
    "aud19_dialogue_clarity",
    f"WITH {SPECTRUM_CTE} SELECT asset_id, {S6('least(1, 2 * avg(mag) FILTER (WHERE freq BETWEEN 300 AND 3400) / avg(mag))')} AS clarity FROM spec GROUP BY asset_id",
)
def aud19(t):
    return rounded(S.dialogue_clarity(spectra(t), STEP), "clarity")


CLARITY = """cg AS (SELECT a.asset_id, CASE WHEN a.m > 0 THEN least(b.m / a.m, 2) / 2 ELSE 0.5e0 END AS clarity FROM (SELECT asset_id, avg(mag) AS m FROM spec WHERE freq BETWEEN 2000 AND 4000 GROUP BY asset_id) a
JOIN (SELECT asset_id, avg(mag) AS m FROM spec2 WHERE freq BETWEEN 2000 AND 4000 GROUP BY asset_id) b ON a.asset_id = b.asset_id)"""
NATURAL = """nt AS (SELECT a.asset_id, greatest(0, corr(a.m, b.m)) AS naturalness FROM (SELECT asset_id, bin, avg(mag) AS m FROM spec GROUP BY asset_id, bin) a
JOIN (SELECT asset_id, bin, avg(mag) AS m FROM spec2 GROUP BY asset_id, bin) b ON a.asset_id = b.asset_id AND a.bin = b.bin GROUP BY a.asset_id)"""


@query("aud19_clarity_gain", f"WITH {SPECTRUM_CTE}, {AFTER_CTE}, {CLARITY} SELECT asset_id, {S6('clarity')} AS clarity FROM cg")
def aud19_gain(t):
    return rounded(S.clarity_gain(spectra(t), S.stft(processed_blocks(t)), STEP), "clarity")


@query("aud20_naturalness", f"WITH {SPECTRUM_CTE}, {AFTER_CTE}, {NATURAL} SELECT asset_id, {S6('naturalness')} AS naturalness FROM nt")
def aud20(t):
    return rounded(S.naturalness(spectra(t), S.stft(processed_blocks(t)), STEP), "naturalness")


@query(
    "aud21_distortion_flags",
    f"""WITH {SPECTRUM_CTE}, {thd_sql('spec', 'th')}, {SAMPLE_CTE}, c AS (SELECT asset_id, ch, avg(CASE WHEN abs(amp) > 0.95e0 THEN 1 ELSE 0 END) AS clip_share, max(abs(amp)) AS peak FROM smp GROUP BY asset_id, ch)
    SELECT c.asset_id, ch, {S6('clip_share')} AS clip_share, {S6('peak')} AS peak, {S6('thd / 6')} AS thd, clip_share > 0.001e0 OR thd / 6 > 0.05e0 AS distorted FROM c JOIN th ON th.asset_id = c.asset_id""",
)
def aud21(t):
    thd = S.thd_estimate(spectra(t), STEP, 2500).select("asset_id", (F.col("thd") / 6).alias("thd"))
    return rounded(A.distortion_flags(audio_samples(t), thd), "clip_share", "peak", "thd")


@query(
    "aud21_distortion_pair",
    f"""WITH {SPECTRUM_CTE}, {AFTER_CTE}, {thd_sql('spec', 't1')}, {thd_sql('spec2', 't2')}, {SAMPLE_CTE}, {PROC},
    c AS (SELECT asset_id, ch, avg(CASE WHEN abs(amp) > 0.99e0 THEN 1 ELSE 0 END) AS clip_share, max(abs(amp)) AS peak FROM prc GROUP BY asset_id, ch)
    SELECT c.asset_id, ch, {S6('clip_share')} AS clip_share, {S6('peak')} AS peak, {S6('t2.thd_harmonic - t1.thd_harmonic')} AS thd_rise,
      clip_share > 0.001e0 OR t2.thd_harmonic - t1.thd_harmonic > 0.02e0 OR peak > 0.99e0 AS distorted FROM c JOIN t1 ON t1.asset_id = c.asset_id JOIN t2 ON t2.asset_id = c.asset_id""",
)
def aud21_pair(t):
    a = S.thd_estimate(spectra(t), STEP).select("asset_id", F.col("thd_harmonic").alias("thd_before"))
    b = S.thd_estimate(S.stft(processed_blocks(t)), STEP).select("asset_id", F.col("thd_harmonic").alias("thd_after"))
    pairs = A.pair_samples(audio_samples(t), processed_samples(t))
    return rounded(A.distortion_pair(pairs, a.join(b, "asset_id")), "clip_share", "peak", "thd_rise")


def side_sql(block: str, spec: str, out: str) -> str:
    return f"""{thd_sql(spec, out + 't')}, {out}l AS (SELECT asset_id, sqrt(avg(amp * amp)) AS rms, max(abs(amp)) AS peak, quantile_cont(abs(amp), 0.1) AS nz FROM {block} GROUP BY asset_id),
{out}c AS (SELECT asset_id, avg(c) AS centroid FROM (SELECT asset_id, hop, sum(mag * freq) / sum(mag) AS c FROM {spec} GROUP BY asset_id, hop) GROUP BY asset_id),
{out} AS (SELECT l.asset_id, CASE WHEN nz > 0 THEN 20 * log10(rms / nz) ELSE 60 END AS snr, 20 * log10(peak / rms) AS rng, t.thd_harmonic * 100 AS thd, c.centroid FROM {out}l l JOIN {out}t t ON t.asset_id = l.asset_id JOIN {out}c c ON c.asset_id = l.asset_id)"""


QUALITY_COLS = [
    "snr_before", "snr_after", "range_before", "range_after", "thd_pct_before", "thd_pct_after", "centroid_before", "centroid_after",
    "naturalness", "clarity", "snr_gain_db", "range_change_db", "centroid_shift_hz", "score",
]


@query(
    "aud23_audio_quality",
    f"""WITH {SPECTRUM_CTE}, {AFTER_CTE}, {CLARITY}, {NATURAL}, {side_sql('block', 'spec', 'qa')}, {side_sql('block2', 'spec2', 'qb')},
    j AS (SELECT a.asset_id, a.snr AS snr_before, b.snr AS snr_after, a.rng AS range_before, b.rng AS range_after, a.thd AS thd_pct_before, b.thd AS thd_pct_after, a.centroid AS centroid_before,
      b.centroid AS centroid_after, naturalness, clarity, b.snr - a.snr AS snr_gain_db, b.rng - a.rng AS range_change_db, b.centroid - a.centroid AS centroid_shift_hz
      FROM qa a JOIN qb b ON a.asset_id = b.asset_id JOIN nt ON nt.asset_id = a.asset_id JOIN cg ON cg.asset_id = a.asset_id),
    k AS (SELECT *, least(1, greatest(0, 0.3e0 * least(snr_gain_db / 10, 1) + 0.25e0 * naturalness + 0.25e0 * clarity + 0.2e0 * greatest(0, 1 - abs(range_change_db) / 10))) AS score FROM j)
    SELECT asset_id, {', '.join(f'{S6(c)} AS {c}' for c in QUALITY_COLS)} FROM k""",
)
def aud23(t):
    df = S.audio_quality(audio_blocks(t), processed_blocks(t), STEP)
    return rounded(df.select("asset_id", *QUALITY_COLS), *QUALITY_COLS)


@query(
    "aud27_spectral_gate",
    f"""WITH {SPECTRUM_CTE}, p AS (SELECT asset_id, bin, greatest(quantile_cont(mag, 0.2), 0.1e0) AS t FROM spec GROUP BY asset_id, bin), r AS (SELECT s.asset_id, s.hop, s.bin, mag, mag / (t + 1e-10) AS r FROM spec s JOIN p ON p.asset_id = s.asset_id AND p.bin = s.bin)
    SELECT asset_id, hop, CAST(bin AS INT) AS bin, {S6('mag * greatest(CASE WHEN r > 1 THEN 1 ELSE pow(r, 1.5e0) END, 0.1e0)')} AS mag FROM r""",
)
def aud27(t):
    return rounded(exploded(S.spectral_gate(spectra(t), -20.0), "mag"), "mag")


GAIN = " * ".join(f"(CASE WHEN freq BETWEEN {lo} AND {hi} THEN pow(10e0, {g!r}::DOUBLE / 20) ELSE 1 END)" for lo, hi, g in S.speech_table("large"))


FORMANT_GAIN = " * ".join(f"(CASE WHEN freq BETWEEN {lo} AND {hi} THEN pow(10e0, {g!r}::DOUBLE / 20) ELSE 1 END)" for lo, hi, g in S.formant_table("small"))


@query(
    "aud28_spectral_gain",
    f"""WITH {SPECTRUM_CTE} SELECT asset_id, hop, CAST(bin AS INT) AS bin, {S6(f'mag * {GAIN}')} AS speech, {S6('mag * CASE WHEN freq < 300 THEN exp(-(300 - freq) / 90) WHEN freq > 3400 THEN exp(-(freq - 3400) / 1020) ELSE 1 END')} AS masked,
    {S6('mag * CASE WHEN freq BETWEEN 80 AND 400 THEN 1.2e0 ELSE 1 END')} AS harmonic, {S6(f'mag * {FORMANT_GAIN}')} AS formants FROM spec""",
)
def aud28(t):
    lo, hi, k = S.HARMONIC_BAND
    s = S.spectral_gain(spectra(t), STEP, S.speech_table("large"), "speech")
    s = S.dialogue_mask(s, STEP, to="masked")
    s = S.spectral_gain(s, STEP, [(lo, hi, 20 * math.log10(k))], "harmonic")
    s = S.spectral_gain(s, STEP, S.formant_table("small"), "formants")
    cols = ["speech", "masked", "harmonic", "formants"]
    return rounded(exploded(s, *cols), *cols)


@query(
    "aud29_spectral_sharpen",
    f"""WITH {SPECTRUM_CTE}, o AS (SELECT d, exp(-d * d / 8e0) AS k FROM (SELECT unnest(range(-8, 9)) AS d)), w AS (SELECT d, k / (SELECT sum(k) FROM o) AS k FROM o),
    t AS (SELECT b.k AS bin, CASE WHEN b.k + d < 0 THEN -1 - (b.k + d) WHEN b.k + d > 32 THEN 65 - (b.k + d) ELSE b.k + d END AS src, w.k AS wt FROM (SELECT unnest(range(33)) AS k) b, w),
    m AS (SELECT s.asset_id, s.hop, t.bin, sum(wt * mag) AS soft FROM spec s JOIN t ON t.src = s.bin GROUP BY s.asset_id, s.hop, t.bin)
    SELECT s.asset_id, s.hop, CAST(s.bin AS INT) AS bin, {S6('soft * pow(mag / (soft + 1e-10), 1.3e0)')} AS mag FROM spec s JOIN m ON m.asset_id = s.asset_id AND m.hop = s.hop AND m.bin = s.bin""",
)
def aud29(t):
    return rounded(exploded(S.spectral_sharpen(spectra(t), "large"), "mag"), "mag")


ONSET = """fx AS (SELECT a.asset_id, a.hop, coalesce(sum(greatest(a.mag - b.mag, 0)), 0) AS flux FROM spec a LEFT JOIN spec b ON b.asset_id = a.asset_id AND b.bin = a.bin AND b.hop = a.hop - 1 GROUP BY a.asset_id, a.hop),
ow AS (SELECT *, lag(flux) OVER (PARTITION BY asset_id ORDER BY hop) AS l, lead(flux) OVER (PARTITION BY asset_id ORDER BY hop) AS r, avg(flux) OVER (PARTITION BY asset_id) AS m FROM fx),
os AS (SELECT asset_id, hop, flux > coalesce(l, -1) AND flux >= coalesce(r, -1) AND flux > m AS onset, flux FROM ow)"""


@query("aud30_onsets", f"WITH {SPECTRUM_CTE}, {ONSET} SELECT asset_id, hop, {S6('flux')} AS flux, onset FROM os")
def aud30_onsets(t):
    return rounded(S.onsets(spectra(t)), "flux")


@query(
    "aud30_transient_boost",
    f"""WITH {SPECTRUM_CTE}, {ONSET}, g AS (SELECT b.asset_id, b.hop, b.n, b.amp, count(o.hop) AS k FROM block b LEFT JOIN os o ON o.asset_id = b.asset_id AND o.onset
      AND b.hop * 64 + b.n - o.hop * 64 BETWEEN -80 AND 79 GROUP BY b.asset_id, b.hop, b.n, b.amp) SELECT asset_id, hop, n, {S6('amp * pow(1.15e0, k)')} AS amp FROM g""",
)
def aud30(t):
    df = S.transient_boost(audio_blocks(t), 64, 8000)
    return rounded(df.select("asset_id", "hop", F.posexplode("samples").alias("n", "amp")), "amp")


# Frames of 16 samples at every 4th, cut from sample tables --------------------------------------------

FRAME, HOP, FRAME_STEP = 16, 4, 1000.0
TURN = f"2 * pi() * b.k * s.n / {FRAME}e0"
FRAME_BASIS = f"""fb AS (SELECT b.k AS bin, s.n AS i, 0.5e0 - 0.5e0 * cos(2 * pi() * s.n / {FRAME}e0) AS w, cos({TURN}) AS c, -sin({TURN}) AS s
    FROM (SELECT unnest(range({FRAME // 2 + 1})) AS k) b, (SELECT unnest(range({FRAME})) AS n) s)"""


def frames_sql(src: str, keys: str) -> str:
    """Spectra ``{src}_z`` of the complete frames of a sample table."""
    return f"""{src}_c AS (SELECT {keys}, count(*) AS c FROM {src} GROUP BY {keys}),
    {src}_f AS (SELECT {keys}, n // {HOP} - k AS hop, n % {HOP} + {HOP} * k AS i, amp FROM {src} JOIN {src}_c USING ({keys}), (SELECT unnest(range({FRAME // HOP})) AS k)
      WHERE n // {HOP} - k >= 0 AND (n // {HOP} - k) * {HOP} + {FRAME} <= c),
    {src}_z AS (SELECT {keys}, hop, bin, sum(amp * w * c) AS re, sum(amp * w * s) AS im FROM {src}_f JOIN fb USING (i) GROUP BY {keys}, hop, bin)"""


def channel_spectra(samples, keys):
    return S.stft(S.frame_samples(samples, keys, FRAME, HOP))


@query(
    "aud6_phase_difference",
    f"""WITH {SAMPLE_CTE}, {FRAME_BASIS}, {frames_sql('smp', 'asset_id, ch')},
    p AS (SELECT asset_id, ch, hop, bin, CASE WHEN bin IN (0, {FRAME // 2}) THEN CASE WHEN re < 0 THEN pi() ELSE 0e0 END ELSE atan2(im, re) END AS p FROM smp_z)
    SELECT a.asset_id, {S6('avg(abs(a.p - b.p))')} AS phase_difference FROM p a JOIN p b ON a.asset_id = b.asset_id AND a.hop = b.hop AND a.bin = b.bin AND a.ch = 0 AND b.ch = 1 GROUP BY a.asset_id""",
)
def aud6_phase(t):
    return rounded(S.phase_difference(channel_spectra(audio_samples(t), ["asset_id", "ch"])), "phase_difference")


def centroid_sql(src: str) -> str:
    return f"""{src}_h AS (SELECT asset_id, ch, hop, sum(sqrt(re * re + im * im) * bin * {FRAME_STEP}e0) / nullif(sum(sqrt(re * re + im * im)), 0) AS centroid FROM {src}_z GROUP BY asset_id, ch, hop),
    {src}_m AS (SELECT asset_id, ch, avg(centroid) AS centroid FROM {src}_h GROUP BY asset_id, ch)"""


@query(
    "aud42_compare_centroid",
    f"""WITH {SAMPLE_CTE}, {PROC}, {FRAME_BASIS}, {frames_sql('smp', 'asset_id, ch')}, {frames_sql('prc', 'asset_id, ch')}, {centroid_sql('smp')}, {centroid_sql('prc')},
    {stats_sql('smp', 'sa')}, {stats_sql('prc', 'sb')}, d AS (SELECT a.asset_id, a.ch, b.snr_db - a.snr_db AS s, b.crest_db - a.crest_db AS c, 20 * log10(b.rms / (a.rms + 1e-10)) AS r, y.centroid - x.centroid AS z
      FROM sa a JOIN sb b ON a.asset_id = b.asset_id AND a.ch = b.ch JOIN smp_m x ON x.asset_id = a.asset_id AND x.ch = a.ch JOIN prc_m y ON y.asset_id = a.asset_id AND y.ch = a.ch)
    SELECT asset_id, ch, {S6('s')} AS snr_delta_db, {S6('c')} AS range_delta_db, {S6('r')} AS rms_delta_db, CASE WHEN s > 1 THEN 'better' WHEN s > 0 THEN 'slightly_better' ELSE 'same' END AS snr_status,
      CASE WHEN c > 1 THEN 'better' WHEN c > 0 THEN 'slightly_better' ELSE 'same' END AS range_status,
      CASE WHEN s > 3 AND c > 2 THEN 'major' WHEN s > 1 OR c > 1 THEN 'medium' WHEN s > 0 OR c > 0 THEN 'minor' ELSE 'none' END AS overall,
      {S6('z')} AS centroid_delta, CASE WHEN z < -100 THEN 'effective' WHEN z < 0 THEN 'slight' ELSE 'none' END AS noise_status FROM d""",
)
def aud42_centroid(t):
    keys = ["asset_id", "ch"]
    sides = [A.signal_stats(df).join(S.mean_centroid(channel_spectra(df, keys), keys, FRAME_STEP), keys) for df in (audio_samples(t), processed_samples(t))]
    return rounded(A.compare_audio(*sides), "snr_delta_db", "range_delta_db", "rms_delta_db", "centroid_delta")


@query(
    "aud31_width_curve",
    f"""WITH {SAMPLE_CTE}, {STEREO}, {FRAME_BASIS}, side AS (SELECT asset_id, n, (l - r) / 2 AS amp FROM st), {frames_sql('side', 'asset_id')},
    y AS (SELECT asset_id, hop * {HOP} + i AS n, max(w) AS w, sum(CASE WHEN bin IN (0, {FRAME // 2}) THEN 1 ELSE 2 END * CASE WHEN bin >= 4 THEN 1.15e0 WHEN bin >= 1 THEN 1.3e0 ELSE 1e0 END * (re * c + im * s)) / {FRAME} AS v
      FROM side_z JOIN fb USING (bin) GROUP BY asset_id, hop, i),
    o AS (SELECT asset_id, n, coalesce(sum(v * w) / nullif(sum(w * w), 0), 0) AS v FROM y GROUP BY asset_id, n)
    SELECT st.asset_id, st.n, {S6('(l + r) / 2 + coalesce(o.v, (l - r) / 2)')} AS l, {S6('(l + r) / 2 - coalesce(o.v, (l - r) / 2)')} AS r FROM st LEFT JOIN o ON o.asset_id = st.asset_id AND o.n = st.n""",
)
def aud31_curve(t):
    return rounded(S.width_curve(A.stereo(audio_samples(t)), FRAME_STEP, FRAME, HOP, "large"), "l", "r")
