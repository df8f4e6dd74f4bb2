"""Queries: audio in the time domain (AUD1-6, 15, 17, 22, 24-26, 31-34, 36-38, 40-45)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import SAMPLE_CTE, audio_samples
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.scalars import r6
from footlamp.operators import audio as A

RATE = 16
K = "asset_id, ch"
LV = "lv AS (SELECT asset_id, ch, count(*) AS n_samples, sqrt(avg(amp * amp)) AS rms, max(abs(amp)) AS peak FROM smp GROUP BY asset_id, ch)"
OUT = "0.6e0 * tanh(amp * 1.5e0)"
STEREO = "st AS (SELECT a.asset_id, a.n, a.amp AS l, b.amp AS r FROM smp a JOIN smp b ON a.asset_id = b.asset_id AND a.n = b.n AND a.ch = 0 AND b.ch = 1)"
STATS_NUMS = ["rms", "peak", "crest_db", "zcr", "noise_floor", "snr_db", "p10", "p25", "p50", "p75", "p90", "p95", "p99"]


def stats_sql(src: str, out: str) -> str:
    pct = ", ".join(f"quantile_cont(abs(amp), {p}) AS {n}" for n, p in A.PERCENTILES.items())
    return f"""{out}_p AS (SELECT {K}, count(*) AS n_samples, sqrt(avg(amp * amp)) AS rms, max(abs(amp)) AS peak, quantile_cont(abs(amp), 0.2) AS p20, {pct} FROM {src} GROUP BY {K}),
{out}_z AS (SELECT {K}, avg(CASE WHEN (amp < 0) <> (pv < 0) THEN 1 ELSE 0 END) AS zcr FROM (SELECT *, lag(amp) OVER (PARTITION BY {K} ORDER BY n) AS pv FROM {src}) GROUP BY {K}),
{out}_q AS (SELECT s.asset_id, s.ch, avg(abs(amp)) AS q FROM {src} s JOIN {out}_p p ON p.asset_id = s.asset_id AND p.ch = s.ch AND abs(s.amp) < p.p20 GROUP BY s.asset_id, s.ch),
{out}_f AS (SELECT p.*, zcr, coalesce(q, p20) AS noise_floor FROM {out}_p p JOIN {out}_z z ON z.asset_id = p.asset_id AND z.ch = p.ch LEFT JOIN {out}_q q ON q.asset_id = p.asset_id AND q.ch = p.ch),
{out} AS (SELECT *, 20 * log10(peak / (rms + 1e-10)) AS crest_db, 10 * log10(rms * rms / (noise_floor * noise_floor + 1e-10)) AS snr_db FROM {out}_f)"""


def processed(t):
    return audio_samples(t).withColumn("amp", F.expr(OUT))


PROC = f"prc AS (SELECT {K}, n, {OUT} AS amp FROM smp)"
FRAMES = f"fr AS (SELECT s.asset_id, s.ch, h.hop, sqrt(sum(amp * amp) / 8) AS rms FROM smp s JOIN (SELECT unnest(range(64)) AS hop) h ON s.n BETWEEN h.hop * 4 AND h.hop * 4 + 7 GROUP BY s.asset_id, s.ch, h.hop HAVING count(*) = 8)"


def rounded(df, *cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def frames8(t):
    return A.frame_rms(audio_samples(t), 8, 4)


@query("aud1_signal_stats", f"WITH {SAMPLE_CTE}, {stats_sql('smp', 'ss')} SELECT {K}, n_samples, {', '.join(f'{S6(c)} AS {c}' for c in STATS_NUMS)} FROM ss")
def aud1(t):
    return rounded(A.signal_stats(audio_samples(t)), *STATS_NUMS)


@query("aud2_frame_rms", f"WITH {SAMPLE_CTE}, {FRAMES} SELECT {K}, hop, {S6('rms')} AS rms FROM fr")
def aud2(t):
    return rounded(frames8(t), "rms")


@query(
    "aud3_reverb_time",
    f"""WITH {SAMPLE_CTE}, {FRAMES}, pk AS (SELECT {K}, hop AS ph, rms AS top FROM fr QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY rms DESC, hop) = 1),
    d AS (SELECT fr.asset_id, fr.ch, min(hop - ph) AS d FROM fr JOIN pk ON pk.asset_id = fr.asset_id AND pk.ch = fr.ch WHERE hop >= ph AND rms < top / 1.5e0 GROUP BY fr.asset_id, fr.ch),
    r AS (SELECT pk.asset_id, pk.ch, coalesce(least(d * 4 / 16e0, 5), 1.5e0) AS rt FROM pk LEFT JOIN d ON d.asset_id = pk.asset_id AND d.ch = pk.ch)
    SELECT {K}, {S6('rt')} AS reverb_s, CASE WHEN rt < 1 THEN 'small' WHEN rt < 2.5e0 THEN 'medium' ELSE 'large' END AS venue FROM r""",
)
def aud3(t):
    return rounded(A.reverb_time(frames8(t), 4, RATE, 1.5), "reverb_s")


@query(
    "aud4_noise_floor",
    f"""WITH {SAMPLE_CTE}, {FRAMES}, p AS (SELECT {K}, quantile_cont(rms, 0.1) AS p10 FROM fr GROUP BY {K})
    SELECT fr.asset_id, fr.ch, {S6('greatest(-80, 20 * log10(avg(rms) + 1e-10))')} AS noise_floor_db FROM fr JOIN p ON p.asset_id = fr.asset_id AND p.ch = fr.ch AND rms <= p10 GROUP BY fr.asset_id, fr.ch""",
)
def aud4(t):
    return rounded(A.noise_floor(frames8(t)), "noise_floor_db")


@query(
    "aud5_dynamic_range",
    f"WITH {SAMPLE_CTE}, {FRAMES} SELECT {K}, {S6('least(60, 20 * log10((quantile_cont(rms, 0.95) + 1e-10) / (quantile_cont(rms, 0.05) + 1e-10)))')} AS dynamic_range_db FROM fr GROUP BY {K}",
)
def aud5(t):
    return rounded(A.dynamic_range(frames8(t)), "dynamic_range_db")


@query(
    "aud6_stereo_features",
    f"""WITH {SAMPLE_CTE}, {STEREO}, m AS (SELECT asset_id, corr(l, r) AS c, avg((l + r) / 2 * (l + r) / 2) AS m, avg((l - r) / 2 * (l - r) / 2) AS s, avg(l * l) AS el, avg(r * r) AS er FROM st GROUP BY asset_id),
    k AS (SELECT asset_id, count(DISTINCT ch) AS channels FROM smp GROUP BY asset_id)
    SELECT k.asset_id, channels, {S6('coalesce(1 - abs(c), 0)')} AS width, {S6('coalesce(m / (m + s + 1e-10), 1)')} AS centre_focus, {S6('(er - el) / (er + el + 1e-10)')} AS balance
    FROM k LEFT JOIN m ON m.asset_id = k.asset_id""",
)
def aud6(t):
    return rounded(A.stereo_features(audio_samples(t)), "width", "centre_focus", "balance")


@query(
    "aud15_peak_levels",
    f"WITH {SAMPLE_CTE} SELECT {K}, n // 16 AS second, {S6('max(abs(amp))')} AS peak FROM smp GROUP BY {K}, n // 16 HAVING count(*) = 16",
)
def aud15(t):
    return rounded(A.peak_levels(audio_samples(t), RATE), "peak")


SNR = """20 * log10({r} / ({n} + 1e-10))"""


@query(
    "aud17_snr_gain",
    f"""WITH {SAMPLE_CTE}, {PROC}, a AS (SELECT {K}, sqrt(avg(amp * amp)) AS ra, quantile_cont(abs(amp), 0.1) AS na FROM smp GROUP BY {K}),
    b AS (SELECT {K}, sqrt(avg(amp * amp)) AS rb, quantile_cont(abs(amp), 0.1) AS nb FROM prc GROUP BY {K})
    SELECT a.asset_id, a.ch, {S6(SNR.format(r='ra', n='na'))} AS snr_before_db, {S6(SNR.format(r='rb', n='nb'))} AS snr_after_db,
      {S6(SNR.format(r='rb', n='nb') + ' - ' + SNR.format(r='ra', n='na'))} AS gain_db,
      {S6('(CASE WHEN nb > 0 THEN 20 * log10(rb / nb) ELSE 60 END) - (CASE WHEN na > 0 THEN 20 * log10(ra / na) ELSE 60 END)')} AS gain_quiet60_db
    FROM a JOIN b ON a.asset_id = b.asset_id AND a.ch = b.ch""",
)
def aud17(t):
    df = A.snr_gain(A.pair_samples(audio_samples(t), processed(t)))
    return rounded(df, "snr_before_db", "snr_after_db", "gain_db", "gain_quiet60_db")


@query(
    "aud22_loudness_range",
    f"""WITH {SAMPLE_CTE}, {LV}, {FRAMES}, f AS (SELECT fr.asset_id, fr.ch, 20 * log10(fr.rms) AS level FROM fr JOIN lv ON lv.asset_id = fr.asset_id AND lv.ch = fr.ch WHERE hop * 4 < n_samples - 8 AND fr.rms > 0),
    p AS (SELECT {K}, quantile_cont(level, 0.95) - quantile_cont(level, 0.1) AS lra FROM f GROUP BY {K})
    SELECT lv.asset_id, lv.ch, {S6('coalesce(lra, 0)')} AS loudness_range_db, {S6('CASE WHEN rms > 0 THEN 20 * log10(peak / rms) ELSE 0 END')} AS peak_to_average_db
    FROM lv LEFT JOIN p ON p.asset_id = lv.asset_id AND p.ch = lv.ch""",
)
def aud22(t):
    return rounded(A.loudness_range(audio_samples(t), 8, 4), "loudness_range_db", "peak_to_average_db")


def normalise_sql(target: float) -> str:
    goal = math.sqrt(10 ** ((target + 0.691) / 10))
    shape = "CASE WHEN gain > 1 THEN 0.95e0 * tanh({0} * gain / 0.95e0) ELSE {0} * gain END"
    return f"""WITH {SAMPLE_CTE}, {LV}, g AS (SELECT *, CASE WHEN rms > 0 THEN {goal!r}::DOUBLE / rms ELSE 1 END AS gain FROM lv),
    p AS (SELECT s.asset_id, s.ch, n, rms, CASE WHEN rms > 0 THEN {shape.format('amp')} ELSE amp END AS v FROM smp s JOIN g ON g.asset_id = s.asset_id AND g.ch = s.ch),
    m AS (SELECT *, max(abs(v)) OVER (PARTITION BY {K}) AS top FROM p)
    SELECT {K}, n, {S6('CASE WHEN rms > 0 AND top > 0.99e0 THEN v * 0.95e0 / top ELSE v END')} AS amp FROM m"""


@query("aud24_loudness_normalise", normalise_sql(-23.0))
def aud24(t):
    return rounded(A.loudness_normalise(audio_samples(t)), "amp")


@query("aud24_loudness_normalise_loud", normalise_sql(3.0))
def aud24_loud(t):
    return rounded(A.loudness_normalise(audio_samples(t), 3.0), "amp")


@query(
    "aud25_compress_static",
    f"""WITH {SAMPLE_CTE}, c AS (SELECT {K}, n, CASE WHEN abs(amp) > 0.3e0 THEN sign(amp) * (0.3e0 + (abs(amp) - 0.3e0) / 3) ELSE amp END AS v FROM smp)
    SELECT {K}, n, {S6('v')} AS amp, {S6('tanh(v / 0.95e0) * 0.95e0')} AS limited FROM c""",
)
def aud25(t):
    df = A.compress_static(audio_samples(t), 0.3, 3.0)
    return df.select("asset_id", "ch", "n", r6(F.col("amp")).alias("amp"), r6(F.tanh(F.col("amp") / 0.95) * 0.95).alias("limited"))


@query(
    "aud25_compress_smoothed",
    f"""WITH {SAMPLE_CTE}, e AS (SELECT *, sum(abs(amp)) OVER (PARTITION BY {K} ORDER BY n ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS e FROM smp)
    SELECT {K}, n, {S6('amp * CASE WHEN e > 0.2e0 THEN (0.2e0 + (e - 0.2e0) / 2) / e ELSE 1 END')} AS amp FROM e""",
)
def aud25_smoothed(t):
    return rounded(A.compress_smoothed(audio_samples(t), 0.2, 2.0, 8), "amp")


UP, DOWN = math.exp(-1 / (0.005 * 400)), math.exp(-1 / (0.15 * 400))
ENVELOPE = f"""src AS MATERIALIZED (SELECT {K}, n, amp, abs(amp) AS a FROM smp), env AS (SELECT {K}, n, amp, a AS e FROM src WHERE n = 0
  UNION ALL SELECT s.asset_id, s.ch, s.n, s.amp, CASE WHEN s.a > e.e THEN {UP!r}::DOUBLE * e.e + (1 - {UP!r}::DOUBLE) * s.a ELSE {DOWN!r}::DOUBLE * e.e + (1 - {DOWN!r}::DOUBLE) * s.a END
  FROM env e JOIN src s ON s.asset_id = e.asset_id AND s.ch = e.ch AND s.n = e.n + 1)"""


@query("aud26_envelope", f"WITH RECURSIVE {SAMPLE_CTE}, {ENVELOPE} SELECT {K}, n, {S6('e')} AS env FROM env")
def aud26_envelope(t):
    return rounded(A.envelope(audio_samples(t), 0.005, 0.15, 400).select("asset_id", "ch", "n", "env"), "env")


@query(
    "aud26_compress_envelope",
    f"""WITH RECURSIVE {SAMPLE_CTE}, {ENVELOPE}, c AS (SELECT *, amp * ((CASE WHEN e > 0.7e0 THEN 0.7e0 + (e - 0.7e0) / 3 ELSE e END) / (e + 1e-10)) AS o FROM env),
    l AS (SELECT {K}, max(abs(amp)) / (sqrt(avg(amp * amp)) + 1e-10) AS c0, max(abs(o)) / (sqrt(avg(o * o)) + 1e-10) AS c1 FROM c GROUP BY {K})
    SELECT c.asset_id, c.ch, n, {S6('o * CASE WHEN c1 > 0 THEN least(1.2e0, greatest(0.8e0, c0 / c1)) ELSE 1 END')} AS amp FROM c JOIN l ON l.asset_id = c.asset_id AND l.ch = c.ch""",
)
def aud26(t):
    return rounded(A.compress_envelope(audio_samples(t), "medium", 400), "amp")


@query(
    "aud31_mid_side_width",
    f"""WITH {SAMPLE_CTE}, {STEREO}, w AS (SELECT asset_id, n, (l + r) / 2 + (l - r) / 2 * 1.3e0 AS l, (l + r) / 2 - (l - r) / 2 * 1.3e0 AS r FROM st),
    m AS (SELECT *, max(greatest(abs(l), abs(r))) OVER (PARTITION BY asset_id) AS p FROM w)
    SELECT asset_id, n, {S6('CASE WHEN p > 0.95e0 THEN l * 0.95e0 / p ELSE l END')} AS l, {S6('CASE WHEN p > 0.95e0 THEN r * 0.95e0 / p ELSE r END')} AS r FROM m""",
)
def aud31(t):
    return rounded(A.mid_side_width(A.stereo(audio_samples(t)), "large"), "l", "r")


def taps_sql(taps, rate, depth, mix) -> str:
    echo = " + ".join(f"coalesce(lag(amp, {int(s * rate)}) OVER w, 0) * {g * depth!r}::DOUBLE" for s, g in taps)
    return f"WITH {SAMPLE_CTE}, e AS (SELECT {K}, n, amp, {echo} AS e FROM smp WINDOW w AS (PARTITION BY {K} ORDER BY n)) SELECT {K}, n, {S6(f'amp + {mix}e0 * e')} AS amp FROM e"


@query("aud32_echo_taps", taps_sql(A.ECHO_TAPS, 60, 0.75, 0.15))
def aud32(t):
    return rounded(A.echo_taps(audio_samples(t), 60, 0.75), "amp")


@query("aud32_stage_taps", taps_sql(A.STAGE_TAPS, 60, 1.0, 1.0))
def aud32_stage(t):
    return rounded(A.echo_taps(audio_samples(t), 60, 1.0, 1.0, A.STAGE_TAPS), "amp")


@query(
    "aud33_spatial_adjust",
    f"""WITH {SAMPLE_CTE}, {STEREO}, c AS (SELECT asset_id, n, l + 0.02e0 * coalesce(lag(r, 2) OVER w, 0) AS l, r + 0.02e0 * coalesce(lag(l, 2) OVER w, 0) AS r FROM st WINDOW w AS (PARTITION BY asset_id ORDER BY n)),
    f AS (SELECT asset_id, n, (l + r) / 2 * 0.1e0 + l - (l + r) / 2 AS l, (l + r) / 2 * 0.1e0 + r - (l + r) / 2 AS r FROM c), k AS (SELECT asset_id, corr(l, r) AS c FROM f GROUP BY asset_id)
    SELECT f.asset_id, n, {S6('l')} AS l, {S6('CASE WHEN c < -0.5e0 THEN -r ELSE r END')} AS r FROM f JOIN k ON k.asset_id = f.asset_id""",
)
def aud33(t):
    return rounded(A.spatial_adjust(A.stereo(audio_samples(t)), 2000, "large", 0.1), "l", "r")


@query(
    "aud34_shift_audio",
    f"""WITH {SAMPLE_CTE} SELECT {K}, n + 8 AS n, {S6('amp')} AS amp FROM smp UNION ALL SELECT asset_id, ch, unnest(range(8)) AS n, 0e0 FROM (SELECT DISTINCT {K} FROM smp)""",
)
def aud34(t):
    return rounded(A.shift_audio(audio_samples(t), 500.0, RATE), "amp")


@query(
    "aud34_shift_audio_back",
    f"""WITH {SAMPLE_CTE}, {LV} SELECT s.asset_id, s.ch, CASE WHEN n_samples <= 32 THEN n ELSE n - 32 END AS n, {S6('amp')} AS amp FROM smp s JOIN lv ON lv.asset_id = s.asset_id AND lv.ch = s.ch
    WHERE n_samples <= 32 OR n >= 32""",
)
def aud34_back(t):
    return rounded(A.shift_audio(audio_samples(t), -2000.0, RATE), "amp")


@query(
    "aud36_sync_offset",
    f"""WITH {SAMPLE_CTE}, {STEREO}, c AS (SELECT a.asset_id, g.lag, corr(a.l, b.r) AS c, count(*) AS m FROM st a JOIN (SELECT unnest(range(-5, 6)) AS lag) g ON true
      JOIN st b ON b.asset_id = a.asset_id AND b.n = a.n + g.lag GROUP BY a.asset_id, g.lag),
    r AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY round(c, 9) DESC, abs(lag), lag DESC) AS rn FROM c WHERE m > 2 AND isfinite(c))
    SELECT asset_id, CAST(lag AS INT) AS lag, {S6('c')} AS correlation, {S6('lag * 1000e0 / 16')} AS offset_ms FROM r WHERE rn = 1""",
)
def aud36(t):
    return rounded(A.sync_offset(A.stereo(audio_samples(t)), 5, RATE), "correlation", "offset_ms")


@query(
    "aud37_split_sources",
    f"""WITH {SAMPLE_CTE}, {STEREO} SELECT asset_id, n, {S6('l - r')} AS vocals, {S6('(l + r) / 2')} AS accompaniment FROM st
    UNION ALL SELECT asset_id, n, {S6('amp')}, {S6('amp * 0.3e0')} FROM smp WHERE asset_id IN (SELECT asset_id FROM smp GROUP BY asset_id HAVING count(DISTINCT ch) = 1)""",
)
def aud37(t):
    return rounded(A.split_sources(audio_samples(t)), "vocals", "accompaniment")


@query(
    "aud38_remix",
    f"""WITH {SAMPLE_CTE}, d AS (SELECT a.asset_id, a.n, a.amp + coalesce(b.amp, 0) * {10 ** (-6 / 20)!r}::DOUBLE AS v FROM smp a LEFT JOIN smp b ON b.asset_id = a.asset_id AND b.n = a.n AND b.ch = 1 WHERE a.ch = 0),
    m AS (SELECT *, max(abs(v)) OVER (PARTITION BY asset_id) AS p FROM d) SELECT asset_id, n, {S6(f'CASE WHEN p > 0 THEN v * {10 ** (-1 / 20)!r}::DOUBLE / p ELSE v END')} AS amp FROM m""",
)
def aud38(t):
    s = audio_samples(t)
    return rounded(A.remix(s.where("ch = 0").drop("ch"), s.where("ch = 1").drop("ch")), "amp")


@query(
    "aud40_choose_noise_level",
    f"""WITH {SAMPLE_CTE}, {stats_sql('smp', 'ss')}, l AS (SELECT *, CASE WHEN snr_db < 10 THEN 'heavy' WHEN snr_db < 20 THEN 'medium' ELSE 'light' END AS level FROM ss)
    SELECT {K}, level, CASE level WHEN 'light' THEN 0.5e0 WHEN 'medium' THEN 1e0 ELSE 1.5e0 END AS strength, CASE level WHEN 'light' THEN -45 WHEN 'medium' THEN -40 ELSE -35 END AS floor_db,
      {S6('greatest(-60, 20 * log10(noise_floor * 3))')} AS gate_db FROM l""",
)
def aud40(t):
    return rounded(A.choose_noise_level(A.signal_stats(audio_samples(t))), "gate_db")


GAIN_DB = f"{SNR.format(r='rb', n='nb')} - {SNR.format(r='ra', n='na')}"


@query(
    "aud40_noise_result",
    f"""WITH {SAMPLE_CTE}, {PROC}, a AS (SELECT {K}, sqrt(avg(amp * amp)) AS ra, quantile_cont(abs(amp), 0.1) AS na FROM smp GROUP BY {K}),
    b AS (SELECT {K}, sqrt(avg(amp * amp)) AS rb, quantile_cont(abs(amp), 0.1) AS nb FROM prc GROUP BY {K}), g AS (SELECT a.asset_id, a.ch, {GAIN_DB} AS g FROM a JOIN b ON a.asset_id = b.asset_id AND a.ch = b.ch)
    SELECT {K}, {S6('g')} AS gain_db, CASE WHEN g > 2 THEN 'strong' WHEN g > 0.5e0 THEN 'moderate' WHEN g > -0.5e0 THEN 'kept' ELSE 'overdone' END AS result FROM g""",
)
def aud40_result(t):
    df = A.noise_result(A.snr_gain(A.pair_samples(audio_samples(t), processed(t))))
    return rounded(df.select("asset_id", "ch", "gain_db", "result"), "gain_db")


@query(
    "aud41_choose_dynamics",
    f"""WITH {SAMPLE_CTE}, {LV}, c AS (SELECT {K}, 20 * log10(peak / (rms + 1e-10)) + 8 > 18 AS hard FROM lv)
    SELECT {K}, CASE WHEN hard THEN -18 ELSE -20 END AS threshold_db, CASE WHEN hard THEN 4e0 ELSE 2.5e0 END AS ratio, CASE WHEN hard THEN 3 ELSE 5 END AS attack_ms, CASE WHEN hard THEN 100 ELSE 150 END AS release_ms FROM c""",
)
def aud41(t):
    return A.choose_dynamics(A.signal_stats(audio_samples(t)).withColumn("crest_db", F.col("crest_db") + 8))


@query(
    "aud42_compare_audio",
    f"""WITH {SAMPLE_CTE}, {PROC}, {stats_sql('smp', 'sa')}, {stats_sql('prc', 'sb')}, d AS (SELECT a.asset_id, a.ch, b.snr_db - a.snr_db AS s, b.crest_db - a.crest_db AS c, 20 * log10(b.rms / (a.rms + 1e-10)) AS r
      FROM sa a JOIN sb b ON a.asset_id = b.asset_id AND a.ch = b.ch)
    SELECT {K}, {S6('s')} AS snr_delta_db, {S6('c')} AS range_delta_db, {S6('r')} AS rms_delta_db, CASE WHEN s > 1 THEN 'better' WHEN s > 0 THEN 'slightly_better' ELSE 'same' END AS snr_status,
      CASE WHEN c > 1 THEN 'better' WHEN c > 0 THEN 'slightly_better' ELSE 'same' END AS range_status,
      CASE WHEN s > 3 AND c > 2 THEN 'major' WHEN s > 1 OR c > 1 THEN 'medium' WHEN s > 0 OR c > 0 THEN 'minor' ELSE 'none' END AS overall FROM d""",
)
def aud42(t):
    df = A.compare_audio(A.signal_stats(audio_samples(t)), A.signal_stats(processed(t)))
    return rounded(df, "snr_delta_db", "range_delta_db", "rms_delta_db")


@query(
    "aud41_dynamics_effect",
    f"""WITH {SAMPLE_CTE}, {PROC}, {stats_sql('smp', 'sa')}, {stats_sql('prc', 'sb')}, d AS (SELECT a.asset_id, a.ch, a.crest_db - b.crest_db AS c, 20 * log10(b.rms / (a.rms + 1e-10)) AS r
      FROM sa a JOIN sb b ON a.asset_id = b.asset_id AND a.ch = b.ch)
    SELECT {K}, {S6('c')} AS range_reduction_db, {S6('r')} AS loudness_gain_db, CASE WHEN c > 2 THEN 'marked' WHEN c > 1 THEN 'moderate' ELSE 'kept' END AS label FROM d""",
)
def aud41_effect(t):
    df = A.dynamics_effect(A.signal_stats(audio_samples(t)), A.signal_stats(processed(t)))
    return rounded(df, "range_reduction_db", "loudness_gain_db")


@query(
    "aud43_volume_consistency",
    f"""WITH {SAMPLE_CTE}, {LV}, r AS (SELECT {K}, 20 * log10(peak / rms) AS r FROM lv)
    SELECT {K}, {S6('r')} AS range_db, {S6('CASE WHEN r BETWEEN 6 AND 20 THEN 1 WHEN r < 6 THEN greatest(0, r / 6) ELSE greatest(0, 1 - (r - 20) / 20) END')} AS score FROM r""",
)
def aud43(t):
    return rounded(A.volume_consistency(audio_samples(t)), "range_db", "score")


@query(
    "aud44_smooth_and_normalise",
    f"""WITH {SAMPLE_CTE}, s AS (SELECT {K}, n, 0.9e0 * amp + 0.1e0 * (coalesce(lag(amp) OVER w, amp) + amp + coalesce(lead(amp) OVER w, amp)) / 3 AS v FROM smp WINDOW w AS (PARTITION BY {K} ORDER BY n)),
    m AS (SELECT *, max(abs(v)) OVER (PARTITION BY {K}) AS p FROM s) SELECT {K}, n, {S6('CASE WHEN p > 0.5e0 THEN v * 0.5e0 / p ELSE v END')} AS amp FROM m""",
)
def aud44(t):
    return rounded(A.smooth_and_normalise(audio_samples(t), 0.5), "amp")


@query(
    "aud45_autocorr_decay",
    f"""WITH {SAMPLE_CTE}, {STEREO}, y AS (SELECT * FROM smp WHERE ch = 0), s AS (SELECT a.asset_id, g.lag, coalesce(sum(a.amp * b.amp), 0) AS s FROM y a JOIN (SELECT unnest(range(9)) AS lag) g ON true
      LEFT JOIN y b ON b.asset_id = a.asset_id AND b.n = a.n + g.lag GROUP BY a.asset_id, g.lag),
    t AS (SELECT asset_id, max(s) AS top FROM s GROUP BY asset_id), d AS (SELECT s.asset_id, min(lag) AS lag FROM s JOIN t ON t.asset_id = s.asset_id AND s.s < 0.1e0 * top GROUP BY s.asset_id),
    w AS (SELECT asset_id, sqrt(avg((l - r) / 2 * (l - r) / 2)) / (sqrt(avg((l + r) / 2 * (l + r) / 2)) + 1e-10) AS w, 20 * log10((sqrt(avg(l * l)) + 1e-10) / (sqrt(avg(r * r)) + 1e-10)) AS b FROM st GROUP BY asset_id)
    SELECT t.asset_id, {S6('coalesce(lag / 16e0, 0.5e0)')} AS decay_s, {S6('w')} AS width, CASE WHEN w > 0.3e0 THEN 'good' ELSE 'needs_enhancement' END AS quality, {S6('b')} AS balance_db
    FROM t LEFT JOIN d ON d.asset_id = t.asset_id LEFT JOIN w ON w.asset_id = t.asset_id""",
)
def aud45(t):
    return rounded(A.autocorr_decay(audio_samples(t), 8, RATE), "decay_s", "width", "balance_db")
