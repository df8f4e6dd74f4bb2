"""Silence, mono, square wave, impulse, and chunked audio against plain numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footlamp.operators import audio as A
from footlamp.operators import spectrum as S


def signal(spark, channels):
    rows = [(1, ch, i, float(v)) for ch, values in enumerate(channels) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset_id INT, ch INT, n BIGINT, amp DOUBLE")


def column(df, name="amp"):
    return [r[0] for r in df.orderBy("ch", "n").select(name).collect()]


def test_silence(spark):
    s = signal(spark, [[0.0] * 32])
    assert column(A.loudness_normalise(s)) == [0.0] * 32
    assert A.noise_floor(A.frame_rms(s, 8, 4)).first()["noise_floor_db"] == -80.0
    assert A.loudness_range(s, 8, 4).first()["loudness_range_db"] == 0.0
    assert A.volume_consistency(s).first()["score"] == 0.5


def test_mono(spark):
    s = signal(spark, [[0.1, -0.2, 0.3, 0.4]])
    row = A.stereo_features(s).first()
    assert (row["width"], row["centre_focus"]) == (0.0, 1.0)
    out = A.split_sources(s).orderBy("n").collect()
    assert [r["vocals"] for r in out] == [0.1, -0.2, 0.3, 0.4]
    assert out[3]["accompaniment"] == pytest.approx(0.12)


def test_square_wave(spark):
    s = signal(spark, [[1.0, -1.0] * 16])
    row = A.signal_stats(s).first()
    assert row["rms"] == pytest.approx(1.0) and row["crest_db"] == pytest.approx(0.0, abs=1e-8)
    assert row["zcr"] == pytest.approx(31 / 32)
    assert A.clip_share(s).first()["clip_share"] == 1.0


def test_impulse_echo(spark):
    s = signal(spark, [[1.0] + [0.0] * 15])
    got = column(A.echo_taps(s, rate=100, depth=1.0, mix=0.5))
    want = [1.0] + [0.0] * 15
    for seconds, gain in A.ECHO_TAPS:
        want[int(seconds * 100)] += 0.5 * gain
    assert np.allclose(got, want)


def test_frame_rms_counts_complete_frames(spark):
    rows = A.frame_rms(signal(spark, [np.ones(21)]), 8, 4).collect()
    assert sorted(r["hop"] for r in rows) == [0, 1, 2, 3] and all(r["rms"] == pytest.approx(1.0) for r in rows)


def test_envelope_chunks_equal_one_run(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.4, 3000)
    attack, release, rate = 0.005, 0.05, 400
    up, down = math.exp(-1 / (attack * rate)), math.exp(-1 / (release * rate))
    want, e = [], None
    for v in np.abs(x):
        e = v if e is None else (up * e + (1 - up) * v if v > e else down * e + (1 - down) * v)
        want.append(e)
    got = column(A.envelope(signal(spark, [x]), attack, release, rate, size=64), "env")
    assert len(got) == 3000 and np.allclose(got, want, atol=1e-11)


def test_lag_sums(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"asset_id": 1, "n": np.arange(500), "l": rng.normal(size=500)})
    pdf["r"] = np.roll(pdf["l"], 7)
    df = spark.createDataFrame(pdf)
    got = A.lag_sums(df, ["asset_id"], "l", "r", 100, -100, 64).toPandas().set_index("lag")
    left, right = pdf["l"].to_numpy(), pdf["r"].to_numpy()
    for lag in (-100, -65, -1, 0, 3, 64, 100):
        u, v = (left[: 500 - lag], right[lag:]) if lag >= 0 else (left[-lag:], right[:lag])
        assert got.loc[lag, "m"] == len(u) and np.allclose(got.loc[lag, "sab"], (u * v).sum()) and np.allclose(got.loc[lag, "saa"], (u * u).sum())
    assert A.sync_offset(df, 10, 1000).first()["lag"] == 7
    assert A.sync_offset(df, 100, 1000).first()["lag"] == 7


def test_shift_longer_than_clip_is_ignored(spark):
    s = signal(spark, [[1.0, 2.0, 3.0]])
    assert column(A.shift_audio(s, -1000.0, 10)) == [1.0, 2.0, 3.0]
    assert column(A.shift_audio(s, -100.0, 10)) == [2.0, 3.0]
    assert column(A.shift_audio(s, 100.0, 10)) == [0.0, 1.0, 2.0, 3.0]
    assert column(A.shift_audio(s, 0.5, 10)) == [1.0, 2.0, 3.0]


def test_frames_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 3)
    x = np.random.default_rng(1).normal(size=101)
    framed = S.frame_samples(signal(spark, [x]), ["asset_id", "ch"], 16, 4)
    rows = {r["hop"]: r["samples"] for r in framed.collect()}
    assert sorted(rows) == list(range((101 - 16) // 4 + 1))
    assert all(np.allclose(v, x[h * 4 : h * 4 + 16]) for h, v in rows.items())
    back = S.istft(S.stft(framed), ["asset_id", "ch"], 16, 4).orderBy("n").collect()
    assert np.allclose([r["amp"] for r in back][1:], x[1 : len(back)])


def test_pure_tone_spectrum(spark):
    n = np.arange(64)
    tone = np.cos(2 * np.pi * 8 * n / 64)
    blocks = spark.createDataFrame([(1, 0, tone.tolist())], "asset_id INT, hop BIGINT, samples ARRAY<DOUBLE>")
    mag = S.stft(blocks).first()["mag"]
    assert int(np.argmax(mag)) == 8 and mag[8] == pytest.approx(16.0)
    row = S.hop_descriptors(S.stft(blocks), 125.0).first()
    assert row["centroid"] == pytest.approx(1000.0)


def test_gain_edges_multiply_twice(spark):
    one = spark.createDataFrame([(1, 0, [1.0] * 5, [0.0] * 5)], "asset_id INT, hop BIGINT, mag ARRAY<DOUBLE>, phase ARRAY<DOUBLE>")
    out = S.spectral_gain(one, 100.0, [(100, 200, 20.0), (200, 300, 20.0)]).first()["mag"]
    assert np.allclose(out, [1, 10, 100, 10, 1])


def test_equally_loud_asset_uses_quiet_blocks(spark):
    rows = [(1, h, [0.5 if (i + h) % 2 else -0.5 for i in range(64)]) for h in range(12)]
    blocks = spark.createDataFrame(rows, "asset_id INT, hop BIGINT, samples ARRAY<DOUBLE>")
    assert S.noise_profile(blocks, 125.0, 8000).where("asset_id = 1").count() in (0, 33)


def test_empty(spark):
    s = spark.createDataFrame([], "asset_id INT, ch INT, n BIGINT, amp DOUBLE")
    assert A.signal_stats(s).count() == 0 and A.envelope(s, 0.01, 0.1, 100).count() == 0
    b = spark.createDataFrame([], "asset_id INT, hop BIGINT, samples ARRAY<DOUBLE>")
    assert S.stft(b).count() == 0 and S.mfcc(S.stft(b), 125.0).count() == 0


def test_compare_includes_centroid(spark):
    s = A.signal_stats(signal(spark, [np.linspace(-1, 1, 50)])).withColumn("centroid", F.lit(500.0))
    t = s.withColumn("centroid", F.lit(350.0))
    assert A.compare_audio(s, t).first()["noise_status"] == "effective"


def test_phase_difference(spark):
    n = np.arange(64)
    rows = [(1, ch, 0, np.cos(2 * np.pi * 8 * n / 64).tolist()) for ch in (0, 1)]
    blocks = spark.createDataFrame(rows, "asset_id INT, ch INT, hop BIGINT, samples ARRAY<DOUBLE>")
    assert S.phase_difference(S.stft(blocks)).first()["phase_difference"] == 0.0
    shifted = spark.createDataFrame([(1, 0, 0, [1.0, 1.0], [0.5, -0.5]), (1, 1, 0, [1.0, 1.0], [0.0, 0.5])],
                                    "asset_id INT, ch INT, hop BIGINT, mag ARRAY<DOUBLE>, phase ARRAY<DOUBLE>")
    assert S.phase_difference(shifted).first()["phase_difference"] == pytest.approx(0.75)


def test_width_curve_scales_bands_of_the_side_signal(spark):
    for hz, factor in ((500.0, 1.0), (2000.0, 1.2), (5000.0, 1.1)):
        tone = [math.sin(2 * math.pi * hz * n / 16000) for n in range(164)]
        pairs = spark.createDataFrame([(1, n, v, -v) for n, v in enumerate(tone)], "asset_id int, n bigint, l double, r double")
        got = {r.n: (r.l, r.r) for r in S.width_curve(pairs, 16000 / 32, 32, 8, "medium").collect()}
        assert len(got) == 164 and all(abs(got[n][0] + got[n][1]) < 1e-9 for n in got)
        ratio = sum(got[n][0] * tone[n] for n in range(40, 120)) / sum(tone[n] ** 2 for n in range(40, 120))
        assert abs(ratio - factor) < 0.06
        assert all(abs(got[n][0] - tone[n]) < 1e-9 for n in range(160, 164))


def test_mean_centroid_leaves_out_silence(spark):
    rows = spark.createDataFrame([(1, 0, [0.0, 1.0, 1.0]), (1, 1, [0.0, 0.0, 0.0]), (2, 0, [0.0, 0.0])], "asset_id int, hop int, mag array<double>")
    got = {r.asset_id: r.centroid for r in S.mean_centroid(rows, ["asset_id"], 100.0).collect()}
    assert got == {1: 150.0, 2: None}
