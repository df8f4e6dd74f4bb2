"""Hand-made frames with values worked out on paper."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from footlamp.functions import kernels as K
from footlamp.operators import filters as X
from footlamp.operators import frames as O

SCHEMA = "asset_id INT, frame_no BIGINT, w INT, h INT, luma ARRAY<INT>"


def make(spark, images, asset=1):
    return spark.createDataFrame([(asset, i, m.shape[1], m.shape[0], m.ravel().tolist()) for i, m in enumerate(images)], SCHEMA)


@pytest.mark.parametrize("value,hi,lo", [(0, 0.0, 1.0), (128, 0.0, 0.0), (255, 1.0, 0.0)])
def test_constant_frame(spark, value, hi, lo):
    f = make(spark, [np.full((4, 4), value)])
    light = O.lighting_ratios(f).first()
    assert (light["highlight"], light["dark"]) == (hi, lo)
    assert O.noise_score(f).first()["noise_score"] == 0.0
    assert O.edge_density(f).first()["edge_density"] == 0.0


def test_one_frame_is_static(spark):
    f = O.sample_frames(make(spark, [np.full((4, 4), 9)]), 5)
    row = O.frame_change(f).first()
    assert row["frame_change"] == 0.0 and row["is_static"]
    assert O.flicker(make(spark, [np.full((4, 4), 9)])).first()["temporal_consistency"] == 0.0
    assert O.brightness_stability(f).first()["score"] == 0.0


def test_empty_table(spark):
    f = spark.createDataFrame([], SCHEMA)
    assert O.structure_features(f).count() == 0
    assert X.motion_mask(f).count() == 0
    assert X.mask_regions(X.safe_mask(f, "weak")).count() == 0
    assert X.temporal_in_place(f).count() == 0


def test_step_edge():
    img = np.zeros((6, 6), dtype=int)
    img[:, 3:] = 255
    # the gradient is 1020 on both sides of the step; the left of two equal maxima wins
    assert np.array_equal(np.argwhere(K.edges(img))[:, 1], np.full(6, 2))


def test_weak_edges_need_a_strong_neighbour():
    weak = np.array([[1, 1, 1, 0, 1]], dtype=bool)
    seed = np.array([[1, 0, 0, 0, 0]], dtype=bool)
    assert np.array_equal(K.grow(seed, weak), [[1, 1, 1, 0, 0]])


def test_touching_regions(spark):
    mask = np.zeros((6, 6), dtype=bool)
    mask[0:2, 0:2] = True
    mask[2:4, 2:4] = True  # touches the first at a corner
    mask[5, 0] = True
    f = make(spark, [mask.astype(int)]).withColumn("mask", F.transform("luma", lambda v: v > 0))
    rows = sorted((r["region"], r["box_w"], r["box_h"], r["area"]) for r in X.mask_regions(f, 1).collect())
    assert rows == [(0, 4, 4, 8), (30, 1, 1, 1)]
    assert [r["region"] for r in X.mask_regions(f, 2).collect()] == [0]


def test_labels_follow_long_paths():
    mask = np.zeros((9, 9), dtype=bool)
    mask[::2] = True
    mask[1, 8] = mask[3, 0] = mask[5, 8] = mask[7, 0] = True  # one snake
    assert set(np.unique(K.label_regions(mask))) == {-1, 0}


def test_in_place_chunks_equal_one_run(spark):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (3, 5)) for _ in range(90)]
    want = [images[0]]
    for i in range(1, 89):
        want.append(K.truncated(0.15 * want[-1] + 0.70 * images[i] + 0.15 * images[i + 1]))
    want.append(images[-1])
    got = X.temporal_in_place(make(spark, images), chunk=16, block=4).orderBy("frame_no").collect()
    assert len(got) == 90
    assert all(np.array_equal(np.array(r["luma"]).reshape(3, 5), w) for r, w in zip(got, want))


def test_in_place_on_a_still_scene(spark):
    """Runs from below never reach a static pixel's value, so the chain over chunks has to settle them."""
    images = [np.full((2, 3), 100)] * 40 + [np.arange(6).reshape(2, 3) * 40] + [np.full((2, 3), 7)] * 49
    want = [images[0]]
    for i in range(1, 89):
        want.append(K.truncated(0.15 * want[-1] + 0.70 * images[i] + 0.15 * images[i + 1]))
    want.append(images[-1])
    got = X.temporal_in_place(make(spark, images), chunk=8, block=4).orderBy("frame_no").collect()
    assert all(np.array_equal(np.array(r["luma"]).reshape(2, 3), w) for r, w in zip(got, want))


def test_fir_leaves_the_ends(spark):
    images = [np.full((2, 2), v) for v in (0, 100, 200)]
    got = [r["luma"][0] for r in X.temporal_fir(make(spark, images)).orderBy("frame_no").collect()]
    assert got == [0, 100, 200]


def test_long_recording_windows_cross_chunks(spark):
    images = [np.full((2, 2), (i * 7) % 256) for i in range(2100)]
    f = make(spark, images)
    row = O.flicker(f).first()
    diffs = np.abs(np.diff([(i * 7) % 256 for i in range(2100)]))
    assert row["n_pairs"] == 2099
    assert row["temporal_consistency"] == pytest.approx(1 - diffs.std() / 255)


def test_sampling_variants(spark):
    f = make(spark, [np.zeros((2, 2), dtype=int)] * 23)
    assert [r[0] for r in O.sample_frames(f, 5).select("frame_no").orderBy("frame_no").collect()] == [0, 4, 8, 12, 16]
    assert O.sample_frames(f, 30).count() == 23
    assert [r[0] for r in O.sample_linspace(f, 4).select("frame_no").orderBy("frame_no").collect()] == [0, 7, 14, 22]
    assert O.sample_every(f, 10, 2).count() == 2


def test_identical_frames_psnr_and_ssim(spark):
    f = make(spark, [np.arange(64).reshape(8, 8)])
    pairs = O.pair_frames(f, f)
    row = O.psnr(pairs).first()
    assert row["psnr_mean"] is None and row["psnr_capped"] == 100.0
    assert O.ssim(pairs).first()["ssim_mean"] == pytest.approx(1.0)


def test_resample_keeps_a_flat_frame(spark):
    for method in ("cubic", "lanczos4"):
        out = X.resample(make(spark, [np.full((4, 5), 77)]), 2, method).first()
        assert (out["w"], out["h"], len(out["luma"])) == (10, 8, 80)
        assert np.allclose(out["luma"], 77)


def test_tiles_cover_the_frame(spark):
    sizes = spark.createDataFrame([(1, 0, 100, 37)], "asset_id INT, frame_no BIGINT, w INT, h INT")
    for tiles in (X.make_tiles(sizes, 32, 8), X.make_tiles_pinned(sizes, 32, 8)):
        px = X.tile_pixels(tiles)
        assert px.select("y", "x").distinct().count() == 3700
        assert px.where("x >= 100 OR y >= 37 OR x < 0 OR y < 0").count() == 0


def test_assembled_constant_tiles_stay_constant(spark):
    sizes = spark.createDataFrame([(1, 0, 30, 20)], "asset_id INT, frame_no BIGINT, w INT, h INT")
    px = X.tile_pixels(X.make_tiles(sizes, 12, 4)).withColumn("weight", X.tile_weight()).withColumn("v", F.lit(5.0))
    out = X.assemble_tiles(px)
    assert out.count() == 600 and out.where("abs(v - 5) > 1e-9").count() == 0


def test_batches_of_frames_are_bounded(spark):
    """A query lowers the rows that Python gets at once, since memory goes with them; a smaller setting stays."""
    from footlamp.catalog import REGISTRY
    from footlamp.session import BATCH, BATCH_ROWS

    before = spark.conf.get(BATCH)
    try:
        for given, kept in ((10_000, BATCH_ROWS), (0, BATCH_ROWS), (50, 50)):
            spark.conf.set(BATCH, str(given))
            REGISTRY["frm36_resample_cubic_x4"].run(spark, "/root/testdata/sf0.001")
            assert int(spark.conf.get(BATCH)) == kept
            largest = spark.range(3000).repartition(1).select(F.pandas_udf(lambda s: s * 0 + len(s), "bigint")("id").alias("n")).agg(F.max("n")).first()[0]
            assert largest == kept
    finally:
        spark.conf.set(BATCH, before)
