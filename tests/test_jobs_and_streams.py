"""Sources, sinks, job edge cases, and streams over several micro-batches."""

import os
import pickle
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from footlamp.functions.user import StagedRun, map_frames
from footlamp.operators import jobs as J
from footlamp.operators import planning as P
from footlamp.operators import telemetry as T
from footlamp.operators import validation as V
from footlamp.plans import storage
from footlamp.sources import logs, media, sinks
from footlamp.streaming import live as L

EVENT = "job_id INT, stage STRING, substage INT, ts BIGINT, weight DOUBLE, substage_weight DOUBLE, status STRING, progress DOUBLE"


def test_progress_without_stages_or_weight(spark):
    assert J.progress(spark.createDataFrame([], EVENT)).count() == 0
    zero = spark.createDataFrame([(1, "a", 0, 0, 0.0, 1.0, "in_progress", 0.5)], EVENT)
    assert J.progress(zero).first()["progress"] == 0.0


def test_progress_uses_the_newest_row(spark):
    rows = [(1, "a", 0, 1, 1.0, 1.0, "in_progress", 0.2), (1, "a", 0, 2, 1.0, 1.0, "in_progress", 0.6), (1, "b", 0, 1, 3.0, 1.0, "skipped", 0.0)]
    assert J.progress(spark.createDataFrame(rows, EVENT)).first()["progress"] == pytest.approx((0.6 + 3.0) / 4)


def test_eta_is_zero_without_progress(spark):
    rows = [(1, 0, 10, False, 5.0), (2, 0, 10, True, 5.0), (3, 0, 10, True, 5.0), (3, 1, 10, False, 9.0)]
    df = spark.createDataFrame(rows, "job_id INT, segment_idx INT, frames INT, processed BOOLEAN, seconds DOUBLE")
    got = {r["job_id"]: r["eta_s"] for r in J.eta_speed(df).collect()}
    assert got == {1: 0.0, 2: 0.0, 3: 5.0}


def test_gaps_without_generated_rows(spark):
    rows = [(1, i) for i in (1, 2, 4, 4, 7)] + [(2, 1), (2, 2)] + [(3, 2), (3, 10**12)]
    got = {r["job"]: r for r in V.frame_gaps(spark.createDataFrame(rows, "job int, idx bigint"), "job", "idx").collect()}
    assert [(got[j]["n_missing"], got[j]["first_missing"], got[j]["contiguous"]) for j in (1, 2)] == [(3, 3, False), (0, None, True)]
    assert got[1]["n_found"] == 5 and got[3]["n_missing"] == 10**12 - 2 and got[3]["first_missing"] == 1


def test_wide_and_tall_tiles(spark):
    df = spark.createDataFrame([(1, 3000, 1000, "high"), (2, 500, 1000, "high")], "asset_id INT, width INT, height INT, quality STRING")
    got = {r["asset_id"]: (r["tile_w"], r["tile_h"]) for r in P.plan_tiles(df, F.lit(8000)).collect()}
    assert got == {1: (1024, 816), 2: (816, 1024)}


def test_plan_target_for_other_ratios(spark):
    cols = "asset_id INT, width INT, height INT, quality STRING, mem_mb INT, duration_s DOUBLE, fps DOUBLE"
    df = spark.createDataFrame([(1, 640, 480, "fast", 4000, 10.0, 25.0), (2, 500, 500, "fast", 4000, 10.0, 25.0)], cols)
    got = {r["asset_id"]: r["target_w"] for r in P.plan_adaptive(df).collect()}
    assert got == {1: 2880, 2: 2160}


def test_scan_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp4", "b.txt", "sub/c.mkv"):
        (tmp_path / name).write_bytes(b"x" * 5)
    files = media.scan_files(spark, str(tmp_path))
    assert files.count() == 3 and files.first()["size_bytes"] == 5
    found = media.discover_assets(files, F.lit("small"), F.lit("fast"))
    assert sorted(r["output_name"] for r in found.collect()) == ["a_enhanced_small_fast_4k.mp4", "c_enhanced_small_fast_4k.mkv"]
    assert "content" not in files.columns


def test_probe_files(spark, tmp_path):
    doc = '{"format": {"duration": "9.5"}, "streams": [{"codec_type": "video", "width": 4, "height": 2, "r_frame_rate": "50/0"}]}'
    (tmp_path / "p.json").write_text(doc)
    row = media.probe_assets(media.read_probes(spark, str(tmp_path))).first()
    assert (row["fps"], row["duration_s"], row["bitrate"], row["has_audio"], row["error"]) == (25.0, 9.5, 0, False, None)


def test_log_lines(spark, tmp_path):
    (tmp_path / "x.log").write_text('{"level": "INFO", "custom_job": "7", "line": 3}\nnot json\n')
    rows = logs.read_logs(spark, str(tmp_path)).collect()
    good = next(r for r in rows if r["level"] == "INFO")
    assert good["custom"] == {"job": "7"} and good["line"] == 3
    assert any(r["_corrupt_record"] == "not json" for r in rows)


def test_report_appends(spark, tmp_path):
    path = str(tmp_path / "report")
    df = spark.range(3)
    sinks.write_report(df, path, "2024-01-01")
    sinks.write_report(df, path, "2024-01-02")
    assert spark.read.parquet(path).where("run_date = '2024-01-02'").count() == 3


def test_staged_run_resumes(spark, tmp_path):
    calls = []

    def counted(name, fn):
        def step(df):
            calls.append(name)
            return fn(df)

        return step

    run = StagedRun(spark, str(tmp_path / "run"))
    run.add_stage("one", counted("one", lambda d: d.where("id > 2"))).add_stage("two", counted("two", lambda d: d.limit(100)))
    assert run.run(spark.range(10)).count() == 7
    assert run.run(resume_after="one").count() == 7
    assert calls == ["one", "two", "two"]


def test_failed_frames_come_back_null(spark):
    df = spark.createDataFrame([(1, 0, 2, 1, [1, 2]), (1, 1, 2, 1, [0, 0])], "asset_id INT, frame_no BIGINT, w INT, h INT, luma ARRAY<INT>")

    def fn(img):
        if not img.any():
            raise KeyError("dark")
        return img * 2

    got = {r["frame_no"]: (r["luma"], r["error"]) for r in map_frames(df, fn).collect()}
    assert got == {0: ([2.0, 4.0], None), 1: (None, "KeyError")}


def test_result_only_leaves_the_result(spark):
    """Tables on the way are deleted, also after an error; the result and tables made elsewhere stay."""
    made, before = [], storage.cut_lineage(spark.range(3))

    def build():
        made.append(storage.cut_lineage(before.where("id > 0")))
        made.append(storage.result_only(spark, lambda: storage.cut_lineage(made[0]).where("id > 1")))
        return made[-1]

    found = storage.result_only(spark, build)
    assert [r.id for r in found.collect()] == [2] and before.count() == 3
    for gone in made:
        assert not os.path.exists(gone.inputFiles()[0].removeprefix("file:").removeprefix("//"))
    with pytest.raises(ZeroDivisionError):
        storage.result_only(spark, lambda: 1 / 0)
    assert storage._MADE.get() is None


# Streams ------------------------------------------------------------------------------------------


def write_batches(spark, folder, df, parts):
    """One file per micro-batch, in order of modification time."""
    import os
    import time

    for i, cond in enumerate(parts):
        df.where(cond).coalesce(1).write.mode("append").parquet(str(folder))
        newest = max(folder.glob("*.parquet"), key=os.path.getmtime)
        os.utime(newest, (1_000_000 + i, 1_000_000 + i))
        time.sleep(0.01)


@pytest.fixture(scope="module")
def telemetry(spark):
    return spark.range(200).selectExpr(
        "id AS event_id", "id % 3 AS host", "timestamp_micros(id * 60000000) AS ts", "CAST(id * 37 % 101 AS DOUBLE) AS cpu_pct",
        "CAST(id * 17 % 97 AS DOUBLE) AS mem_pct", "CASE WHEN id % 3 = 0 THEN CAST(id % 50 AS DOUBLE) END AS gpu_pct", "CAST(id % 150 AS DOUBLE) AS disk_mb_s",
    )


def test_a_stream_reads_tables_that_are_folders(spark, tmp_path):
    """A table may be one file or a folder of part files; other tables beside it stay out."""
    spark.range(7).repartition(3).write.parquet(str(tmp_path / "parts.parquet"))
    spark.range(90, 95).write.parquet(str(tmp_path / "other.parquet"))
    spark.range(7).coalesce(1).write.parquet(str(tmp_path / "staged"))
    next((tmp_path / "staged").glob("*.parquet")).rename(tmp_path / "single.parquet")
    for name in ("parts", "single"):
        stream = L.read_stream(spark, str(tmp_path), f"{name}.parquet", spark.range(1).schema)
        assert sorted(r.id for r in L.drain(stream, name).collect()) == list(range(7))


def test_bottlenecks_over_batches(spark, telemetry, tmp_path):
    """Files out of order within the watermark give the result of the batch form for all rows that it has passed."""
    telemetry = telemetry.where("event_id > 0")  # time 0 counts as passed before the first batch
    write_batches(spark, tmp_path, telemetry, ["event_id < 7 OR event_id BETWEEN 9 AND 12", "event_id IN (7, 8) OR event_id BETWEEN 13 AND 90", "event_id > 90"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", telemetry.schema, max_files=1)
    got = L.drain(L.stream_bottlenecks(stream), "b").select("event_id", "status", "bottlenecks")
    want = T.bottleneck_last_n(telemetry.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("event_id", "status", "bottlenecks")
    want = want.where("event_id <= 189")  # the last event less ten minutes
    assert got.count() == 189
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_busy_host_over_batches(spark, tmp_path):
    """A host with most of the rows, dealt over files without order: held rows span triggers and leave bucket by bucket."""
    df = spark.range(1, 3001).selectExpr(
        "id AS event_id", "IF(id % 5 = 0, id % 3 + 1, 0) AS host", "timestamp_micros(id * 1500000) AS ts", "CAST(id * 37 % 101 AS DOUBLE) AS cpu_pct",
        "CAST(id * 17 % 97 AS DOUBLE) AS mem_pct", "CAST(NULL AS DOUBLE) AS gpu_pct", "CAST(id % 150 AS DOUBLE) AS disk_mb_s",
    )
    near = "(event_id + pmod(xxhash64(event_id), 300))"
    write_batches(spark, tmp_path, df, [f"{near} <= 1000", f"{near} BETWEEN 1001 AND 1600", f"{near} BETWEEN 1601 AND 2400", f"{near} > 2400"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    got = L.drain(L.stream_bottlenecks(stream), "busy").select("event_id", "host", "status", "bottlenecks")
    want = T.bottleneck_last_n(df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("event_id", "host", "status", "bottlenecks")
    want = want.where("event_id <= 2600")  # the last event less ten minutes
    assert got.count() == 2600
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert spark.conf.get(L.STATE_STORE, "") != L.ROCKSDB


def test_many_hosts_in_one_trigger(spark, tmp_path):
    """Events of many hosts come in one trigger; a state value, a timer and a Python call for each made this take minutes."""
    df = spark.range(1, 20001).selectExpr("id AS event_id", "nullif(id % 2000, 7) AS host", "id * 130000000 AS us", "IF(pmod(xxhash64(id), 3) = 0, 'signup', 'purchase') AS kind")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    df.write.parquet(str(tmp_path / "e.parquet"))
    start = time.monotonic()
    got = L.drain(L.stream_session_pairs(L.read_stream(spark, str(tmp_path), "e.parquet", df.schema)), "many").collect()
    assert time.monotonic() - start < 40
    want, last = [], {}
    for r in df.orderBy("us").collect():
        if r["host"] is None or r["us"] > 20000 * 130_000_000 - 600_000_000:
            continue
        if r["kind"] == "signup":
            last[r["host"]] = r
        elif o := last.pop(r["host"], None):
            want.append((r["host"], o["event_id"], r["event_id"], o["us"], r["us"]))
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_state_is_carried_over_batch_borders():
    """Keys that span Arrow batches and null keys keep one state each; own rows bring it from before and give it to the next."""
    out = pa.schema([("k", pa.int64()), ("n", pa.int64()), (L.OWN, pa.binary())])

    def step(key, own, rows):
        total = (own or 0) + np.cumsum(rows["v"])
        return int(total[-1]), {"n": total.astype(np.int64)}

    rows = [(None, 1, None), (None, 2, None), (5, None, pickle.dumps(100)), (5, 2**53 + 1, None), (5, 4, None), (6, None, pickle.dumps(9)), (2**53 + 1, 8, None)]
    schema = pa.schema([("k", pa.int64()), ("v", pa.int64()), (L.OWN, pa.binary())])
    for size in (1, 2, 3, 7):
        parts = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema).to_batches(max_chunksize=size)
        got = [r for b in L.fold_runs(step, ["k"], out)(iter(parts)) for r in b.to_pylist()]
        assert [(r["k"], r["n"]) for r in got if r[L.OWN] is None] == [(None, 1), (None, 3), (5, 2**53 + 101), (5, 2**53 + 105), (2**53 + 1, 8)]
        assert {r["k"]: pickle.loads(r[L.OWN]) for r in got if r[L.OWN] is not None} == {None: 3, 5: 2**53 + 105, 6: 9, 2**53 + 1: 8}


@pytest.mark.parametrize("window,slide", [("10 minutes", "1 minute"), ("7 minutes", "3 minutes")])
def test_windows_over_batches(spark, telemetry, tmp_path, window, slide):
    """Windows over triggers equal those of a batch; rows are shuffled once and their windows are not."""
    write_batches(spark, tmp_path, telemetry, ["event_id < 7 OR event_id BETWEEN 9 AND 12", "event_id IN (7, 8) OR event_id BETWEEN 13 AND 90", "event_id > 90"])
    made = L.stream_utilisation(L.read_stream(spark, str(tmp_path), "*.parquet", telemetry.schema, max_files=1), window, slide)
    got = L.drain(made, "w").select("host", "start", "end", "n", "cpu_min", "cpu_max", F.round("cpu_avg", 6), "cpu_now", F.round("mem_avg", 6))
    w = telemetry.groupBy("host", F.window("ts", window, slide).alias("w")).agg(
        F.count(F.lit(1)), F.min("cpu_pct"), F.max("cpu_pct"), F.round(F.avg("cpu_pct"), 6), F.max_by("cpu_pct", "ts"), F.round(F.avg("mem_pct"), 6)
    )
    want = w.where(F.unix_micros("w.end") <= 189 * 60_000_000).select("host", "w.start", "w.end", *[F.col(f"`{c}`") for c in w.columns[2:]])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    work = made.work(telemetry.select("host", F.unix_micros("ts").alias("us"), "cpu_pct", "mem_pct"), None, -L.ALWAYS, 189 * 60_000_000)
    work.collect()
    assert work._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count(" Exchange ") == 1


def test_pairs_take_the_first_close(spark, tmp_path):
    kinds = ["signup", "purchase", "purchase", "signup", "signup", "purchase", "view", "purchase"]
    rows = [(1, i, (i + 1) * 60_000_000, k) for i, k in enumerate(kinds)] + [(1, 99, 10**10, "signup")]
    df = spark.createDataFrame(rows, "host BIGINT, event_id BIGINT, us BIGINT, kind STRING").withColumn("ts", F.timestamp_micros("us"))
    write_batches(spark, tmp_path, df, ["event_id IN (0, 2, 5)", "event_id IN (1, 3, 4, 6, 7)", "event_id = 99"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    got = L.drain(L.stream_session_pairs(stream), "sp").collect()
    assert sorted((r["open_id"], r["close_id"]) for r in got) == [(0, 1), (4, 5)]


def test_late_rows_are_dropped_and_counted(spark, telemetry, tmp_path):
    late = telemetry.where("event_id = 1").withColumn("cpu_pct", F.lit(1000.0))
    write_batches(spark, tmp_path, telemetry.unionByName(late), ["event_id BETWEEN 50 AND 100", "event_id > 100", "event_id = 1 AND cpu_pct = 1000"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", telemetry.schema, max_files=1).withColumn("kind", F.lit("x"))
    query = (
        L.stream_resource_tumbling(stream, "10 minutes")
        .writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.table("late").where("cpu_avg > 100").count() == 0
    assert L.late_rows(query) == 1


def test_ema_over_batches(spark, tmp_path):
    values = np.random.default_rng(2).integers(0, 255, 40).astype(float)
    df = spark.createDataFrame([(1, i, [float(v), 2 * float(v)]) for i, v in enumerate(values)], "asset_id INT, frame_key BIGINT, luma ARRAY<DOUBLE>")
    write_batches(spark, tmp_path, df, ["frame_key < 11", "frame_key >= 11"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    rows = L.drain(L.stream_ema(stream, block=1), "e").where("block = 0").orderBy("frame_key").collect()
    want, last = [], None
    for v in values:
        last = v if last is None else 0.9 * v + 0.1 * last
        want.append(last)
    assert np.allclose([r["luma"][0] for r in rows], want)


def test_cadence_over_batches(spark, tmp_path):
    df = spark.createDataFrame([(1, i, (i + 1) * 100_000_000) for i in range(26)], "host BIGINT, event_id BIGINT, us BIGINT")
    df = df.withColumn("ts", F.timestamp_micros("us"))
    write_batches(spark, tmp_path, df, ["event_id < 4 OR event_id = 6", "event_id IN (4, 5) OR event_id > 6"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    got = sorted(r["event_id"] for r in L.drain(L.stream_checkpoint_cadence(stream, 300.0), "c").collect())
    assert got == [0, 3, 6, 9, 12, 15, 18]


def test_latest_substage_survives_duplicates(spark, tmp_path):
    rows = [(1, "a", 0, 1, 1.0, 1.0, "in_progress", 0.2), (1, "a", 0, 2, 1.0, 1.0, "in_progress", 0.6)]
    df = spark.createDataFrame(rows, EVENT)
    write_batches(spark, tmp_path, df.unionByName(df), ["ts = 1", "ts = 2"])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    latest = L.drain_updates(L.stream_latest_substages(stream), "p", ["job_id", "stage", "substage"])
    assert [r["progress"] for r in latest.collect()] == [0.6]


def test_snapshots_over_batches(spark, tmp_path):
    """The newest row of a substage counts; a finished or idle job leaves the state and starts anew, a late row is dropped."""
    rows = [
        (0, 1, "a", 0, 1, 1.0, 1.0, "in_progress", 0.2), (0, 2, "a", 0, 1, 1.0, 1.0, "completed", 0.0),
        (1, 1, "a", 0, 2, 1.0, 1.0, "in_progress", 0.5), (1, 1, "b", 0, 3, 3.0, 1.0, "skipped", 0.0), (1, 9, "z", 0, 500, 1.0, 1.0, "in_progress", 0.1),
        (2, 1, "a", 0, 501, 1.0, 1.0, "in_progress", 0.4), (2, 2, "b", 0, 502, 1.0, 1.0, "in_progress", None), (2, 9, "a", 0, 3, 1.0, 1.0, "completed", 1.0),
        (3, 9, "z", 0, 620, 1.0, 1.0, "completed", 0.0),
    ]
    schema = "file INT, job_id INT, stage STRING, substage INT, m BIGINT, weight DOUBLE, substage_weight DOUBLE, status STRING, progress DOUBLE"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_micros(F.col("m") * 60_000_000))
    write_batches(spark, tmp_path, df, [f"file = {i}" for i in range(4)])
    stream = L.read_stream(spark, str(tmp_path), "*.parquet", df.schema, max_files=1)
    got = {r["job_id"]: r for r in L.drain_updates(L.stream_snapshots(stream), "snap", ["job_id"]).collect()}
    assert (got[1]["n_stages"], got[1]["progress"]) == (1, pytest.approx(0.4))  # idle for over an hour before its last row
    assert (got[2]["n_stages"], got[2]["stage"], got[2]["progress"]) == (1, "b", 0.0)  # was finished before
    assert (got[9]["n_stages"], got[9]["progress"], got[9]["elapsed_s"], got[9]["eta_s"]) == (1, 1.0, 7200.0, 0.0)
    assert got[9]["speed"] == pytest.approx(1 / 7200)
