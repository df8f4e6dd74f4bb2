"""Structured Streaming forms of the monitoring operators.

Event time is the ``ts`` column, with a ten-minute watermark unless stated. A trigger bounds what one key
brings into a state function at once (``maxFilesPerTrigger`` / ``maxBytesPerTrigger`` on the source), so
a busy host costs state time, not memory. Operators that need rows in order, or a row in many windows, are ``TableStream``s:
each trigger is a batch job of Spark over its own rows and those held back, so Spark sorts, spills and shuffles them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from footlamp.operators.telemetry import bottleneck_codes
from footlamp.plans.storage import delete, scratch_dir

WATERMARK = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Running a stream ---------------------------------------------------------------------------------


def read_stream(spark: SparkSession, folder: str, pattern: str, schema, max_files: int | None = None) -> DataFrame:
    """File stream over what a folder has by the name ``pattern``: parquet files, or tables that are folders of such files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # a stream refuses the plain path of one file, and a filter on file names misses tables that are folders; a glob finds both
    return reader.parquet(f"{folder}/{pattern[:-1]}[{pattern[-1]}]")


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def micros(interval: str) -> int:
    return pd.Timedelta(interval) // pd.Timedelta("1us")


@dataclass(frozen=True)
class TableStream:
    """A stream whose triggers are batch jobs over tables; ``drain`` runs it.

    ``work(rows, last, since, until)`` gives the output of a trigger, of ``schema``: ``rows`` are those held back and those that
    came in, ``last`` is the output before, ``since`` and ``until`` are the watermark before and after the trigger, in
    microseconds as ``time``. Rows for which ``waits(until)`` holds are held back for the next one; they must include the newest, which
    tells the watermark then. Without a ``delay`` there is no watermark and nothing waits. ``view`` is what ``drain`` returns of all outputs.
    """

    rows: DataFrame
    schema: StructType
    work: Callable[[DataFrame, DataFrame, int, int], DataFrame]
    waits: Callable[[int], Column]
    view: Callable[[DataFrame], DataFrame]
    time: str = "us"
    delay: str | None = WATERMARK


ALWAYS = 2**62


def drain_tables(stream: TableStream, name: str) -> DataFrame:
    """``drain`` for a ``TableStream``: a trigger overwrites its own folders and reads those before, so it may be run again."""
    spark, columns = stream.rows.sparkSession, stream.rows.schema
    path, held, log = (scratch_dir(spark, name + part) for part in ("", "-held", "-log"))
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")
    spark.createDataFrame([], columns).write.parquet(f"{held}/batch=-1")

    def run(batch: DataFrame, batch_id: int) -> None:
        read = batch.sparkSession.read
        rows, since, until = batch, -ALWAYS, ALWAYS
        if stream.delay is not None:
            before = read.schema(columns).parquet(f"{held}/batch={batch_id - 1}")
            old, new = (df.agg(F.max(stream.time)).first()[0] for df in (before, batch))
            since, until = (max((t - micros(stream.delay) for t in ts if t is not None), default=-ALWAYS) for ts in ([old], [old, new]))
            rows = before.unionByName(batch)
        last = read.schema(stream.schema).parquet(f"{path}/batch={batch_id - 1}")
        stream.work(rows, last, since, until).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if stream.delay is not None:
            rows.where(stream.waits(until)).write.mode("overwrite").parquet(f"{held}/batch={batch_id}")
            delete(batch.sparkSession, f"{held}/batch={batch_id - 2}")

    query = stream.rows.writeStream.option("checkpointLocation", log).foreachBatch(run).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.view(spark.read.schema(stream.schema).parquet(f"{path}/batch=*"))


def drain(stream: DataFrame | TableStream, name: str) -> DataFrame:
    """Run an append-mode stream over all available input and return the sink table."""
    if isinstance(stream, TableStream):
        return drain_tables(stream, name)
    spark = stream.sparkSession
    path = scratch_dir(spark, name)
    with rocksdb_state(spark):
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("checkpointLocation", scratch_dir(spark, f"{name}-state"))
            .trigger(availableNow=True)
            .start(path)
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream and return the newest row of every key.

    Each micro-batch overwrites its own folder, so a retried batch leaves no duplicates.
    """
    spark = stream.sparkSession
    path = scratch_dir(spark, name)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    with rocksdb_state(spark):
        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", scratch_dir(spark, f"{name}-state"))
            .foreachBatch(save)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    log = spark.read.option("basePath", path).parquet(f"{path}/batch=*")
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")


def late_rows(query) -> int:
    """Rows of a running or finished query that came after the watermark and were dropped."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in (p.get("stateOperators") or [])
    )


# Windows ------------------------------------------------------------------------------------------


def stream_latest_substages(events: DataFrame) -> DataFrame:
    """Newest event of every (job, stage, substage), kept as streaming state (update mode)."""
    rest = [c for c in events.columns if c not in ("job_id", "stage", "substage")]
    newest = events.groupBy("job_id", "stage", "substage").agg(F.max_by(F.struct(*rest), "ts").alias("e"))
    return newest.select("job_id", "stage", "substage", "e.*")


def stream_utilisation(metrics: DataFrame, window: str = "10 minutes", slide: str = "1 minute") -> TableStream:
    """Sliding statistics per host; a window is emitted once the watermark has passed it.

    Rows are summed in panes, which lie whole in or out of a window, and only panes are repeated for each window. A host's windows are dealt out
    in spans of time with the rows that reach into them, so rows are shuffled once, windows never, and no task holds a host. The state is the
    rows of windows that are still open.
    """
    width, step = micros(window), micros(slide)
    pane, span = math.gcd(width, step), step * max(64, 8 * width // step)

    def floored(c: str | Column, to: int) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return c - F.pmod(c, F.lit(to))

    def last_start(c: str) -> Column:
        return floored(c, step)

    def first_start(c: str) -> Column:
        return floored(F.col(c) - width, step) + step

    def work(rows: DataFrame, last: DataFrame, since: int, until: int) -> DataFrame:
        open_ = rows.where(last_start("us") + width > since)
        near = open_.withColumn("span", F.explode(F.sequence(floored(first_start("us"), span), floored(last_start("us"), span), F.lit(span))))
        dealt = near.withColumn("pane", floored("us", pane)).repartition("host", "span")
        parts = dealt.groupBy("host", "span", "pane").agg(
            F.count(F.lit(1)).alias("n"),
            F.min("cpu_pct").alias("cpu_min"),
            F.max("cpu_pct").alias("cpu_max"),
            F.sum("cpu_pct").alias("cpu_sum"),
            F.count("cpu_pct").alias("cpu_n"),
            F.max_by("cpu_pct", "us").alias("cpu_now"),
            F.max("us").alias("us"),
            F.sum(F.col("mem_pct").cast("double")).alias("mem_sum"),
            F.count("mem_pct").alias("mem_n"),
        )
        begin, end = F.greatest(first_start("pane"), F.col("span")), F.least(last_start("pane"), F.col("span") + span - step)
        spread = parts.where(begin <= end).withColumn("st", F.explode(F.sequence(begin, end, F.lit(step))))
        closed = spread.where((F.col("st") + width > since) & (F.col("st") + width <= until))
        found = closed.groupBy("host", "span", "st").agg(
            F.sum("n").alias("n"),
            F.min("cpu_min").alias("cpu_min"),
            F.max("cpu_max").alias("cpu_max"),
            F.try_divide(F.sum("cpu_sum"), F.sum("cpu_n")).alias("cpu_avg"),
            F.max_by("cpu_now", "us").alias("cpu_now"),
            F.try_divide(F.sum("mem_sum"), F.sum("mem_n")).alias("mem_avg"),
        )
        return found.select("host", F.timestamp_micros("st").alias("start"), F.timestamp_micros(F.col("st") + width).alias("end"), "n", "cpu_min", "cpu_max", "cpu_avg", "cpu_now", "mem_avg")

    schema = StructType.fromDDL("host BIGINT, start TIMESTAMP, end TIMESTAMP, n BIGINT, cpu_min DOUBLE, cpu_max DOUBLE, cpu_avg DOUBLE, cpu_now DOUBLE, mem_avg DOUBLE")
    rows = metrics.select("host", F.unix_micros("ts").alias("us"), F.col("cpu_pct").cast("double").alias("cpu_pct"), "mem_pct").where("us IS NOT NULL")
    return TableStream(rows, schema, work, lambda until: last_start("us") + width > until, lambda written: written)


def stream_resource_tumbling(metrics: DataFrame, interval: str = "30 seconds") -> DataFrame:
    """Interval averages over all hosts and per host kind of event."""
    w = metrics.withWatermark("ts", WATERMARK).groupBy(F.window("ts", interval), "kind")
    stats = w.agg(F.count(F.lit(1)).alias("n"), F.avg("cpu_pct").alias("cpu_avg"), F.avg("mem_pct").alias("mem_avg"))
    return stats.select("kind", F.col("window.start").alias("start"), "n", "cpu_avg", "mem_avg")


def stream_recovery_sessions(attempts: DataFrame, gap: str = "5 minutes") -> DataFrame:
    """Attempts of one host closer than ``gap`` form a session; it closes when the watermark passes it."""
    w = attempts.withWatermark("ts", WATERMARK).groupBy(F.session_window("ts", gap), "host")
    s = w.agg(
        F.count(F.lit(1)).alias("n_attempts"),
        F.count_if("success").alias("n_ok"),
        F.count_if(~F.col("success")).alias("n_failed"),
        F.sum("duration_s").alias("duration_s"),
    )
    return s.select(
        "host",
        F.col("session_window.start").alias("start"),
        "n_attempts",
        "n_ok",
        "n_failed",
        "duration_s",
        F.when(F.col("n_ok") > 0, F.lit("resolved")).otherwise(F.lit("failed")).alias("outcome"),
    )


# Stateful functions -------------------------------------------------------------------------------


Step = Callable[[tuple, object, dict[str, np.ndarray]], tuple[object, dict[str, np.ndarray]]]
OWN = "__own"


def fold_runs(step: Step, keys: list[str], out: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` over rows sorted by ``keys``: ``step`` over each key's rows, a part of one batch at a time.

    A row with ``__own`` comes first in its key and brings what ``step`` returned for it before. Each key's last own state comes
    out as such a row.
    """

    def whole(column: pa.Array, owned: int) -> pa.Array:
        """Whole numbers stay such if only the ``owned`` rows have none; numpy would make them doubles."""
        return column.fill_null(0) if owned and pa.types.is_integer(column.type) and column.null_count == owned else column

    def built(parts: list[tuple[tuple, dict]], lengths: list[int]) -> pa.RecordBatch:
        at, n = pa.array(np.repeat(np.arange(len(parts)), lengths)), sum(lengths)
        columns = []
        for field in out:
            if field.name in keys:
                columns.append(pa.array([k[keys.index(field.name)] for k, _ in parts], field.type).take(at))
            elif field.name not in parts[0][1]:
                columns.append(pa.nulls(n, field.type))
            elif pa.types.is_primitive(field.type):
                columns.append(pa.array(np.concatenate([p[field.name] for _, p in parts]), field.type, from_pandas=True))
            else:
                columns.append(pa.array(list(chain.from_iterable(p[field.name] for _, p in parts)), field.type))
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.unique(np.concatenate([pc.run_end_encode(batch.column(k)).run_ends.to_numpy() for k in keys])).tolist()
            owned = batch.num_rows - batch.column(OWN).null_count
            values = {c: whole(batch.column(c), owned).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            found, lengths, owns = [], [], []
            for start, end in zip([0, *ends], ends):
                here = tuple(batch.column(k)[start].as_py() for k in keys)
                if here != key:
                    if key is not None:
                        owns.append((key, {OWN: [pickle.dumps(own)]}))
                    key, own = here, None
                if values[OWN][start] is not None:
                    own, start = pickle.loads(values[OWN][start]), start + 1
                if start < end:
                    own, some = step(key, own, {c: v[start:end] for c, v in values.items()})
                    n = len(next(iter(some.values())))
                    if n:
                        found.append((key, some))
                        lengths.append(n)
            if found:
                yield built(found, lengths)
            if owns:
                yield built(owns, [1] * len(owns))
        if key is not None:
            yield built([(key, {OWN: [pickle.dumps(own)]})], [1])

    return run


def in_event_order(events: DataFrame, keys: list[str], step: Step, schema: str, order: list[str], delay: str | None = WATERMARK) -> TableStream:
    """Apply ``step(key, own state, columns) -> (own state, columns of the output)`` to each key's rows in ``order``.

    Rows are held back until the watermark has passed them, so files may arrive in any order within its delay and a trigger's
    borders do not matter; later rows are dropped. Those that it has passed are sorted by Spark within their key and streamed
    through ``step`` in parts of one Arrow batch, so no task holds a key's rows, however many a trigger brings; a key's rows do pass
    through one task, since its state goes from each row to the next. What is left when a stream ends, the rows of the last ten
    minutes, stays held for the next run. The first column of ``order`` is the time in microseconds. Without a ``delay`` rows are
    in order within a trigger and the source must bring them in order from trigger to trigger.
    """
    full = StructType.fromDDL(f"{schema}, {OWN} BINARY")
    fold, time = fold_runs(step, keys, to_arrow_schema(full)), F.col(order[0])

    def work(rows: DataFrame, last: DataFrame, since: int, until: int) -> DataFrame:
        passed = rows.where((time > since) & (time <= until)).withColumn(OWN, F.lit(None).cast("binary"))
        own = last.where(F.col(OWN).isNotNull()).select(*keys, OWN)
        both = passed.unionByName(own, allowMissingColumns=True).repartition(*keys)
        return both.sortWithinPartitions(*keys, F.col(OWN).isNull(), *order).mapInArrow(fold, full)

    def view(written: DataFrame) -> DataFrame:
        return written.where(F.col(OWN).isNull()).drop(OWN)

    return TableStream(events, full, work, lambda until: time > until, view, order[0], delay)


def stream_session_pairs(events: DataFrame, opens: str = "signup", closes: str = "purchase") -> TableStream:
    """Join an opening with the first closing before the next opening of the same host: at most one row an opening."""
    columns = ["open_id", "close_id", "open_us", "close_us"]

    def step(key, own, rows):
        pairs = []
        for us, event_id, kind in zip(rows["us"].tolist(), rows["event_id"].tolist(), rows["kind"]):
            if kind == opens:
                own = (us, event_id)
            elif own is not None:
                pairs.append((own[1], event_id, own[0], us))
                own = None
        return own, dict(zip(columns, np.array(pairs, dtype=np.int64).reshape(-1, len(columns)).T))

    wanted = events.where(F.col("kind").isin(opens, closes)).select("host", "us", "event_id", "kind")
    ordered = in_event_order(wanted, ["host"], step, "host BIGINT, open_id BIGINT, close_id BIGINT, open_us BIGINT, close_us BIGINT", ["us", "event_id"])
    return replace(ordered, view=lambda written: ordered.view(written).where("host IS NOT NULL"))


def stream_bottlenecks(metrics: DataFrame, n: int = 5) -> TableStream:
    """Bottlenecks over the last ``n`` samples of each host in event order; the state is the last ``n - 1`` of them."""
    cols = ["cpu_pct", "mem_pct", "gpu_pct", "disk_mb_s"]

    def step(key, own, rows):
        seen, old = (0, np.zeros((0, len(cols)))) if own is None else own
        both = np.vstack([old, np.column_stack([rows[c].astype(float) for c in cols])])

        def tail_sum(a: np.ndarray) -> np.ndarray:
            padded = np.vstack([np.zeros((n - 1, len(cols))), a])
            return sum(padded[i : i + len(a)] for i in range(n))[len(old) :]

        with np.errstate(invalid="ignore", divide="ignore"):
            means = tail_sum(np.nan_to_num(both)) / tail_sum(~np.isnan(both))
        new = len(rows["event_id"])
        out = {"event_id": rows["event_id"], "seq": seen + np.arange(new), **{f"m_{c}": m for c, m in zip(cols, means.T)}}
        return (seen + new, both[max(len(both) - n + 1, 0) :].copy()), out

    schema = "host BIGINT, event_id BIGINT, seq BIGINT, m_cpu_pct DOUBLE, m_mem_pct DOUBLE, m_gpu_pct DOUBLE, m_disk_mb_s DOUBLE"
    timed = metrics.select("host", F.unix_micros("ts").alias("us"), "event_id", *[F.col(c).cast("double").alias(c) for c in cols])
    ordered = in_event_order(timed, ["host"], step, schema, ["us", "event_id"])
    enough = F.col("seq") >= n - 1

    def known(c: str) -> Column:
        return F.when(~F.isnan(f"m_{c}"), F.col(f"m_{c}"))

    found = bottleneck_codes(*[known(c) for c in cols])

    def view(written: DataFrame) -> DataFrame:
        return ordered.view(written).select(
            "event_id",
            "host",
            F.when(enough, F.lit("analysed")).otherwise(F.lit("insufficient_data")).alias("status"),
            F.when(enough, found).alias("bottlenecks"),
            F.when(enough, known("cpu_pct")).alias("avg_cpu"),
        )

    return replace(ordered, view=view)


def stream_ema(frames: DataFrame, alpha: float = 0.1, block: int = 4096) -> TableStream:
    """out_t = (1 - alpha) * frame_t + alpha * out_(t-1), on the stabilised frame.

    Pixels do not see each other, so a frame is cut into blocks and a long recording is spread over
    (asset, block) states. Frames have no event time: the source must give an asset's frames in order of ``frame_key``
    from trigger to trigger; within a trigger they are sorted.
    """
    n_blocks = F.ceil(F.size("luma") / block).cast("int")
    parts = frames.select("asset_id", "frame_key", "luma", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"))
    parts = parts.withColumn("luma", F.slice("luma", F.col("block") * block + 1, F.lit(block)))

    def step(key, last, rows):
        out = []
        for x in rows["luma"]:
            last = x if last is None else (1 - alpha) * x + alpha * last
            out.append(last)
        return last, {"frame_key": rows["frame_key"], "luma": out}

    parts = parts.select("asset_id", F.col("frame_key").cast("bigint").alias("frame_key"), F.col("luma").cast("array<double>").alias("luma"), "block")
    return in_event_order(parts, ["asset_id", "block"], step, "asset_id INT, frame_key BIGINT, block INT, luma ARRAY<DOUBLE>", ["frame_key"], None)


def stream_checkpoint_cadence(events: DataFrame, every_s: float = 300.0) -> TableStream:
    """Emit a restore point for the first event and then whenever ``every_s`` have passed since the last."""
    every = int(every_s * 1e6)

    def step(key, last, rows):
        us, picked, at = rows["us"], [], -1
        while True:
            at = max(at + 1, 0 if last is None else int(np.searchsorted(us, last + every)))
            if at >= len(us):
                break
            picked.append(at)
            last = int(us[at])
        picked = np.array(picked, dtype=np.int64)
        return last, {"event_id": rows["event_id"][picked], "us": us[picked]}

    return in_event_order(events.select("host", "us", "event_id"), ["host"], step, "host BIGINT, event_id BIGINT, us BIGINT", ["us", "event_id"])


def stream_snapshots(events: DataFrame, idle: str = "1 hour") -> DataFrame:
    """Live snapshot of every job that a trigger brings rows of (update mode): progress, elapsed and remaining seconds, speed.

    The state is one entry for each (stage, substage), the newest by ``ts``, whatever number of events a job has. A job whose
    substages are all completed or skipped leaves the state once the watermark has passed its last event; any other one after
    ``idle`` of event time without an event. ``progress`` weighs as ``operators.jobs.progress`` does, ``speed`` is finished
    substages a second. Rows without job, stage, substage or time are left out.
    """
    wait = int(pd.Timedelta(idle).total_seconds() * 1000)
    columns = ["job_id", "stage", "stage_progress", "n_stages", "progress", "elapsed_s", "eta_s", "speed"]

    class Snapshot(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.span = handle.getValueState("span", "first BIGINT, last BIGINT")
            self.parts = handle.getMapState("parts", "stage STRING, substage BIGINT", "us BIGINT, weight DOUBLE, share DOUBLE, part DOUBLE, finished BOOLEAN")

        def handleInputRows(self, key, rows, timerValues):
            timers, mark = list(self.handle.listTimers()), timerValues.getCurrentWatermarkInMs()
            for timer in timers:
                self.handle.deleteTimer(timer)
            if any(timer <= mark for timer in timers):  # expired before these rows came
                self.handleExpiredTimer(key, timerValues, None)
            first, last = self.span.get() if self.span.exists() else (None, None)
            for some in rows:
                some = some[some["us"] > mark * 1000] if mark > 0 else some  # Spark lets rows pass that are one trigger late
                for stage, sub, us, weight, share, part, finished in some[["stage", "substage", "us", "weight", "share", "part", "finished"]].itertuples(index=False, name=None):
                    first = us if first is None else min(first, us)
                    last = us if last is None else max(last, us)
                    place = (stage, int(sub))
                    if not self.parts.containsKey(place) or self.parts.getValue(place)[0] <= us:
                        self.parts.updateValue(place, (int(us), float(weight), float(share), float(part), bool(finished)))
            if first is None:
                return
            self.span.update((int(first), int(last)))
            known = [(tuple(k), tuple(v)) for k, v in self.parts.iterator()]
            due = last // 1000 + (0 if all(v[4] for _, v in known) else wait)
            self.handle.registerTimer(max(due, mark + 1))
            stages: dict[str, list] = {}
            for (stage, _), (_, weight, share, part, _) in known:
                s = stages.setdefault(stage, [0.0, 0.0, 0.0])
                s[:] = [max(s[0], weight), s[1] + part * share, s[2] + share]
            done = {stage: a / b if b > 0 else 0.0 for stage, (_, a, b) in stages.items()}
            total = sum(w for w, _, _ in stages.values())
            progress = sum(done[stage] * w for stage, (w, _, _) in stages.items()) / total if total > 0 else 0.0
            now = max((v[0], k) for k, v in known)[1][0]
            elapsed = (last - first) / 1e6
            eta = elapsed / progress - elapsed if 0 < progress < 1 else 0.0
            speed = sum(v[4] for _, v in known) / elapsed if elapsed > 0 else 0.0
            yield pd.DataFrame([(key[0], now, done[now], len(stages), progress, elapsed, eta, speed)], columns=columns)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            self.parts.clear()
            self.span.clear()
            return iter(())

        def close(self) -> None:
            pass

    finished = F.coalesce(F.col("status").isin("completed", "skipped"), F.lit(False))
    part = F.when(finished, F.lit(1.0)).otherwise(F.coalesce(F.col("progress").cast("double"), F.lit(0.0)))
    rows = events.where("job_id IS NOT NULL AND stage IS NOT NULL AND substage IS NOT NULL AND ts IS NOT NULL").select(
        F.col("job_id").cast("bigint").alias("job_id"), "stage", F.col("substage").cast("bigint").alias("substage"), "ts", F.unix_micros("ts").alias("us"),
        F.coalesce(F.col("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.col("substage_weight"), F.lit(0.0)).alias("share"), part.alias("part"), finished.alias("finished"),
    )
    schema = "job_id BIGINT, stage STRING, stage_progress DOUBLE, n_stages BIGINT, progress DOUBLE, elapsed_s DOUBLE, eta_s DOUBLE, speed DOUBLE"
    return rows.withWatermark("ts", WATERMARK).groupBy("job_id").transformWithStateInPandas(Snapshot(), schema, "Update", "EventTime")


def stream_stalled_jobs(events: DataFrame, minutes: float, expected: int) -> DataFrame:
    """Hosts without an event for ``minutes`` of event time, with the minutes left at their own rate."""
    wait = int(minutes * 60 * 1000)

    def step(key, chunks, state: GroupState):
        if state.hasTimedOut:
            n, first, last = state.get
            state.remove()
            spent = (last - first) / 6e7
            left = max(0, expected - n) * spent / (n - 1) if n > 1 else None
            yield pd.DataFrame([(key[0], n, last, left)], columns=["host", "n_events", "last_us", "remaining_min"])
            return
        n, first, last = state.get if state.exists else (0, None, None)
        for pdf in chunks:
            n += len(pdf)
            lo, hi = int(pdf["us"].min()), int(pdf["us"].max())
            first = lo if first is None else min(first, lo)
            last = hi if last is None else max(last, hi)
        state.update((n, first, last))
        due = last // 1000 + wait
        # a timer may not lie behind the watermark; such a host is due at the next batch
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return (
        events.withWatermark("ts", WATERMARK)
        .groupBy("host")
        .applyInPandasWithState(
            step,
            "host BIGINT, n_events BIGINT, last_us BIGINT, remaining_min DOUBLE",
            "n BIGINT, first BIGINT, last BIGINT",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


