"""User callbacks and SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from footlamp.operators.audio import VENUE_COMPRESSION, VENUE_WIDTH
from footlamp.operators.spectrum import SPEECH_BANDS, VENUE_FACTORS
from footlamp.plans.storage import scratch_dir


def map_frames(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Apply ``fn`` to each 2-D frame; a frame whose call fails comes back as null with the error name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out, errors = [], []
            for a, w, h in zip(pdf["luma"], pdf["w"], pdf["h"]):
                try:
                    out.append(np.asarray(fn(np.asarray(a).reshape(h, w)), dtype=float).ravel())
                    errors.append(None)
                except Exception as e:
                    out.append(None)
                    errors.append(type(e).__name__)
            yield pd.DataFrame(
                {"asset_id": pdf["asset_id"], "frame_no": pdf["frame_no"], "luma": pd.Series(out, dtype=object), "error": pd.Series(errors, dtype=object)}
            )

    slim = frames.select("asset_id", "frame_no", "w", "h", "luma")
    return slim.mapInPandas(run, "asset_id INT, frame_no BIGINT, luma ARRAY<DOUBLE>, error STRING")


class StagedRun:
    """Named stages run in order, each stored as a table, so a later run can resume after any of them."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or scratch_dir(spark, "run")
        self.stages: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []

    def add_stage(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> StagedRun:
        self.stages.append((name, fn))
        return self

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def run(self, source: DataFrame | None = None, resume_after: str | None = None) -> DataFrame:
        names = [n for n, _ in self.stages]
        start = names.index(resume_after) + 1 if resume_after else 0
        df = self.result(resume_after) if resume_after else source
        for name, fn in self.stages[start:]:
            df.transform(fn).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            df = self.result(name)
        return df


def register_venue_functions(spark: SparkSession) -> None:
    """SQL functions venue_gain(venue, band), venue_width(venue), venue_threshold(venue); unknown is medium."""

    def case(table: dict[str, float]) -> str:
        arms = " ".join(f"WHEN '{k}' THEN {float(v)!r}D" for k, v in table.items())
        return f"CASE venue {arms} ELSE {float(table['medium'])!r}D END"

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION venue_width(venue STRING) RETURNS DOUBLE RETURN {case(VENUE_WIDTH)}")
    limits = {k: v[0] for k, v in VENUE_COMPRESSION.items()}
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION venue_threshold(venue STRING) RETURNS DOUBLE RETURN {case(limits)}")
    arms = []
    for name, _, _, gain in SPEECH_BANDS:
        arms.append(f"WHEN '{name}' THEN {case({v: gain * f[name] for v, f in VENUE_FACTORS.items()})}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION venue_gain(venue STRING, band STRING) RETURNS DOUBLE "
        f"RETURN CASE band {' '.join(arms)} END"
    )
