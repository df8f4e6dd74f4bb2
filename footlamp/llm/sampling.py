"""Bounded samples of labelled rows, the only rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def about(rows: DataFrame, label: str, key: Column, cap: int, counts: dict) -> DataFrame:
    """About ``cap`` rows of each label of ``counts``, all of a label that has fewer, chosen by a hash of ``key``.

    ``counts`` has the number of rows of each label, over all rows. Rows of other labels are left out. Adds ``share``,
    the part of the label's rows that is taken. A label is looked up in place, so no row is shuffled.
    """
    if not counts:
        return rows.where("false").withColumn("share", F.lit(1.0))
    pairs = [F.lit(x) for name, n in counts.items() for x in (name, min(1.0, cap / n))]
    share = F.element_at(F.create_map(*pairs), F.col(label))
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), key), 11) / F.lit(float(1 << 53))
    return rows.withColumn("share", share).where(place < F.col("share"))
