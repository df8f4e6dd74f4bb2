"""Joins of a large table with one summary row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footlamp.plans.ordered import CHUNK

SPREAD = 32


def part_of(position: Column) -> Column:
    return F.floor(F.greatest(F.coalesce(position, F.lit(0)), F.lit(0)) / F.lit(CHUNK)).cast("bigint")


def in_parts(summary: DataFrame, last: Column) -> DataFrame:
    """A row with ``__salt`` for each range of ``CHUNK`` positions up to ``last``."""
    return summary.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), part_of(last))))


def join_per_key(rows: DataFrame, summary: DataFrame, keys: list[str], by: str, how: str = "inner", spread: int = SPREAD, last: Column | None = None) -> DataFrame:
    """Equi-join on ``keys`` that splits each key into ``spread`` parts by the row column ``by``.

    ``summary`` has one row per key, so repeating it is cheap, while a key with a third of all rows
    lands in ``spread`` tasks and not in one. Adaptive execution still turns the join into a broadcast
    when the summary proves small.

    With ``last``, an expression over ``summary`` for the largest position ``by`` of a key's rows, a key is split into ranges of
    ``CHUNK`` positions instead. The summary is then repeated for the ranges that a key has, which is once for most.
    """
    if last is not None:
        return rows.withColumn("__salt", part_of(F.col(by))).join(in_parts(summary, last), [*keys, "__salt"], how).drop("__salt")
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(F.col(by)), F.lit(spread)).cast("int"))
    right = summary.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")
