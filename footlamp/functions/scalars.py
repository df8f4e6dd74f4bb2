"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def r6(value: Column) -> Column:
    """Round to 6 digits without negative zero.

    The nudge keeps decimal ties from depending on the last bit of the sum before them.
    """
    rounded = F.round(value.cast("double") + 1.37e-8, 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def clamp(value: Column, lo, hi) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), value))


def trunc(value: Column) -> Column:
    """Truncate toward zero, as a cast to integer does."""
    return value.cast("bigint")


def db(ratio: Column) -> Column:
    """Amplitude ratio in decibels; the caller keeps the argument positive."""
    return F.lit(20.0) * F.log10(ratio)


def ratio(a, b) -> Column:
    """a / b, null where b is 0 (strict SQL mode would fail the job on one bad row)."""
    return F.try_divide(a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def banded(value: Column, bands: list[tuple[float, object]], default: object) -> Column:
    """First label whose lower bound (inclusive) is reached; bounds are listed from high to low."""
    out = None
    for bound, label in bands:
        hit = value >= bound
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def lookup(key: Column, table: dict, default: object = None) -> Column:
    """Literal lookup of a fixed table; no join, no broadcast."""
    out = None
    for k, v in table.items():
        value = F.lit(v)
        out = F.when(key == k, value) if out is None else out.when(key == k, value)
    return out if default is None else out.otherwise(F.lit(default))


def codes(*parts: Column) -> Column:
    """Comma-joined list of the codes that apply (nulls dropped)."""
    return F.array_join(F.array_compact(F.array(*parts)), ",")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def epoch_us(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a zone-less timestamp column."""
    return F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, {ts})")


def instant(ts: str = "ts") -> Column:
    """Zone-less timestamp read as UTC: an event time that does not move with the session zone."""
    return F.timestamp_micros(epoch_us(ts))
