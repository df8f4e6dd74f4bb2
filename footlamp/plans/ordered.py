"""Ordered computations that never put a whole key into one task.

A recording, host or job may hold a large share of all rows, so ``Window.partitionBy(key)`` over raw
rows is not safe. Each helper splits a key into chunks (bounded ranges of the order column), works
inside the chunk and carries only one summary row per chunk across the key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footlamp.plans.storage import cut_lineage

CHUNK = 65536


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Add ``__chunk``: rows in ranges of (keys, order), a range per shuffle partition.

    Ranges are of about equal row counts whatever values the order has, so a key with many rows spans many of them. The
    rows are stored once, since ranges drawn again could differ.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("__chunk", F.spark_partition_id()))


def with_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], chunk: Column | None) -> DataFrame:
    return in_ranges(df, keys, order) if chunk is None else df.withColumn("__chunk", chunk)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    sums: dict[str, Column],
) -> DataFrame:
    """Add inclusive running sums along ``order``.

    ``chunk`` must be monotone in ``order`` and bounded in rows, as a dense number divided is; with None the rows are
    cut into ranges of equal size.
    """
    keys = list(keys)
    tagged = with_chunk(df, keys, order, chunk)
    for name, value in sums.items():
        tagged = tagged.withColumn(f"__in_{name}", value)
    per_chunk = tagged.groupBy(*keys, "__chunk").agg(
        *[F.sum(f"__in_{name}").alias(f"__sum_{name}") for name in sums]
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys,
        "__chunk",
        *[F.coalesce(F.sum(f"__sum_{n}").over(earlier), F.lit(0)).alias(f"__carry_{n}") for n in sums],
    )
    inside = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = tagged.select(
        "*", *[F.sum(f"__in_{n}").over(inside).alias(f"__local_{n}") for n in sums]
    )
    joined = local.join(carry, [*keys, "__chunk"])
    return joined.select(
        *df.columns, *[(F.col(f"__carry_{n}") + F.col(f"__local_{n}")).alias(n) for n in sums]
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    name: str,
) -> DataFrame:
    """Add the dense 0-based position of each row in its key."""
    out = running_sums(df, keys, order, chunk, {name: F.lit(1).cast("bigint")})
    return out.withColumn(name, F.col(name) - 1)


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    seq: str,
    make: Callable[[Window], dict[str, Column]],
    before: int = 0,
    after: int = 0,
    size: int = CHUNK,
) -> DataFrame:
    """Evaluate window expressions that look at most ``before`` / ``after`` rows away.

    ``seq`` is a dense 0-based position. Rows near a chunk border are repeated in the neighbouring
    chunk, so every frame is complete; the repeats are dropped afterwards.
    """
    keys = list(keys)
    first = F.greatest(F.lit(0), F.floor((F.col(seq) - after) / F.lit(size)))
    last = F.floor((F.col(seq) + before) / F.lit(size))
    spread = df.withColumn("__chunk", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    window = Window.partitionBy(*keys, "__chunk").orderBy(seq)
    out = spread.select("*", *[c.alias(n) for n, c in make(window).items()])
    home = F.floor(F.col(seq) / F.lit(size)).cast("bigint")
    return out.where(F.col("__chunk") == home).drop("__chunk")


def asof_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    chunk: Column | None,
    value: Column,
    name: str,
) -> DataFrame:
    """Add the newest non-null ``value`` at or before each row of its key."""
    keys = list(keys)
    tagged = with_chunk(df, keys, order, chunk).withColumn("__value", value)
    inside = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    rank = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    per_chunk = tagged.groupBy(*keys, "__chunk").agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), rank)).alias("__last")
    )
    earlier = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(
        *keys, "__chunk", F.last("__last", ignorenulls=True).over(earlier).alias("__carry")
    )
    local = tagged.withColumn(
        "__local",
        F.last("__value", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
    )
    return local.join(carry, [*keys, "__chunk"]).select(
        *df.columns, F.coalesce("__local", "__carry").alias(name)
    )


def magnitude_bucket(value: Column, per_octave: int = 32) -> Column:
    """A monotone bucket id of a double: ``per_octave`` buckets for each power of two."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 40000
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value) * size).cast("int")


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float | Callable[[Column], Column]],
) -> DataFrame:
    """Exact linear-interpolated percentiles per key for keys of any size.

    A probability may also be a function from the key's row count to a 0-based rank.

    Equal values are counted first, a histogram finds the buckets that hold the wanted ranks, and
    only the distinct values in those buckets are ranked. ``percentile`` would hold every distinct
    value of a key in one task.
    """
    keys = list(keys)
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__b", magnitude_bucket(F.col("__v")))
    )
    key_window = Window.partitionBy(*keys)
    earlier = key_window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        counted.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .withColumn("__before", F.coalesce(F.sum("__bn").over(earlier), F.lit(0)))
        .withColumn("__total", F.sum("__bn").over(key_window))
    )
    ranks, wanted = {}, F.lit(False)
    for name, p in probs.items():
        total = F.col("__total")
        pos = p(total).cast("double") if callable(p) else F.lit(float(p)) * (total - 1)
        ranks[name] = (pos, F.floor(pos), F.ceil(pos))
        for rank in ranks[name][1:]:
            wanted = wanted | (
                (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__bn"))
            )
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        counted.join(histogram.where(wanted), [*keys, "__b"])
        .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
        .withColumn("__start", F.col("__end") - F.col("__n"))
    )

    def at(rank: Column) -> Column:
        hit = (F.col("__start") <= rank) & (rank < F.col("__end"))
        return F.max(F.when(hit, F.col("__v")))

    aggs = []
    for name, (pos, lo, hi) in ranks.items():
        aggs += [at(lo).alias(f"__lo_{name}"), at(hi).alias(f"__hi_{name}")]
    picked = ranked.groupBy(*keys).agg(F.max("__total").alias("__total"), *aggs)
    return picked.select(
        *keys,
        *[
            (
                F.col(f"__lo_{n}")
                + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * (pos - lo)
            ).alias(n)
            for n, (pos, lo, _) in ranks.items()
        ],
    )
