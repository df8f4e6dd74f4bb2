"""Column access to packed frames.

A frame row carries its pixels as one array. ``explode_pixels`` turns it into pixel rows inside the task
that read it, and ``at`` gathers neighbours by position from the array that is still in the row, so a
stencil measure needs no pixel join and no pixel shuffle: partial aggregation folds a frame back to one
row before anything leaves the task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_pixels(frames: DataFrame, array: str = "luma") -> DataFrame:
    """Add p (position), y, x and v (value of ``array``) for every pixel."""
    df = frames.select("*", F.posexplode(array).alias("p", "v"))
    return df.withColumn("y", F.floor(F.col("p") / F.col("w")).cast("int")).withColumn(
        "x", (F.col("p") % F.col("w")).cast("int")
    )


def _reflect(pos: Column, size: Column) -> Column:
    """Mirror without repeating the border: -1 is 1, size is size-2."""
    top = size - 1
    return F.when(size == 1, F.lit(0)).otherwise(top - F.abs(top - F.abs(pos)))


def at(dy: int, dx: int, array: str = "luma") -> Column:
    """Neighbour of the current pixel row with mirrored borders; offsets stay below the frame side."""
    y = F.col("y") if dy == 0 else _reflect(F.col("y") + dy, F.col("h"))
    x = F.col("x") if dx == 0 else _reflect(F.col("x") + dx, F.col("w"))
    return F.get(F.col(array), (y * F.col("w") + x).cast("int"))


def laplacian(array: str = "luma") -> Column:
    return at(-1, 0, array) + at(1, 0, array) + at(0, -1, array) + at(0, 1, array) - 4 * at(0, 0, array)


def sobel_magnitude(array: str = "luma") -> Column:
    def a(dy, dx):
        return at(dy, dx, array)

    gx = (a(-1, 1) + 2 * a(0, 1) + a(1, 1)) - (a(-1, -1) + 2 * a(0, -1) + a(1, -1))
    gy = (a(1, -1) + 2 * a(1, 0) + a(1, 1)) - (a(-1, -1) + 2 * a(-1, 0) + a(-1, 1))
    return F.sqrt((gx * gx + gy * gy).cast("double"))
