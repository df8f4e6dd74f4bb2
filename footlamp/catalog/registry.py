"""Registry of runnable queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from footlamp.session import ship_package, small_batches

Runner = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Runner
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Register ``fn(tables)``; ``tables.<name>`` reads one of the given parquet tables."""

    def wrap(fn: Callable) -> Callable:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            small_batches(spark)
            return fn(Tables(spark, sf_dir))

        REGISTRY[name] = Query(name, run, sql)
        return fn

    return wrap


class Tables:
    """Lazy readers of the given tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def __getattr__(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{table}.parquet")


def r6(expr: str) -> str:
    """SQL text of :func:`footlamp.functions.scalars.r6`."""
    rounded = f"round(CAST({expr} AS DOUBLE) + 1.37e-8, 6)"
    return f"(CASE WHEN {rounded} = 0 THEN 0e0 ELSE {rounded} END)"
