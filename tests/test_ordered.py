"""Chunked helpers against brute force, with chunks far smaller than the keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footlamp.plans.joins import in_parts, join_per_key
from footlamp.plans.ordered import CHUNK, asof_last, exact_percentiles, in_ranges, number_rows, running_sums, sliding


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))  # one key holds half of all rows
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": rng.integers(-20, 20, n) / 4.0, "mark": rng.random(n) < 0.2})
    return spark.createDataFrame(pdf).cache(), pdf.sort_values(["k", "t"], ignore_index=True)


def chunk(size=37):
    return F.floor(F.col("t") / size).cast("bigint")


def fetch(df):
    return df.toPandas().sort_values(["k", "t"], ignore_index=True)


def test_ranges_split_a_hot_key(spark):
    """One key has nearly all rows, all in one hour at microsecond steps: its rows lie in many ranges."""
    n = 4000
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 50 == 0, 1, 0), "t": np.random.default_rng(1).permutation(n), "v": np.arange(n) % 7})
    df = spark.createDataFrame(pdf)
    ranges = in_ranges(df, ["k"], ["t"]).where("k = 0").groupBy("__chunk").count().toPandas()["count"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(ranges) >= parts - 1 and ranges.max() < 2 * n / parts
    pdf = pdf.sort_values(["k", "t"], ignore_index=True)
    got = fetch(running_sums(number_rows(df, ["k"], ["t"], None, "n"), ["k"], ["t"], None, {"s": F.col("v")}))
    assert (got["n"] == pdf.groupby("k").cumcount()).all() and (got["s"] == pdf.groupby("k")["v"].cumsum()).all()
    newest = fetch(number_rows(df, ["k"], [F.desc("t")], None, "n"))
    assert (newest["n"] == pdf.groupby("k").cumcount(ascending=False)).all()
    last = fetch(asof_last(df, ["k"], ["t"], None, F.when(F.col("v") == 0, F.col("t")), "last"))
    assert (last["last"].fillna(-1) == pdf["t"].where(pdf["v"] == 0).groupby(pdf["k"]).ffill().fillna(-1)).all()


def test_number_rows(data):
    df, pdf = data
    got = fetch(number_rows(df, ["k"], ["t"], chunk(), "n"))
    assert (got["n"] == pdf.groupby("k").cumcount()).all()


def test_number_rows_descending(data):
    df, pdf = data
    got = fetch(number_rows(df, ["k"], [F.desc("t")], -chunk(), "n"))
    assert (got["n"] == pdf.groupby("k").cumcount(ascending=False)).all()


def test_running_sums(data):
    df, pdf = data
    got = fetch(running_sums(df, ["k"], ["t"], chunk(), {"s": F.col("v")}))
    assert np.allclose(got["s"], pdf.groupby("k")["v"].cumsum())


@pytest.mark.parametrize("size", [5, 16, 100000])
def test_sliding(data, size):
    df, pdf = data
    seq = number_rows(df, ["k"], ["t"], chunk(), "n")
    got = fetch(
        sliding(
            seq, ["k"], "n",
            lambda w: {"m": F.avg("v").over(w.rowsBetween(-4, 2)), "p": F.lag("v", 3).over(w)}, before=4, after=2, size=size,
        )
    )
    assert len(got) == len(pdf)
    g = pdf.groupby("k")["v"]
    assert np.allclose(got["p"].astype(float), g.shift(3), equal_nan=True)
    want = np.concatenate([[x[max(0, i - 4) : i + 3].mean() for i in range(len(x))] for _, x in ((k, s.to_numpy()) for k, s in g)])
    assert np.allclose(got["m"], want)


def test_asof_last(data):
    df, pdf = data
    got = fetch(asof_last(df, ["k"], ["t"], chunk(), F.when(F.col("mark"), F.col("v")), "last"))
    want = pdf["v"].where(pdf["mark"]).groupby(pdf["k"]).ffill()
    assert np.allclose(got["last"].astype(float), want, equal_nan=True)


def test_exact_percentiles_with_ties(data):
    df, pdf = data
    got = exact_percentiles(df, ["k"], "v", {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.95, "e": 1.0}).toPandas().set_index("k").sort_index()
    for c, p in {"a": 0.0, "b": 0.2, "c": 0.5, "d": 0.95, "e": 1.0}.items():
        assert np.allclose(got[c], pdf.groupby("k")["v"].quantile(p).sort_index()), c


def test_exact_percentiles_wide_range(spark):
    values = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 3.5, 3.5, None]
    df = spark.createDataFrame([(1, v) for v in values], "k INT, v DOUBLE")
    got = exact_percentiles(df, ["k"], "v", {"p": 0.3, "q": 0.7}).first()
    known = [v for v in values if v is not None]
    assert got["p"] == pytest.approx(np.percentile(known, 30))
    assert got["q"] == pytest.approx(np.percentile(known, 70))


def test_exact_percentiles_empty(spark):
    df = spark.createDataFrame([], "k INT, v DOUBLE")
    assert exact_percentiles(df, ["k"], "v", {"p": 0.5}).count() == 0


def test_join_per_key(data):
    df, pdf = data
    top = df.groupBy("k").agg(F.max("v").alias("top"))
    got = fetch(join_per_key(df, top, ["k"], "t", spread=5))
    assert len(got) == len(pdf)
    assert (got["top"] == pdf.groupby("k")["v"].transform("max")).all()


def test_join_per_key_left(data):
    df, pdf = data
    some = df.where("k < 3").groupBy("k").agg(F.max("v").alias("top"))
    got = fetch(join_per_key(df, some, ["k"], "t", "left"))
    assert len(got) == len(pdf) and got["top"].isna().sum() == (pdf["k"] >= 3).sum()


def test_join_per_key_repeats_the_summary_only_for_ranges_that_a_key_has(spark):
    """Keys of few rows have one summary row each in the join, a key over three ranges has three; every row is joined once."""
    df = spark.sql(f"SELECT 0 AS k, id * {CHUNK} DIV 2 AS t FROM range(6) UNION ALL SELECT id + 1 AS k, 0 AS t FROM range(50)")
    df = df.unionByName(spark.sql("SELECT 1 AS k, CAST(NULL AS bigint) AS t UNION ALL SELECT 2 AS k, -3L AS t"))
    top = df.groupBy("k").agg(F.max("t").alias("last"))
    got = join_per_key(df, top, ["k"], "t", last=F.col("last"))
    assert got.count() == df.count() and got.where("t > last").count() == 0
    assert in_parts(top, F.col("last")).count() == 53
