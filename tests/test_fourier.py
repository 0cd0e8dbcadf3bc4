"""Transforms in four steps against numpy, direct sums and SQL."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideflow.functions import fourier
from tideflow.operators import lagcorr, memory


def table(spark, **series):
    rows = [pd.DataFrame({"series": k, "idx": np.arange(len(v)), "a": v, "b": np.roll(v, 3) ** 2 - 0.5}) for k, v in series.items()]
    return spark.createDataFrame(pd.concat(rows).astype({"a": float, "b": float}))


def complex_rows(df):
    return {(r["series"], r["idx"]): complex(r["x_re"], r["x_im"]) for r in df.collect()}


@pytest.mark.parametrize("sign", [-1, 1])
def test_transform_is_that_of_numpy(spark, sign):
    rng = np.random.default_rng(0)
    x = {m: rng.normal(size=1 << m) + 1j * rng.normal(size=1 << m) for m in (0, 1, 2, 5, 8)}
    rows = [(f"s{m}", m, t, float(v.real), float(v.imag)) for m, xs in x.items() for t, v in enumerate(xs) if t % 7 != 3]
    d = spark.createDataFrame(rows, "series string, m int, idx long, x_re double, x_im double")
    got = complex_rows(fourier.transform(d, ["x"], sign, tile=16))
    for m, xs in x.items():
        xs = np.where(np.arange(1 << m) % 7 == 3, 0, xs)
        want = np.fft.fft(xs) if sign < 0 else np.fft.ifft(xs) * len(xs)
        assert max(abs(got.get((f"s{m}", k), 0) - w) for k, w in enumerate(want)) < 1e-10


def test_size(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (0, 1, 2, 3, 4, 5, 1023, 1024, 1025, 2**40)], "n long").select(fourier.size_for(F.col("n"))).collect()]
    assert got == [0, 0, 1, 2, 2, 3, 10, 10, 11, 40]


@pytest.mark.parametrize("tile", [8, 1 << 16])
def test_correlations_of_all_lags(spark, tile):
    rng = np.random.default_rng(1)
    d = table(spark, long=rng.normal(size=300), one=np.ones(1), two=np.array([2.0, -1.0]))
    # values are missing at some places, and for a whole stretch
    d = d.withColumn("a", F.when((F.col("series") != "long") | (F.col("idx") % 5 != 0), F.col("a"))).withColumn("b", F.when((F.col("series") != "long") | (F.col("idx") < 250), F.col("b")))
    p = d.toPandas().sort_values(["series", "idx"])
    got = {(r["series"], r["lag"]): r for r in fourier.correlations(d, "a", "b", tile=tile).collect()}
    want = {}
    for name, g in p.groupby("series"):
        a, b = g["a"].to_numpy(), g["b"].to_numpy()
        for k in range(len(a)):
            y = a[: len(a) - k] * b[k:]
            want[name, k] = (int((~np.isnan(y)).sum()), np.nansum(y))
    assert got.keys() == want.keys()
    for k, (pairs, s) in want.items():
        assert got[k]["pairs"] == pairs
        assert abs(got[k]["s"] - s) < 1e-10 if pairs else got[k]["s"] is None


def test_direct_and_transformed_sums_agree(spark):
    d = table(spark, s=np.random.default_rng(2).normal(size=40), short=np.arange(3.0))
    direct, far = ({(r["series"], r["lag"]): r for r in lagcorr.correlation_sums(d, "a", "b", k).collect()} for k in (64, 65))
    assert len(direct) == 130 and len(far) == 132
    for k, r in direct.items():
        assert r["pairs"] == far[k]["pairs"] and (r["s"] is None) == (far[k]["s"] is None)
        assert r["s"] is None or abs(r["s"] - far[k]["s"]) < 1e-10


def test_sums_of_no_rows(spark):
    d = spark.createDataFrame([], "series string, idx long, a double, b double")
    assert lagcorr.correlation_sums(d, "a", "b").collect() == [] and lagcorr.correlation_sums(d, "a", "b", 3).collect() == []
    assert memory.log_periodogram(d, value="a").collect() == []


@pytest.mark.parametrize("n", [1, 2, 97, 360, 512])
def test_periodogram_of_any_length(spark, n):
    x = np.random.default_rng(n).normal(size=n).cumsum()
    f = np.fft.fft(x - x.mean())
    for power in (0.5, 0.99):
        got = {r["k"]: r["i"] for r in memory.log_periodogram(table(spark, s=x), power, "a").collect()}
        top = int(np.floor(n**power))
        assert sorted(got) == list(range(1, top + 1))
        assert all(abs(got[k] - abs(f[k % n]) ** 2 / (2 * np.pi * n)) < 1e-9 * (1 + abs(f).max() ** 2) for k in got)


def test_small_tiles_give_the_same_frequencies(spark):
    x = np.random.default_rng(3).normal(size=1000)
    d = table(spark, s=x).withColumn("n", F.lit(1000).cast("long"))
    f = np.fft.fft(x)
    got = fourier.lowest(d, "a", F.lit(31), tile=64).collect()
    assert sorted(r["k"] for r in got) == list(range(1, 32))
    assert all(abs(complex(r["re"], r["im"]) - f[r["k"]]) < 1e-9 for r in got)


def test_pooled_sums_weigh_series_by_their_pairs(spark):
    d = table(spark, s=np.array([1.0, 2.0, 3.0]), t=np.array([1.0, 1.0]))
    got = {r["lag"]: (r["c"], r["pairs"]) for r in lagcorr.pooled_correlation(lagcorr.correlation_sums(d, "a", "a")).collect()}
    want = {0: (16 / 5, 5), 1: (9 / 3, 3), 2: (3.0, 1)}
    assert got.keys() == want.keys() and all(abs(got[k][0] - w[0]) < 1e-12 and got[k][1] == w[1] for k, w in want.items())
