"""Scans, carries, exact quantiles and separation by pointers, against plain loops, with blocks much shorter than the series."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideflow.functions.quantiles import ordered_bits, quantiles
from tideflow.functions.scan import affine_path, carry
from tideflow.operators import events, flow, vol


def table(spark, series, **cols):
    """Several series of different lengths; cols are functions of a series' number giving its values."""
    parts = []
    for k, n in enumerate(series):
        parts.append(pd.DataFrame({"series": f"s{k}", "idx": np.arange(n), **{c: f(k, n) for c, f in cols.items()}}))
    kinds = ", ".join(f"{c} double" for c in cols)
    df = spark.createDataFrame(pd.concat(parts).sample(frac=1, random_state=0), f"series string, idx long, {kinds}")
    return df.select("series", "idx", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in cols])


def by_series(df, c):
    out = {}
    for r in df.orderBy("series", "idx").collect():
        out.setdefault(r["series"], []).append(r[c])
    return out


@pytest.mark.parametrize("block", [1, 3, 64, 1000])
def test_affine_path(spark, block):
    rng = np.random.default_rng(0)
    d = table(spark, [1, 2, 137, 400], a=lambda k, n: rng.choice([0.0, 0.5, 0.97, -0.3], n), b=lambda k, n: rng.normal(size=n), v0=lambda k, n: np.full(n, k + 1.0))
    got = by_series(affine_path(d, F.col("a"), F.col("b"), F.col("v0"), "v", block), "v")
    for s, g in d.toPandas().sort_values("idx").groupby("series"):
        v = [g["v0"].iloc[0]]
        for a, b in zip(g["a"][:-1], g["b"][:-1]):
            v.append(a * v[-1] + b)
        assert np.allclose(got[s], v, rtol=1e-12, atol=1e-12)


def returns(spark):
    rng = np.random.default_rng(1)

    def r(k, n):
        x = rng.normal(0, 0.01, n)
        x[rng.random(n) < 0.1] = np.nan
        return np.full(n, np.nan) if k == 3 else x

    return table(spark, [1, 40, 500, 60], r=r)


def test_ewma_with_missing_returns(spark):
    d = returns(spark)
    got = by_series(vol.ewma_vol(d, 0.94, 64), "sigma")
    for s, g in d.toPandas().sort_values("idx").groupby("series"):
        r = g["r"].to_numpy(float)
        seed = np.nanvar(r[:50]) if np.isfinite(r[:50]).any() else 0
        v = [seed if seed > 0 else 1e-8]
        for x in np.nan_to_num(r[:-1]):
            v.append(0.94 * v[-1] + 0.06 * x * x)
        assert np.allclose(got[s], np.sqrt(v), rtol=1e-10)


def test_garch_path_and_its_rules(spark):
    d = returns(spark)
    params = [("s0", 1e-6, 0.1, 0.8), ("s1", 0.0, 0.1, 0.0), ("s2", 1e-6, 0.3, 0.7), ("s3", 1e-6, 0.1, 0.85)]
    got = by_series(vol.garch_path(d, spark.createDataFrame(params, "series string, omega double, alpha double, beta double"), 64), "sigma")
    for s, w, a, b in params:
        r = d.where(F.col("series") == s).toPandas().sort_values("idx")["r"].to_numpy(float)
        v = [w / (1 - a - b) if 1 - a - b > 0 else np.nanvar(r)]
        for x in np.nan_to_num(r[:-1]):
            new = w + a * x * x + b * v[-1]
            v.append(new if new > 0 else v[-1])
        assert np.allclose(got[s], np.sqrt(v), rtol=1e-10), s
    odd = spark.createDataFrame([("s2", -1e-6, 0.1, 0.8)], "series string, omega double, alpha double, beta double")
    assert vol.garch_path(d, odd).where("sigma IS NOT NULL").count() == 0


@pytest.mark.parametrize("block", [2, 7, 1 << 16])
def test_carry_over_gaps_longer_than_a_block(spark, block):
    rng = np.random.default_rng(2)

    def sparse(k, n):
        x = np.full(n, np.nan)
        at = rng.choice(n, max(1, n // 40), replace=False)
        x[at] = at
        return x

    d = table(spark, [5, 300], v=sparse)
    got = by_series(carry(d, "v", block), "v")
    for s, g in d.toPandas().sort_values("idx").groupby("series"):
        assert [None if x is None else float(x) for x in got[s]] == [None if np.isnan(x) else x for x in g["v"].ffill()]
    bars = d.select("series", "idx")
    aligned = by_series(flow.align_to_returns(d.where("v IS NOT NULL").select("series", F.col("idx").alias("t_w"), "v"), bars, block), "v")
    assert {s: v[1:] for s, v in got.items()} == aligned


def awkward_doubles():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=300), rng.normal(size=100) * 10.0 ** rng.integers(-300, 300, 100), [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1023, 1.7976931348623157e308, -1.7976931348623157e308], 2.0 ** np.arange(-1074.0, 1024), np.nextafter(2.0 ** np.arange(-1000.0, 1000), 0)])
    return x.tolist()


def test_ordered_bits_are_those_of_the_double(spark):
    x = awkward_doubles()
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", ordered_bits(F.col("x")).alias("b")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r["x"])))[0]
        assert r["b"] == (-bits if r["x"] < 0 else bits), r


@pytest.mark.parametrize("local", [0, 100, 1 << 20])
def test_quantiles_equal_percentile_bit_by_bit(spark, local):
    rng = np.random.default_rng(4)
    rows = [("wide", v) for v in awkward_doubles() if abs(v) < 1e300] + [("ties", float(v)) for v in rng.integers(-2, 3, 500)] + [("one", 3.5), ("two", 1.0), ("two", 2.0), ("none", None), ("odd", float("nan")), ("odd", float("inf"))]
    rows += [("close", 1.0 + k * 2.0**-52) for k in range(200)] + [("same", 7.25)] * 50
    d = spark.createDataFrame(rows, "k string, x double").repartition(5)
    probs = [0.0, 0.01, 0.25, 0.5, 0.8, 0.995, 1.0]
    got = {r["k"]: (r["q"], r["q_n"]) for r in quantiles(d, ["k"], F.col("x"), probs, local=local).collect()}
    fine = d.where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    want = {r["k"]: (r["q"], r["n"]) for r in fine.groupBy("k").agg(F.percentile("x", probs).alias("q"), F.count("*").alias("n")).collect()}
    assert got == want and "none" not in got and "odd" not in got


def greedy(at, distance):
    out, last = [], None
    for t in sorted(at):
        if last is None or t - last >= distance:
            out.append(t)
            last = t
    return out


@pytest.mark.parametrize("most", [0, 5, 4096])
def test_separation(spark, most):
    rng = np.random.default_rng(5)
    series = {"dense": sorted(rng.choice(2000, 700, replace=False).tolist()), "rare": [5, 400, 401, 900], "one": [7], "chain": list(range(0, 500)), "edge": [0, 60, 119, 120, 180]}
    rows = [(s, int(t), float(t) / 2) for s, at in series.items() for t in at]
    d = spark.createDataFrame(rows, "series string, idx long, ratio double").repartition(6)
    got = events.separate(d, 60, most)
    assert got.columns == d.columns
    found = {}
    for r in got.collect():
        assert r["ratio"] == r["idx"] / 2
        found.setdefault(r["series"], []).append(r["idx"])
    assert {s: sorted(v) for s, v in found.items()} == {s: greedy(at, 60) for s, at in series.items()}
    assert events.separate(d.limit(0), 60, most).count() == 0


def test_a_chain_of_a_million_candidates(spark):
    d = spark.range(1_000_000).select(F.lit("s").alias("series"), F.col("id").alias("idx"), F.lit(1.0).alias("ratio"))
    got = events.separate(d, 384)
    assert got.count() == 2605 and got.where("idx % 384 != 0").count() == 0
