"""Features must not move when the future does; labels must."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tideflow.operators import evaluation, flow, lagcorr, surface, vol


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"series": "s", "idx": np.arange(n), **cols}))


def rows(df, key, value, upto):
    return {r[key]: r[value] for r in df.where(F.col(key) <= upto).collect()}


@pytest.fixture(scope="module")
def returns():
    return np.random.default_rng(0).normal(0, 0.01, 300)


def changed(x, at):
    y = x.copy()
    y[at + 1 :] *= 7
    return y


def test_surface_tti_and_ewma_are_causal(spark, returns):
    for f, key, value in (
        (lambda d: surface.correlation_time(surface.two_time_surface(d, 40, 8)), "t_w", "tau"),
        (lambda d: surface.tti_breaking(surface.two_time_surface(d, 40, 8)), "t_w", "distance"),
        (lambda d: vol.ewma_vol(d), "idx", "sigma"),
    ):
        a, b = (rows(f(frame(spark, r=x)), key, value, 200) for x in (returns, changed(returns, 200)))
        assert a.keys() == b.keys()
        for k in a:
            assert a[k] == b[k] or abs(a[k] - b[k]) < 1e-9


def test_full_reference_and_label_see_the_future(spark, returns):
    for f, key, value in (
        (lambda d: surface.tti_breaking(surface.two_time_surface(d, 40, 8), "full"), "t_w", "distance"),
        (lambda d: vol.realized_vol_forward(d, 5), "idx", "rv"),
    ):
        a, b = (rows(f(frame(spark, r=x)), key, value, 200) for x in (returns, changed(returns, 200)))
        assert any(a[k] is not None and b[k] is not None and abs(a[k] - b[k]) > 1e-9 for k in a)


def test_rolling_fdt_is_causal(spark):
    rng = np.random.default_rng(1)
    p, e = np.cumsum(rng.normal(0, 0.01, 260)), rng.normal(0, 0.2, 260)
    f = lambda p, e: rows(lagcorr.rolling_fdt(frame(spark, p=p, e=e), 120, 8, 20), "t_w", "fdt_violation", 200)
    a, b = f(p, e), f(changed(p, 200), changed(e, 200))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_alignment_drops_the_first_bar(spark):
    bars = frame(spark, close=np.ones(10))
    feat = spark.createDataFrame([("s", 3, 1.0), ("s", 6, 2.0), ("s", 8, None)], "series string, t_w long, v double")
    got = {r["idx"]: r["v"] for r in flow.align_to_returns(feat, bars).collect()}
    assert got == {0: None, 1: None, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0, 6: 2.0, 7: 2.0, 8: 2.0}


def test_embargo_keeps_labels_out_of_sample(spark, returns):
    d = evaluation.embargo(frame(spark, r=returns), 5)
    assert d.where("train").agg(F.max("idx")).first()[0] + 5 < d.where("oos").agg(F.min("idx")).first()[0]


def test_horizon_one_label_is_missing(spark, returns):
    assert vol.realized_vol_forward(frame(spark, r=returns), 1).where("rv IS NOT NULL").count() == 0


def test_cheating_feature_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(3)
    n, v = 3000, np.zeros(3000)
    for t in range(1, n):
        v[t] = 0.95 * v[t - 1] + 0.3 * rng.normal()
    r = np.exp(v) * 0.01 * rng.normal(size=n)
    future = np.array([v[t + 1 : t + 6].mean() if t + 6 < n else 0.0 for t in range(n)])
    base = vol.ewma_vol(frame(spark, r=r))
    good = evaluation.feature_contrast(base, frame(spark, v=np.exp(future)), 5).first()
    assert good["dm_decisive"] > 3 and good["coef_x"] > 0
    noise = evaluation.feature_contrast(base, frame(spark, v=np.exp(rng.normal(size=n))), 5).first()
    assert abs(noise["dm_decisive"]) < 3
    t = evaluation.transition_contrast(base, frame(spark, v=np.exp(future)), 5).first()
    assert t["coef_x"] > 0 and t["dm"] > 2 and t["p"] < 0.05
