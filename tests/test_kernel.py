"""The two-component kernel: planted exponents come back, brute force over the same grid, and what has no fit."""

import numpy as np
import pandas as pd

from tideflow.operators import kernel


def curve(spark, **series):
    rows = [(k, lag, None if np.isnan(c) else float(c)) for k, v in series.items() for lag, c in enumerate(v, 1)]
    return spark.createDataFrame(rows, "series string, lag int, c double")


def planted(lags, af, a, sf, s):
    t = np.arange(1, lags + 1.0)
    return af * t**-a + sf * t**-s


def test_planted_pairs_are_found(spark):
    want = {"u": (0.3, 1.4, 0.1, 0.32), "v": (0.05, 2.2, 0.2, 0.5), "w": (0.4, 0.9, -0.1, 0.2)}
    got = {r["series"]: r for r in kernel.two_component(curve(spark, **{k: planted(80, *v) for k, v in want.items()})).collect()}
    assert got.keys() == want.keys()
    for k, (af, a, sf, s) in want.items():
        r = got[k]
        assert abs(r["a_fast"] - a) < 1.01 / kernel.UNITS and abs(r["a_slow"] - s) < 1.01 / kernel.UNITS
        assert abs(r["amp_fast"] - af) < 0.01 and abs(r["amp_slow"] - sf) < 0.01 and r["r2"] > 0.999999 and r["n"] == 80


def test_equals_least_squares_of_numpy(spark):
    rng = np.random.default_rng(0)
    c = planted(40, 0.3, 1.2, 0.1, 0.3) + rng.normal(0, 0.005, 40)
    t = np.arange(1, 41.0)

    def fit(f, s):
        x = np.column_stack([t ** (-f / kernel.UNITS), t ** (-s / kernel.UNITS)])
        b, *_ = np.linalg.lstsq(x, c, rcond=None)
        return float(((c - x @ b) ** 2).sum()), f, s, *b

    best = min(fit(f, s) for f in range(125, 3751, 125) for s in range(125, f, 125))
    for step, reach in ((25, 125), (5, 25), (1, 5)):
        around = lambda v: range(v - reach, v + reach + 1, step)  # noqa: B023, E731
        best = min(fit(f, s) for f in around(best[1]) for s in around(best[2]) if s > 0 and f - s >= kernel.GAP)
    r = kernel.two_component(curve(spark, s=c)).first()
    assert (round(r["a_fast"] * kernel.UNITS), round(r["a_slow"] * kernel.UNITS)) == best[1:3]
    assert abs(r["amp_fast"] - best[3]) < 1e-8 and abs(r["amp_slow"] - best[4]) < 1e-8
    assert abs(r["r2"] - (1 - best[0] / ((c - c.mean()) ** 2).sum())) < 1e-9


def test_short_constant_and_missing(spark):
    c = planted(30, 0.3, 1.5, 0.1, 0.4)
    holes = np.where(np.arange(30) % 3 == 1, np.nan, c)
    got = {r["series"]: r for r in kernel.two_component(curve(spark, short=c[:5], flat=np.full(20, 0.5), zero=np.zeros(20), holes=holes)).collect()}
    assert got.keys() == {"flat", "zero", "holes"}
    assert got["flat"]["r2"] is None or abs(got["flat"]["r2"]) < 1e9
    assert got["zero"]["amp_fast"] == got["zero"]["amp_slow"] == 0 and got["zero"]["r2"] is None
    assert got["holes"]["n"] == 20 and abs(got["holes"]["a_fast"] - 1.5) < 1.01 / kernel.UNITS
    assert kernel.two_component(curve(spark, short=c[:5])).collect() == []
    lags = kernel.two_component(curve(spark, s=c), 3, 20).first()
    assert lags["n"] == 18 and abs(lags["a_slow"] - 0.4) < 1.01 / kernel.UNITS


def test_temperature_follows_from_the_exponents(spark):
    fit = kernel.two_component(curve(spark, s=planted(60, 0.3, 1.4, 0.1, 0.32)))
    response = spark.createDataFrame(pd.DataFrame({"series": "s", "lag": [1, 2, 10, 11], "r": [0.5, 0.25, -0.1, 0.0]}))
    got = {r["lag"]: r["t_eff"] for r in kernel.kernel_temperature(fit, response).collect()}
    t = np.array([1, 2, 10.0])
    want = (0.3 * 1.4 * t**-2.4 + 0.1 * 0.32 * t**-1.32) / np.array([0.5, 0.25, -0.1])
    assert got[11] is None and all(abs(got[int(k)] - w) < 2e-3 * abs(w) for k, w in zip(t, want))
