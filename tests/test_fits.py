"""The fits against brute force: scans of the error, scores that vanish, and degenerate samples."""

import math

import numpy as np
import pandas as pd
import pytest
import reference_fits
from pyspark.sql import functions as F

from tideflow.functions import numerics, scalar
from tideflow.operators import events, garch, nulls, surface
from tideflow.plans import catalogue

SF = "/root/testdata/sf0.01"


def omori_error(x, u, y):
    return ((x[0] + x[1] * (1 + u) ** -x[2] - y) ** 2).sum()


@pytest.mark.parametrize("seed", range(4))
def test_omori_is_the_least_error(seed):
    rng = np.random.default_rng(seed)
    u = np.arange(1.0, 61)
    y = 0.8 + 2 * (1 + u) ** -rng.uniform(0.2, 2) + rng.normal(0, 0.05, 60)
    got = numerics.fit_omori(y)
    best = omori_error((got["m_inf"], got["c"], got["p"]), u, y)
    for p in np.linspace(0.05, 3, 400):
        for m in np.linspace(0, y.max(), 60):
            f = (1 + u) ** -p
            c = np.clip((f @ (y - m)) / (f @ f), 1e-4, 1e4)
            assert best <= omori_error((m, c, p), u, y) + 1e-9
    assert numerics.fit_omori(y[:11]) is None and numerics.fit_omori(np.full(30, np.nan)) is None
    flat = numerics.fit_omori(np.ones(20))
    assert flat is not None and np.isfinite(flat["p"])


@pytest.mark.parametrize("tau,beta", [(8, 0.6), (3, 1.0), (20, 1.5)])
def test_stretched_exponential_is_the_least_error(tau, beta):
    t = np.arange(0.0, 41)
    y = 0.9 * np.exp(-((t / tau) ** beta)) + np.random.default_rng(1).normal(0, 0.02, 41)
    got = numerics.fit_stretched_exp(t, y)  # lag 0 takes no part
    error = lambda a, s, b: ((np.exp(a - np.exp(b * (np.log(t[1:]) - s))) - y[1:]) ** 2).sum()
    best = error(got["log_a"], got["log_tau_c"], got["beta"])
    for s in np.linspace(np.log(0.3), np.log(400), 60):
        for b in np.linspace(0.1, 2, 40):
            for a in np.log(np.linspace(0.5, 1.5, 21)):
                assert best <= error(a, s, b) + 1e-9
    assert abs(np.exp(got["log_tau_c"]) - tau) < 0.25 * tau and got["converged"]
    assert numerics.fit_stretched_exp(t[:8], y[:8]) is None


def test_garch_score_vanishes():
    rng, v, r = np.random.default_rng(8), 1e-4, []
    for _ in range(3000):
        x = np.sqrt(v) * rng.normal()
        r.append(x)
        v = 5e-6 + 0.08 * x * x + 0.87 * v
    r = np.array(r)
    g = reference_fits.fit_garch11(r)

    def loop(omega, alpha, beta):
        var, out = omega / (1 - alpha - beta), 0.0
        for x in r * 100:
            out += 0.5 * (math.log(2 * math.pi * var) + x * x / var)
            var = omega + alpha * x * x + beta * var
        return out

    at = np.array([g["omega"] * 1e4, g["alpha"], g["beta"]])
    assert abs(loop(*at) - g["nll"]) < 1e-6 * abs(g["nll"])
    for k in range(3):
        for sign in (-1, 1):
            near = at.copy()
            near[k] *= 1 + sign * 0.02
            assert loop(*near) >= loop(*at) - 1e-6


def test_logistic_score_vanishes_and_guards():
    rng = np.random.default_rng(2)
    x = np.stack([np.ones(2000), rng.normal(size=2000), rng.normal(size=2000)], 1)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(x @ [0.3, -1.0, 0.5])))).astype(float)
    b = reference_fits.logistic_fit(x, y)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ b))) - reference_fits.RIDGE * b).max() < 1e-6
    apart = reference_fits.logistic_fit(np.stack([np.ones(40), np.arange(40.0)], 1), (np.arange(40) > 19).astype(float))
    assert apart is None or np.isfinite(apart).all()
    same = reference_fits.logistic_fit(np.ones((40, 2)), (np.arange(40) > 9).astype(float))
    assert same is None or np.isfinite(same).all()
    assert reference_fits.logistic_fit(np.full((40, 1), np.nan), np.zeros(40)) is None


def test_erfc(spark):
    xs = [0.0, 1e-9, 0.1, 0.5, 1.0, 1.9, 2.4999, 2.5, 2.6, 3.7, 5.0, 8.0, 20.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", scalar.erfc(F.col("x")).alias("y")).collect()
    for r in got:
        assert abs(r["y"] - math.erfc(r["x"])) <= 1e-15 + 1e-12 * math.erfc(r["x"])


def test_hours_left_over_have_no_bin(spark):
    got = [r["b"] for r in spark.range(24).select(scalar.phase_bin(F.col("id"), 5).alias("b")).collect()]
    assert got == [h // 4 if h < 20 else None for h in range(24)]


def test_fits_of_queries_are_those_of_numpy(spark):
    mean = events.ensemble_mean(catalogue._field(spark, SF)).toPandas().sort_values("u")
    got, want = catalogue.queries()["omori_fit"](spark, SF).first(), numerics.fit_omori(mean.m.to_numpy())
    assert all(abs(got[k] - want[k]) < 2e-3 for k in ("p", "m_inf", "n"))
    prof = surface.mean_profile(catalogue._surface(spark, SF)).toPandas().sort_values("lag")
    got, want = catalogue.queries()["kww_fit"](spark, SF).first(), numerics.fit_stretched_exp(prof.lag.to_numpy(), prof.rho_mean.to_numpy())
    assert all(abs(got[k] - want[k]) < 1e-3 * (1 + abs(want[k])) for k in ("log_a", "beta", "r2"))
    r = catalogue._r(spark, SF).toPandas().sort_values("idx").r.to_numpy()
    got, want = catalogue.queries()["garch_mle"](spark, SF).first(), reference_fits.fit_garch11(r)
    assert all(abs(got[k] - want[k]) < 1e-3 * (1 + abs(want[k])) for k in ("alpha", "beta", "nll"))


def test_trajectory_has_a_row_for_each_window(spark):
    s = surface.two_time_surface(catalogue._r(spark, SF), catalogue.WINDOW, catalogue.SURFACE_LAGS, 100).toPandas()
    got = {r["t_w"]: r for r in catalogue.queries()["transient_trajectory"](spark, SF).collect()}
    assert set(got) == set(s.t_w)
    for t, g in s.groupby("t_w"):
        g = g.sort_values("lag")
        want = numerics.fit_stretched_exp(g.lag.to_numpy(), g.rho.to_numpy(float))
        assert got[t]["converged"] == want["converged"] and abs((got[t]["r2"] or 0) - want["r2"]) < 1e-5


def test_random_event_null_is_the_trend_of_each_draw(spark):
    got = {r["draw"]: r["spearman"] for r in catalogue.queries()["random_event_null"](spark, SF).collect()}
    base = catalogue._base(spark, SF)
    n = catalogue._shocks(spark, SF).groupBy("series").agg(F.count("*").alias("n"))
    places = nulls.random_events(base, n, 5, catalogue.SEED, catalogue.DISTANCE, 60, 50)
    for draw in (1, 4):
        field = events.post_shock_field(base, places.where(F.col("draw") == draw).select("series", "idx"), catalogue.U_MAX)
        tau = surface.truncated_sum(events.age_correlation(field, catalogue.AGE_EDGES, catalogue.AGE_LAGS, 5), ["series", "age_bin"]).toPandas()
        tau = tau.dropna()
        assert abs(got[draw] - pd.Series(tau.age_bin.to_numpy()).corr(pd.Series(tau.tau.to_numpy()), method="pearson") if len(tau) < 3 else got[draw] - pd.Series(tau.age_bin).rank().corr(pd.Series(tau.tau).rank())) < 1e-5


def test_logistic_of_many_series_in_the_same_rounds(spark):
    """Newton steps by aggregation against numpy; classes apart, one class, missing rows, copies of a feature."""
    from tideflow.operators.logit import fit_logistic

    rng = np.random.default_rng(8)
    parts, want = [], {}
    for k, n in enumerate((300, 1000, 60)):
        x = rng.normal(size=(n, 2)) * (1, 3)
        y = (rng.random(n) < 1 / (1 + np.exp(-(0.3 * k - 0.5 + x @ (1.2, -0.4))))).astype(float)
        parts.append(pd.DataFrame({"series": f"s{k}", "y": y, "u": x[:, 0], "v": x[:, 1]}))
        want[f"s{k}"] = reference_fits.logistic_fit(np.column_stack([np.ones(n), x]), y)
    t = np.arange(40.0)
    parts += [pd.DataFrame({"series": "apart", "y": (t > 19).astype(float), "u": t, "v": 0.0}), pd.DataFrame({"series": "one", "y": 1.0, "u": t, "v": t}), pd.DataFrame({"series": "few", "y": [0.0, 1.0], "u": 1.0, "v": 2.0})]
    want["apart"] = reference_fits.logistic_fit(np.column_stack([np.ones(40), t, np.zeros(40)]), (t > 19).astype(float))
    bad = pd.DataFrame({"series": "s0", "y": [1.0, np.nan, 0.0], "u": [np.nan, 1.0, np.inf], "v": 1.0})
    d = spark.createDataFrame(pd.concat([*parts, bad]), "series string, y double, u double, v double").repartition(6)
    got = {r["series"]: r for r in fit_logistic(d, "y", ["u", "v"], least=10).collect()}
    assert set(got) == set(want)
    for s, b in want.items():
        assert np.allclose(got[s]["b"], b, rtol=1e-8 if s != "apart" else 1e-3, atol=1e-8), s
        assert np.isfinite(got[s]["b"]).all()
    assert got["s0"]["n"] == 300
    one = fit_logistic(d.where("series = 's1'"), "y", ["u"]).first()
    x = parts[1]
    assert np.allclose(one["b"], reference_fits.logistic_fit(np.column_stack([np.ones(1000), x["u"]]), x["y"].to_numpy()), atol=1e-8)
    with pytest.raises(ValueError):
        fit_logistic(d, "y", ["u", "v", "u"])


def test_garch_fit_by_blocks_is_that_of_one_series(spark):
    """Several series in the same rounds, blocks far shorter than a series, gaps, and samples that have no fit."""
    rng, v, r = np.random.default_rng(8), 1e-4, []
    for _ in range(1500):
        x = np.sqrt(v) * rng.normal()
        r.append(x)
        v = 5e-6 + 0.08 * x * x + 0.87 * v
    calm = rng.normal(0, 0.01, 700)
    calm[[5, 300]] = np.nan
    samples = {"garch": np.array(r), "calm": calm, "short": np.full(99, 0.1), "still": np.zeros(200)}
    rows = [(s, i, float(x)) for s, xs in samples.items() for i, x in enumerate(xs)]
    d = spark.createDataFrame(rows, "series string, idx long, r double")
    got = {g["series"]: g for g in garch.fit_garch(d, block=32).collect()}
    assert set(got) == {"garch", "calm"}
    for s, g in got.items():
        want = reference_fits.fit_garch11(samples[s][np.isfinite(samples[s])])
        assert all(abs(g[k] - want[k]) < 1e-5 for k in ("alpha", "beta", "persistence")) and abs(g["omega"] / want["omega"] - 1) < 1e-4
        assert g["nll"] <= want["nll"] + 1e-7 and g["score"] * len(samples[s]) < 1e-6
    assert garch.fit_garch(d.where("false")).count() == 0


def test_garch_derivatives_are_those_of_the_likelihood():
    x = np.random.default_rng(3).exponential(1, 40)
    z = np.array([0.1, 1.5, -1.0])

    def sums(z, blocks=(40,)):
        points, at, out, before = [[z.tolist()]], 0, np.zeros(10), np.array([1.0] + [0.0] * 9)
        for n in blocks:
            part = pd.DataFrame({"series": ["s"], "block": [0], "r2": [x[at : at + n]], "points": points, "before": [[before.tolist()]]})
            out += next(garch._sums(iter([part]))).filter(like="s").drop(columns="series").to_numpy()[0]
            own = next(garch._heads(iter([part])))[garch.NAMES].to_numpy()[0]
            before = np.array(list(garch._then(dict(zip(garch.NAMES, before)), dict(zip(garch.NAMES, own))).values()))
            at += n
        return out

    np.testing.assert_allclose(sums(z, (7, 1, 20, 12)), sums(z), rtol=1e-11)
    g, h = garch._in_search(z, sums(z))
    e = 1e-5
    for k in range(3):
        up, down = z + e * (np.arange(3) == k), z - e * (np.arange(3) == k)
        assert abs((sums(up)[0] - sums(down)[0]) / (2 * e) - g[k]) < 1e-6
        np.testing.assert_allclose((garch._in_search(up, sums(up))[0] - garch._in_search(down, sums(down))[0]) / (2 * e), h[k], rtol=1e-5, atol=1e-6)
