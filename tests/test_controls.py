"""Positive and negative controls on synthetic series whose answer is known."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideflow.functions import numerics
from tideflow.operators import blocks, events, fits, garch, lagcorr, nulls, phase, surface, symmetry, vol, wavelet


def series(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame(pd.DataFrame({"series": "s", "idx": np.arange(n), **cols}))


def test_gaussian_affinity_is_two_mu_over_variance(spark):
    x = np.random.default_rng(0).normal(0.15, 1, 200_000)
    q = blocks.net_charge(series(spark, x=x), [1])
    fit = symmetry.fit_affinity(symmetry.symmetry_function(q, ["series"]), ["series"]).first()
    assert abs(fit["a"] - 0.3) < 4 * fit["se_a"] + 0.01
    assert abs(fit["c3"]) < 4 * fit["se_c3"]
    g = blocks.gaussian_affinity(series(spark, x=x), [1]).first()
    assert abs(g["a_gauss"] - 0.3) < 0.02


def test_cumulant_slope_follows_memory(spark):
    x = numerics.synthetic_flow(1 << 17, -0.5, seed=3)
    grid = (8, 16, 32, 64, 128)
    s = blocks.cumulant_slopes(blocks.cumulants(series(spark, x=x), grid)).first()
    assert abs(s["slope_k2"] - 1.5) < 0.12
    drawn = nulls.as_series(nulls.permutation(series(spark, x=x), 1, 5))
    null = nulls.of_series(blocks.cumulant_slopes(blocks.cumulants(drawn, grid))).where("draw = 1").first()
    assert abs(null["slope_k2"] - 1) < 0.1


def test_fano_of_independent_trades_is_one(spark):
    rng = np.random.default_rng(1)
    flow = 2 * (2 * rng.binomial(20, 0.5, 50_000) - 20.0)
    d = series(spark, flow=flow, volume=np.full(50_000, 40.0), trades=np.full(50_000, 20.0))
    for r in blocks.fano(d, [1, 4, 16]).collect():
        assert abs(r["fano"] - 1) < 0.1 and r["q_bar"] == 2


@pytest.mark.parametrize("length", [2, 4, 6, 8])
def test_filters_are_orthonormal_with_vanishing_moments(length):
    h, g = map(np.array, wavelet.filters(length))
    assert abs(h.sum() - 2**0.5) < 1e-9 and abs((h * h).sum() - 1) < 1e-9 and abs((h * g).sum()) < 1e-9
    for m in range(length // 2):
        assert abs((g * np.arange(length) ** m).sum()) < 1e-6
    for shift in range(2, length, 2):
        assert abs((h[shift:] * h[:-shift]).sum()) < 1e-9


def test_wavelet_exponent_of_fractional_noise_and_trend_immunity(spark):
    x = numerics.fractional_noise(1 << 15, 0.7, seed=7)
    d = series(spark, x=x)
    fit = lambda df: wavelet.gamma_wavelet(wavelet.log_scale_diagram(wavelet.decompose(df, 6)), 3).first()
    clean, ramp = fit(d), fit(nulls.drift(d, 5.0))
    assert abs(clean["hurst"] - 0.7) < 0.06
    assert abs(clean["gamma"] - ramp["gamma"]) < 0.02


def test_decompose_equals_literal_loop(spark):
    x = np.random.default_rng(2).normal(size=101)
    h, g = map(np.array, wavelet.filters(6))
    a, want = x - x.mean(), {}
    for j in range(1, int(np.log2(101 / 12)) + 1):
        n = len(a)
        y = {f: np.array([sum(a[(2 * k + m) % n] * c[5 - m] for m in range(6)) for k in range((n + 1) // 2)]) for f, c in (("a", h), ("d", g))}
        b = min(5, max(len(y["d"]) // 4, 1))
        want[j] = y["d"][b : len(y["d"]) - b] if len(y["d"]) > 2 * b else y["d"]
        a = y["a"]
    got = wavelet.decompose(series(spark, x=x), 6).toPandas()
    for j, d in want.items():
        np.testing.assert_allclose(np.sort(got[got.octave == j].d), np.sort(d), atol=1e-9)


def test_lag_operators_equal_literal_loop_across_blocks(spark):
    rng = np.random.default_rng(4)
    p, e = np.cumsum(rng.normal(0, 0.01, 400)), rng.normal(0, 0.2, 400)
    p[17], e[33], e[300] = np.nan, np.nan, np.nan
    d = series(spark, p=p, e=e)
    ec = e - np.nanmean(e)
    var = np.nanmean(ec * ec)
    for block in (1 << 16, 64):
        r = {x["lag"]: x["r"] for x in lagcorr.response_function(d, 12, block).collect()}
        c = {x["lag"]: x["c"] for x in lagcorr.flow_autocorrelation(d, 12, block=block).collect()}
        for k in range(1, 13):
            assert abs(r[k] - np.nanmean((p[k:] - p[:-k]) * ec[:-k]) / var) < 1e-10
            assert abs(c[k] - np.nanmean(ec[k:] * ec[:-k]) / var) < 1e-10


def test_surface_equals_direct_windows(spark):
    r = np.random.default_rng(5).normal(size=120)
    s = surface.two_time_surface(series(spark, r=r), 40, 8, 7).toPandas()
    a = np.abs(r)
    for row in s.itertuples():
        w = a[row.t_w - 39 : row.t_w + 1]
        w = w - w.mean()
        assert abs(row.rho - (w[: -row.lag] * w[row.lag :]).sum() / (w * w).sum()) < 1e-10


def test_recursions_equal_loops(spark):
    r = np.random.default_rng(6).normal(0, 0.01, 300)
    r[40] = np.nan
    got = vol.ewma_vol(series(spark, r=r)).orderBy("idx").toPandas()
    v = [np.nanvar(r[:50])]
    for x in r[:-1]:
        v.append(0.94 * v[-1] + 0.06 * (x * x if x == x else 0))
    np.testing.assert_allclose(got.sigma, np.sqrt(v), rtol=1e-12)


def test_garch_recovers_persistence(spark):
    rng, v, r = np.random.default_rng(8), 1e-4, []
    for _ in range(4000):
        x = np.sqrt(v) * rng.normal()
        r.append(x)
        v = 5e-6 + 0.08 * x * x + 0.87 * v
    g = garch.fit_garch(series(spark, r=np.array(r))).first()
    assert abs(g["persistence"] - 0.95) < 0.05 and abs(g["alpha"] - 0.08) < 0.04
    path = vol.garch_path(series(spark, r=np.array(r)), spark.createDataFrame([("s", g["omega"], g["alpha"], g["beta"])], "series string, omega double, alpha double, beta double"))
    assert path.where("sigma > 0").count() == 4000


def test_stretched_exponential_and_omori_are_recovered(spark):
    lags = np.arange(1, 61)
    prof = spark.createDataFrame(pd.DataFrame({"series": "s", "lag": lags, "rho": 0.8 * np.exp(-((lags / 8.0) ** 0.6))}))
    k = fits.fit_profile(prof).first()
    assert k["valid"] and abs(np.exp(k["log_tau_c"]) - 8) < 1e-3 and abs(k["beta"] - 0.6) < 1e-4
    u = np.arange(1, 301)
    m = spark.createDataFrame(pd.DataFrame({"series": "s", "u": u, "m": 0.8 + 3 * (1.0 + u) ** -0.3}))
    o = fits.omori(m).first()
    assert abs(o["p"] - 0.3) < 1e-4 and abs(o["m_inf"] - 0.8) < 1e-3


def test_planted_ageing_raises_correlation_time(spark):
    rng = np.random.default_rng(9)
    rows = []
    for shock in range(120):
        z = rng.normal()
        for u in range(1, 121):
            rows.append(("s", shock, u, 1 + 0.3 * z))
            a = np.exp(-1 / (2 + u / 8))
            z = a * z + np.sqrt(1 - a * a) * rng.normal()
    field = spark.createDataFrame(pd.DataFrame(rows, columns=["series", "shock", "u", "w"]))
    tau = surface.truncated_sum(events.age_correlation(field, [0, 15, 30, 60, 90], 20), ["series", "age_bin"])
    assert events.spearman(tau, ["series"], "age_bin", "tau").first()["spearman"] > 0.7


def test_planted_shocks_are_separated(spark):
    r = np.random.default_rng(10).normal(0, 0.01, 5000)
    r[[1000, 1005, 2500, 4000]] = 0.5
    d = series(spark, r=r, sigma=np.full(5000, 0.01))
    c = events.shock_candidates(d, 0.9993, 300, 200)
    assert {1000, 2500, 4000} <= {x["idx"] for x in events.separate(c, 384).collect()}
    assert 1005 not in {x["idx"] for x in events.separate(c, 384).collect()}


def test_planted_phase_modulation_beats_rotation(spark):
    rng, days = np.random.default_rng(11), 250
    hour = np.tile(np.arange(24), days)
    e = 0.15 * np.sin(2 * np.pi * hour / 24) + rng.normal(0, 0.3, 24 * days)
    day = np.repeat(pd.date_range("2024-01-01", periods=days).date, 24)
    d = series(spark, day=day, hour=hour.astype("int32"), e=e, p=np.cumsum(rng.normal(0, 0.01, 24 * days)), raw=e, volume=np.ones(24 * days), trades=np.ones(24 * days))
    t = phase.modulation(phase.observables(phase.rotate_days(phase.prepare(d), 30, 1), ["series", "draw"]), ["series", "draw"])
    p = {r["observable"]: r["p"] for r in phase.empirical_p(t, ["series", "observable"], "modulation").collect()}
    assert p["bias"] < 0.05
    sums = phase.additive_observables(phase.rotate_days(phase.hour_moments(phase.prepare(d)), 30, 1), ["series", "draw"])
    fast = {(r["draw"], r["observable"]): r["modulation"] for r in phase.modulation(sums, ["series", "draw"]).collect()}
    for r in t.where("observable != 'a1'").collect():
        assert (r["modulation"] is None) == (fast[r["draw"], r["observable"]] is None)
        assert r["modulation"] is None or abs(r["modulation"] - fast[r["draw"], r["observable"]]) < 1e-9


def test_max_t(spark):
    rng = np.random.default_rng(12)
    rows = [(d, f"c{c}", float(rng.normal())) for d in range(1, 51) for c in range(6)] + [(0, f"c{c}", v) for c, v in enumerate((9.0, 1.0, 0.0, -1.0, 0.5))] + [(0, "c5", None)]
    cells = spark.createDataFrame(rows, "draw long, cell string, stat double")
    p = {r["cell"]: r["p"] for r in nulls.max_t(cells).collect()}
    assert p["c0"] == 1 / 51 and "c5" not in p and p["c0"] <= p["c1"] <= p["c4"] <= p["c2"] <= p["c3"]
    with pytest.raises(ValueError):
        nulls.max_t(cells.where("draw = 0"))
    with pytest.raises(ValueError):
        nulls.max_t(cells.where("draw > 0"))


def test_bootstrap_weights_sum_to_units(spark):
    f = spark.range(30).select(F.lit("s").alias("series"), F.col("id").alias("shock"))
    w = nulls.bootstrap_weights(f, 5, 3).groupBy("draw").agg(F.sum("weight").alias("n")).collect()
    assert {r["n"] for r in w} == {30} and len(w) == 6


def greedy_places(seed, draw, name, rows, n, distance, after, before):
    """Places one after the other in the order of their random numbers."""
    u = {i: int(hashlib.md5(f"{seed}:{draw}:{name}:{i}".encode()).hexdigest()[:8], 16) for i in range(before, rows - after)}
    taken = []
    for i in sorted(u, key=lambda i: (u[i], i)):
        if len(taken) < n and all(abs(i - t) >= distance for t in taken):
            taken.append(i)
    return sorted(taken)


@pytest.mark.parametrize("distance,after,before", [(1, 0, 0), (7, 5, 3), (40, 10, 20)])
def test_random_events_are_those_of_a_loop(spark, distance, after, before, monkeypatch):
    """Few of much room (draws that look at early places only), as many as fit, more than fit, and series with no room or no count."""
    monkeypatch.setattr(nulls, "BLOCK", 64)
    sizes = {"wide": (3000, 6), "full": (500, 500), "tight": (300, 7), "none": (12, 3), "zero": (100, 0), "one": (after + before + 1, 1)}
    d = spark.createDataFrame([(s, i) for s, (rows, _) in sizes.items() for i in range(rows)], "series string, idx long")
    counts = spark.createDataFrame([(s, n) for s, (_, n) in sizes.items()], "series string, n long")
    got = nulls.random_events(d, counts, 3, 5, distance, after, before).toPandas()
    for s, (rows, n) in sizes.items():
        for draw in (1, 2, 3):
            mine = sorted(got[(got.series == s) & (got.draw == draw)].idx)
            assert mine == greedy_places(5, draw, s, rows, n, distance, after, before), (s, draw)
    assert nulls.random_events(d, counts.where("false"), 2, 5).count() == 0


def test_random_events_that_run_short_look_further(spark, monkeypatch):
    """Where a first look finds too few, the next ones give what a look at all places gives."""
    monkeypatch.setattr(nulls, "FIRST_LOOK", (0.1, 1))
    d = spark.range(4000).select(F.lit("s").alias("series"), F.col("id").alias("idx"))
    counts = spark.createDataFrame([("s", 30)], "series string, n long")
    got = nulls.random_events(d, counts, 2, 9, 20, 0, 0).toPandas()
    for draw in (1, 2):
        assert sorted(got[got.draw == draw].idx) == greedy_places(9, draw, "s", 4000, 30, 20, 0, 0)
