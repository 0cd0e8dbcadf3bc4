"""Registered queries of the time-series operators, each with the SQL that must give the same rows.

Doubles are rounded to six places in both, since sums depend on the order of their terms.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.functions.scalar import volatility_field
from tideflow.functions.series import cut
from tideflow.operators import blocks, evaluation, events, fits, flow, garch, kernel, lagcorr, memory, nulls, phase, surface, symmetry, vol, wavelet
from tideflow.plans import oracle
from tideflow.sources import bars

GRID = (1, 2, 4, 8, 16, 32, 64)
LAGS = 20
WINDOW, SURFACE_LAGS = 250, 10
HORIZON = 5
GARCH = (2e-6, 0.05, 0.90)
SHOCKS = {"quantile": 0.97, "after": 60, "before": 50}
DISTANCE, U_MAX = 60, 40
AGE_EDGES, AGE_LAGS = (0, 5, 10, 20, 30), 10
DRAWS, SEED = 20, 7
HOURLY_LEAST = 50
SCALES = (8, 16, 32, 64, 128)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = lambda spark, sf_dir: _rounded(f(spark, sf_dir))
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.SQL.items() if k in _QUERIES}


def _ld(spark, d):
    return bars.daily_bars(_read(spark, d, "lineitem"))


def _eh(spark, d):
    return bars.hourly_bars(_read(spark, d, "events"))


def _ev(spark, d):
    return bars.event_bars(_read(spark, d, "events"))


def _x(spark, d):
    return flow.imbalance(_ld(spark, d))


def _pf(spark, d):
    return flow.price_and_flow(_ld(spark, d))


def _r(spark, d):
    return flow.log_returns(_ld(spark, d))


def _acf(spark, d):
    return lagcorr.flow_autocorrelation(_pf(spark, d), LAGS)


def _resp(spark, d):
    return lagcorr.response_function(_pf(spark, d), LAGS)


def _teff(spark, d):
    return lagcorr.effective_temperature(_resp(spark, d), _acf(spark, d))


def _surface(spark, d):
    return surface.two_time_surface(_r(spark, d), WINDOW, SURFACE_LAGS)


def _base(spark, d):
    return cut(vol.ewma_vol(_r(spark, d)))  # a recursion in Python, which most users read several times


def _sym(spark, d):
    return symmetry.symmetry_function(blocks.net_charge(_x(spark, d), [1]), ["series", "T"])


def _phase(spark, d):
    e = _ev(spark, d)
    return phase.prepare(e.select("series", "idx", "day", "hour", F.col("flow").alias("e"), F.col("price").alias("p"), F.col("flow").alias("raw"), "volume", "trades"))


def _candidates(spark, d):
    return events.shock_candidates(_base(spark, d), **SHOCKS)


def _shocks(spark, d):
    return events.separate(_candidates(spark, d), DISTANCE)


def _field(spark, d):
    base = _base(spark, d)
    shocks = events.separate(events.shock_candidates(base, **SHOCKS), DISTANCE)
    return cut(events.post_shock_field(base, shocks, U_MAX))


def _age(spark, d):
    return cut(events.age_correlation(_field(spark, d), AGE_EDGES, AGE_LAGS, 5))


# bars and row-local operators


@_query
def bars_hourly(spark, d):
    return _eh(spark, d)


@_query
def bars_daily(spark, d):
    return _ld(spark, d).select("series", "idx", "ts", "open", "close", "volume", "tb_base", "trades")


@_query
def bars_dedup_latest(spark, d):
    t = bars.event_ticks(_read(spark, d, "events")).withColumn("ts", F.date_trunc("HOUR", "ts").cast("timestamp_ntz"))
    return bars.dedup_latest(t, F.col("id")).select("ts", "id", "price")


@_query
def trade_clock_bars(spark, d):
    return bars.trade_clock_bars(bars.event_ticks(_read(spark, d, "events")), 50)


@_query
def flow_imbalance_volume(spark, d):
    return flow.imbalance(_eh(spark, d))


@_query
def flow_imbalance_raw(spark, d):
    return flow.imbalance(_eh(spark, d), "none")


@_query
def log_returns(spark, d):
    return _r(spark, d)


@_query
def volatility_fields(spark, d):
    return _r(spark, d).select("series", "idx", *[volatility_field(F.col("r"), f).alias(f"v_{f}") for f in ("abs", "sq", "raw")])


@_query
def net_charge_grid(spark, d):
    return blocks.net_charge(_x(spark, d), GRID)


@_query
def cumulant_scaling(spark, d):
    return blocks.cumulants(_x(spark, d), GRID)


@_query
def cumulant_slopes(spark, d):
    return blocks.cumulant_slopes(blocks.cumulants(_x(spark, d), GRID))


@_query
def gaussian_affinity(spark, d):
    return blocks.gaussian_affinity(_x(spark, d), GRID)


def _fano(spark, d):
    b = _ld(spark, d).select("series", "idx", (2 * F.col("tb_base") - F.col("volume")).alias("flow"), "volume", "trades")
    return blocks.fano(b, GRID)


@_query
def fano_table(spark, d):
    return _fano(spark, d)


@_query
def fano_slope(spark, d):
    return blocks.fano_slope(_fano(spark, d))


@_query
def symmetry_function(spark, d):
    return _sym(spark, d)


@_query
def affinity_fit(spark, d):
    return symmetry.fit_affinity(_sym(spark, d), ["series", "T"]).select("series", "T", "a", "se_a", "chi2_dof", "n_bins")


@_query
def affinity_cubic(spark, d):
    return symmetry.fit_affinity(_sym(spark, d), ["series", "T"]).select("series", "T", "c3", "se_c3")


@_query
def affinity_by_length(spark, d):
    q = blocks.net_charge(_x(spark, d), [1, 4, 16])
    return symmetry.fit_affinity(symmetry.symmetry_function(q, ["series", "T"], min_count=3), ["series", "T"]).select("series", "T", "a", "se_a", "n_bins")


@_query
def affinity_dilution(spark, d):
    a = symmetry.fit_affinity(symmetry.symmetry_function(blocks.net_charge(_x(spark, d), [1, 16]), ["series", "T"], min_count=3), ["series", "T"])
    return blocks.affinity_dilution(a, blocks.cumulants(_x(spark, d), [1, 16]))


@_query
def tranche_stability(spark, d):
    return blocks.tranches(_x(spark, d), 4)


@_query
def haar_variance(spark, d):
    return blocks.haar_variance(_x(spark, d), GRID)


@_query
def haar_identity(spark, d):
    return wavelet.haar_identity(_x(spark, d), [1, 2, 4, 8])


@_query
def nu_blocks(spark, d):
    return blocks.nu_blocks(_x(spark, d), range(0, 7))


# lag correlations


@_query
def flow_autocorrelation(spark, d):
    return _acf(spark, d)


@_query
def response_function(spark, d):
    return _resp(spark, d)


@_query
def fdt_teff(spark, d):
    return _teff(spark, d).withColumn("t_eff", F.round("t_eff", 3))


@_query
def fdt_violation(spark, d):
    return lagcorr.fdt_violation(_teff(spark, d)).select("series", F.round("fdt_violation", 4).alias("fdt_violation"))


@_query
def rolling_fdt(spark, d):
    return lagcorr.rolling_fdt(_pf(spark, d), 500, LAGS, 250).select("series", "t_w", F.round("fdt_violation", 3).alias("fdt_violation"))


@_query
def rolling_teff(spark, d):
    return lagcorr.rolling_fdt(_pf(spark, d), 500, LAGS, 250).select("series", "t_w", F.round("level", 3).alias("level"))


@_query
def gamma_acf(spark, d):
    return lagcorr.gamma_acf(_acf(spark, d), 4)


@_query
def two_regime_slopes(spark, d):
    return lagcorr.two_regimes(_acf(spark, d), 10, 1, LAGS)


@_query
def deseasonalised_acf(spark, d):
    e = _ev(spark, d).select("series", "idx", "hour", F.col("flow").alias("x"))
    return lagcorr.flow_autocorrelation(lagcorr.deseasonalise(e), LAGS, "x")


@_query
def k2_closure(spark, d):
    pred = lagcorr.k2_from_acf(_pf(spark, d), _acf(spark, d), [1, 2, 4, 8, 16])
    seen = blocks.cumulants(_x(spark, d), [1, 2, 4, 8, 16]).select("series", "T", "k2")
    return pred.join(seen, ["series", "T"]).select("series", "T", "k2", "k2_pred", (F.col("k2") / F.col("k2_pred")).alias("closure"))


@_query
def teff_shape(spark, d):
    return lagcorr.teff_shape(_teff(spark, d), 1, LAGS)


# two-time surfaces


@_query
def rolling_acf_surface(spark, d):
    return _surface(spark, d)


@_query
def mean_profile(spark, d):
    return surface.mean_profile(_surface(spark, d))


@_query
def tti_expanding(spark, d):
    return surface.tti_breaking(_surface(spark, d))


@_query
def tti_full(spark, d):
    return surface.tti_breaking(_surface(spark, d), "full")


@_query
def correlation_time_integral(spark, d):
    return surface.correlation_time(_surface(spark, d))


@_query
def correlation_time_efold(spark, d):
    return surface.correlation_time(_surface(spark, d), "efold")


@_query
def aging_collapse(spark, d):
    s = surface.two_time_surface(_r(spark, d), WINDOW, SURFACE_LAGS, 50)
    return surface.aging_curve(s, [0.0, 0.25, 0.5, 0.75, 1.0])


@_query
def aging_best(spark, d):
    s = surface.two_time_surface(_r(spark, d), WINDOW, SURFACE_LAGS, 50)
    return surface.aging_collapse(s, [0.0, 0.25, 0.5, 0.75, 1.0])


# volatility and evaluation


@_query
def realized_vol_forward(spark, d):
    return vol.realized_vol_forward(_r(spark, d), HORIZON)


@_query
def ewma_vol(spark, d):
    return _base(spark, d)


def _params(spark):
    return spark.createDataFrame([("lineitem", *GARCH)], "series string, omega double, alpha double, beta double")


@_query
def garch_path(spark, d):
    return vol.garch_path(_r(spark, d), _params(spark))


@_query
def garch_mle(spark, d):
    return garch.fit_garch(_r(spark, d)).drop("score", "rounds")


@_query
def embargo_mask(spark, d):
    return evaluation.embargo(_r(spark, d), HORIZON).select("series", "idx", "train", "oos")


@_query
def ffill_align(spark, d):
    s = surface.correlation_time(surface.two_time_surface(_r(spark, d), WINDOW, SURFACE_LAGS, 50))
    return flow.align_to_returns(s.select("series", "t_w", F.col("tau").alias("v")), _ld(spark, d))


@_query
def winsor_standardize(spark, d):
    b = _ld(spark, d).select("series", "idx", F.col("volume").alias("v"))
    return evaluation.standardise(evaluation.embargo(b, HORIZON)).select("series", "idx", "x")


@_query
def qlike_rmse(spark, d):
    return evaluation.losses(_base(spark, d).join(vol.realized_vol_forward(_r(spark, d), HORIZON), ["series", "idx"]))


@_query
def dm_test(spark, d):
    base = _base(spark, d)
    rv = vol.realized_vol_forward(base, HORIZON)
    g = vol.garch_path(base, _params(spark)).select("series", "idx", F.col("sigma").alias("sigma_g"))
    both = base.join(rv, ["series", "idx"]).join(g, ["series", "idx"])
    q = both.select("series", "idx", evaluation.qlike(F.col("rv"), F.col("sigma")).alias("la"), evaluation.qlike(F.col("rv"), F.col("sigma_g")).alias("lb"))
    return evaluation.diebold_mariano(q, HORIZON).select("series", "n", "mean_diff", "dm")


@_query
def dm_pvalue(spark, d):
    base = _base(spark, d)
    both = base.join(vol.realized_vol_forward(base, HORIZON), ["series", "idx"])
    q = both.select("series", "idx", evaluation.qlike(F.col("rv"), F.col("sigma")).alias("la"), evaluation.qlike(F.col("rv"), 1.1 * F.col("sigma")).alias("lb"))
    return evaluation.diebold_mariano(q, HORIZON).select("series", "p")


@_query
def walk_forward_folds(spark, d):
    return evaluation.walk_forward_folds(_r(spark, d), 500, 250)


@_query
def transition_target(spark, d):
    return evaluation.transition_target(_base(spark, d), HORIZON).select("series", "idx", "s", "ratio", "theta")


@_query
def recal_contrast(spark, d):
    v = _ld(spark, d).select("series", "idx", F.col("volume").alias("v"))
    return evaluation.feature_contrast(_base(spark, d), v, HORIZON)


@_query
def logistic_contrast(spark, d):
    v = _ld(spark, d).select("series", "idx", F.col("volume").alias("v"))
    return evaluation.transition_contrast(_base(spark, d), v, HORIZON)


# events


@_query
def shock_candidates(spark, d):
    return _candidates(spark, d)


@_query
def shocks_greedy(spark, d):
    return _shocks(spark, d).select("series", "idx")


@_query
def post_shock_field(spark, d):
    return _field(spark, d)


@_query
def ensemble_mean(spark, d):
    return events.ensemble_mean(_field(spark, d))


@_query
def ensemble_curve(spark, d):
    return events.thinned(events.ensemble_mean(_field(spark, d)), 15)


@_query
def age_correlation(spark, d):
    return _age(spark, d)


@_query
def age_tau_c(spark, d):
    return surface.truncated_sum(_age(spark, d), ["series", "age_bin"])


@_query
def spearman_age(spark, d):
    return events.spearman(surface.truncated_sum(_age(spark, d), ["series", "age_bin"]), ["series"], "age_bin", "tau")


@_query
def omori_fit(spark, d):
    return fits.omori(events.ensemble_mean(_field(spark, d)))


@_query
def kww_fit(spark, d):
    return fits.fit_profile(surface.mean_profile(_surface(spark, d)).withColumnRenamed("rho_mean", "rho"))


@_query
def transient_trajectory(spark, d):
    s = surface.two_time_surface(_r(spark, d), WINDOW, SURFACE_LAGS, 100)
    return fits.rolling_transient_fit(s)


@_query
def bootstrap_ensemble(spark, d):
    return nulls.bootstrap_mean(_field(spark, d), DRAWS, SEED)


@_query
def bootstrap_omori(spark, d):
    return nulls.of_series(fits.omori(nulls.as_series(nulls.bootstrap_mean(_field(spark, d), DRAWS, SEED))))


def _tau_by_draw(spark, d):
    field = _field(spark, d)
    w = nulls.bootstrap_weights(field, DRAWS, SEED)
    return surface.truncated_sum(events.resampled_age_correlation(field, w, AGE_EDGES, AGE_LAGS, 5), ["series", "draw", "age_bin"])


@_query
def bootstrap_tau(spark, d):
    return nulls.summarise(_tau_by_draw(spark, d), ["series", "age_bin"], "tau")


@_query
def bootstrap_spearman(spark, d):
    return nulls.summarise(events.spearman(_tau_by_draw(spark, d), ["series", "draw"], "age_bin", "tau"), ["series"], "spearman")


@_query
def bootstrap_omori_interval(spark, d):
    p = nulls.of_series(fits.omori(nulls.as_series(nulls.bootstrap_mean(_field(spark, d), DRAWS, SEED))))
    return nulls.summarise(p, ["series"], "p")


def _random_places(spark, d, base):
    n = events.separate(events.shock_candidates(base, **SHOCKS), DISTANCE).groupBy("series").agg(F.count("*").alias("n"))
    return nulls.random_events(base, n, 5, SEED, DISTANCE, 60, 50)


@_query
def random_event_places(spark, d):
    return _random_places(spark, d, _base(spark, d))


@_query
def random_event_null(spark, d):
    """The ageing trend of as many random events as there were shocks, for each draw."""
    base = _base(spark, d)
    places = cut(_random_places(spark, d, base))
    drawn = base.join(places.select("series", "draw").distinct(), "series")
    field = events.post_shock_field(nulls.as_series(drawn), nulls.as_series(places), U_MAX)
    tau = surface.truncated_sum(events.age_correlation(field, AGE_EDGES, AGE_LAGS, 5), ["series", "age_bin"])
    return nulls.of_series(events.spearman(tau, ["series"], "age_bin", "tau"))


@_query
def ageing_verdict(spark, d):
    """Does the trend after shocks lie above that after random events?"""
    seen = events.spearman(surface.truncated_sum(_age(spark, d), ["series", "age_bin"]), ["series"], "age_bin", "tau")
    null = _QUERIES["random_event_null"](spark, d)
    both = seen.select("series", F.lit(0).cast("long").alias("draw"), "spearman").unionByName(null.select("series", "draw", "spearman"))
    return evaluation.above_null(both, ["series"], "spearman")


# phase of day


@_query
def phase_observables(spark, d):
    return phase.observables(_phase(spark, d), ["series"])


@_query
def phase_modulation(spark, d):
    return phase.modulation(phase.observables(_phase(spark, d), ["series"]), ["series"])


def _rotated(spark, d):
    return phase.rotation_null(_phase(spark, d), DRAWS, SEED)


@_query
def phase_rotation_null(spark, d):
    return _rotated(spark, d)


@_query
def empirical_p(spark, d):
    t = _rotated(spark, d).withColumn("modulation", F.round("modulation", 6))
    return phase.empirical_p(t, ["series", "observable"], "modulation").select("series", "observable", "p", "draws")


@_query
def phase_verdict(spark, d):
    t = _rotated(spark, d).withColumn("modulation", F.round("modulation", 6))
    return evaluation.replicated(phase.empirical_p(t, ["series", "observable"], "modulation"), F.col("p"), ["observable"])


@_query
def transfer_verdict(spark, d):
    return evaluation.within(phase.gaussian_transfer(_phase(spark, d)), F.col("z"), 2.0, 30 / 32)


@_query
def gaussian_transfer(spark, d):
    return phase.gaussian_transfer(_phase(spark, d))


def _hourly_phase(spark, d):
    """Hourly bars, whose numbers of trades differ."""
    raw = 2 * F.col("tb_base") - F.col("volume")
    e = _eh(spark, d).join(flow.price_and_flow(_eh(spark, d)), ["series", "idx"])
    return cut(phase.prepare(e.select("series", "idx", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "e", "p", raw.alias("raw"), "volume", "trades")))


@_query
def phase_observables_hourly(spark, d):
    return phase.observables(_hourly_phase(spark, d), ["series"], 8, HOURLY_LEAST)


@_query
def phase_matched_response(spark, d):
    return phase.matched_response(_hourly_phase(spark, d), least=HOURLY_LEAST)


@_query
def phase_matched_spread(spark, d):
    return phase.response_spread(phase.matched_response(_hourly_phase(spark, d), least=HOURLY_LEAST))


# nulls


def _null_slopes(drawn):
    return nulls.of_series(blocks.cumulant_slopes(blocks.cumulants(nulls.as_series(drawn), (1, 2, 4, 8, 16))).select("series", "slope_k2"))


@_query
def signflip_null(spark, d):
    return _null_slopes(nulls.sign_flip(_x(spark, d), DRAWS, SEED))


@_query
def permutation_null(spark, d):
    return _null_slopes(nulls.permutation(_x(spark, d), DRAWS, SEED))


@_query
def null_summary(spark, d):
    return nulls.summarise(_null_slopes(nulls.permutation(_x(spark, d), DRAWS, SEED)), ["series"], "slope_k2")


def _cells(spark, d):
    drawn = nulls.as_series(nulls.permutation(_x(spark, d), DRAWS, SEED))
    acf = nulls.of_series(lagcorr.flow_autocorrelation(drawn, 5, "x"))
    return cut(acf.select("draw", F.col("lag").cast("string").alias("cell"), F.round("c", 9).alias("stat")))


@_query
def maxt_correction(spark, d):
    return nulls.max_t(_cells(spark, d))


@_query
def maxt_summary(spark, d):
    return nulls.max_t_summary(_cells(spark, d))


@_query
def drift_control(spark, d):
    return blocks.nu_blocks(nulls.drift(_x(spark, d), 1.0), range(0, 7))


@_query
def drift_sweep(spark, d):
    return nulls.drift_sweep(_x(spark, d), (0.3, 0.6, 1.0, 1.5, 2.0, 3.0), range(0, 7))


@_query
def gamma_gph(spark, d):
    return memory.gamma_gph(_x(spark, d))


def _two_component(spark, d):
    return cut(kernel.two_component(_acf(spark, d)))


@_query
def two_component_kernel(spark, d):
    return _two_component(spark, d)


@_query
def kernel_temperature(spark, d):
    return kernel.kernel_temperature(_two_component(spark, d), _resp(spark, d))


def _flow_sums(spark, d):
    x = _x(spark, d).unionByName(flow.imbalance(_eh(spark, d)))
    return cut(lagcorr.correlation_sums(x, "x", "x"))


@_query
def correlation_sums(spark, d):
    """Mean products of the flow with itself at every lag that a series has."""
    s = _flow_sums(spark, d)
    return s.select("series", "lag", F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs")).alias("c"), "pairs")


@_query
def pooled_correlation(spark, d):
    return lagcorr.pooled_correlation(_flow_sums(spark, d))


@_query
def fluctuation(spark, d):
    return memory.fluctuation(_x(spark, d), SCALES)


@_query
def gamma_dfa(spark, d):
    return memory.gamma_dfa(_x(spark, d), SCALES)


# wavelets


@_query
def haar_octave_diagram(spark, d):
    return wavelet.log_scale_diagram(wavelet.decompose(_x(spark, d), 2))


@_query
def haar_details(spark, d):
    return wavelet.decompose(_x(spark, d), 2, 1)


@_query
def db3_details(spark, d):
    return wavelet.decompose(_x(spark, d), 6, 1)


@_query
def db3_octave_diagram(spark, d):
    return wavelet.log_scale_diagram(wavelet.decompose(_x(spark, d), 6))


@_query
def gamma_wavelet(spark, d):
    return wavelet.gamma_wavelet(wavelet.log_scale_diagram(wavelet.decompose(_x(spark, d), 6)))


@_query
def nu_wavelet(spark, d):
    return wavelet.nu_wavelet(wavelet.log_scale_diagram(wavelet.decompose(_x(spark, d), 2)), (2, 6))


@_query
def drift_moving_average(spark, d):
    return wavelet.drift_average(_x(spark, d), 64)


@_query
def json_report(spark, d):
    t = blocks.cumulants(_x(spark, d), (1, 2, 4)).select("series", F.col("T").cast("int").alias("T"), F.col("n").cast("long").alias("n"))
    return bars.report(t, ["series"])
