"""Whole analyses: each takes bars (series, idx, ts, open, close, volume, tb_base, trades) and returns named, lazy DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.operators import blocks, events, evaluation, fits, flow, lagcorr, nulls, phase, surface, symmetry, vol, wavelet

LENGTHS = (1, 2, 4, 8, 16, 32, 64, 128)


def with_suffix(df: DataFrame, suffix: str, column: str = "series") -> DataFrame:
    """Rows of series whose label ends so ('|1h'), in the label's order."""
    return df.where(F.col(column).endswith(suffix)).orderBy(column)


def counting(bars: DataFrame, lengths: Sequence[int] = LENGTHS, max_lag: int = 60, draws: int = 20, seed: int = 7, affinity_lengths: Sequence[int] = (1, 4, 16, 64), min_blocks: int = 400) -> dict[str, DataFrame]:
    """Memory, affinity, cumulant scaling and its closure by the autocorrelation, Fano factor, nulls, stability."""
    x, pf = flow.imbalance(bars), flow.price_and_flow(bars)
    acf = lagcorr.flow_autocorrelation(pf, max_lag)
    cum = blocks.cumulants(x, lengths)
    q = blocks.net_charge(x, affinity_lengths)
    many = q.groupBy("series", "T").agg(F.count("*").alias("n")).where(F.col("n") >= min_blocks).select("series", "T")
    sym = symmetry.symmetry_function(q.join(many, ["series", "T"], "left_semi"), ["series", "T"])
    closure = cum.select("series", "T", "k2").join(lagcorr.k2_from_acf(pf, acf, lengths), ["series", "T"]).withColumn("closure", F.try_divide("k2", "k2_pred"))
    raw = bars.select("series", "idx", (2 * F.col("tb_base") - F.col("volume")).alias("flow"), "volume", "trades")
    fano = blocks.fano(raw, lengths)

    def null(drawn: DataFrame) -> DataFrame:
        slopes = nulls.of_series(blocks.cumulant_slopes(blocks.cumulants(nulls.as_series(drawn), lengths)))
        return nulls.summarise(slopes, ["series"], "slope_k2")

    return {
        "gamma": lagcorr.gamma_acf(acf), "affinity": symmetry.fit_affinity(sym, ["series", "T"]), "gaussian_affinity": blocks.gaussian_affinity(x, affinity_lengths, min_blocks), "symmetry": sym,
        "cumulants": cum, "slopes": blocks.cumulant_slopes(cum), "closure": closure, "fano": fano, "fano_slope": blocks.fano_slope(fano), "tranches": blocks.tranches(x, 16),
        "sign_flip": null(nulls.sign_flip(x, draws, seed)), "permutation": null(nulls.permutation(x, draws, seed)),
    }


def post_shock(returns: DataFrame, u_max: int = 300, edges: Sequence[int] = (0, 8, 16, 32, 64, 128, 256), max_lag: int = 40, draws: int = 50, resamples: int = 200, seed: int = 7, quantile: float = 0.995, distance: int = 384, before: int = 200, pooled: bool = True) -> dict[str, DataFrame]:
    """Relaxation after shocks by series and pooled: mean, power law, correlation by age, its Spearman trend, bootstrap and random-event null.

    The two ensembles, on which all results rest, are persisted: ``unpersist`` them through ``field`` and ``null_field``.
    """
    base = vol.ewma_vol(returns)
    shocks = events.separate(events.shock_candidates(base, quantile, u_max, before), distance)

    def by_age(field: DataFrame) -> DataFrame:
        return surface.truncated_sum(events.age_correlation(field, edges, max_lag), ["series", "age_bin"])

    field = events.post_shock_field(base, shocks, u_max)
    field = (events.pool(field) if pooled else field).persist()
    tau = by_age(field)
    weights = nulls.bootstrap_weights(field, resamples, seed)
    boot_tau = surface.truncated_sum(events.resampled_age_correlation(field, weights, edges, max_lag), ["series", "draw", "age_bin"])
    boot = events.spearman(boot_tau, ["series", "draw"], "age_bin", "tau")
    boot_p = nulls.of_series(fits.omori(nulls.as_series(nulls.bootstrap_mean(field, resamples, seed))))
    counts = shocks.groupBy("series").agg(F.count("*").alias("n"))
    places = nulls.random_events(base, counts, draws, seed, distance, u_max, before)
    # each draw's events as series of their own, from the series' returns
    drawn = base.join(places.select("series", "draw").distinct(), "series").withColumn("series", F.concat_ws("#", "series", "draw")).select("series", "idx", "r", "sigma")
    null_field = events.post_shock_field(drawn, places.select(F.concat_ws("#", "series", "draw").alias("series"), "idx"), u_max)
    if pooled:  # a draw's pool holds the random events of all series
        shock = F.col("shock") * 1_000_003 + F.pmod(F.xxhash64("series"), F.lit(1_000_003))
        null_field = null_field.unionByName(null_field.select(F.concat(F.lit("POOL#"), F.substring_index("series", "#", -1)).alias("series"), shock.alias("shock"), "u", "w"))
    null_field = null_field.persist()
    null_tau = by_age(null_field)
    null = nulls.of_series(events.spearman(null_tau, ["series"], "age_bin", "tau"))
    seen = events.spearman(tau, ["series"], "age_bin", "tau")
    both = seen.select("series", F.lit(0).cast("long").alias("draw"), "spearman").unionByName(null.select("series", "draw", "spearman"))
    return {
        "field": field, "null_field": null_field, "shocks": shocks, "mean": events.ensemble_mean(field), "omori": fits.omori(events.ensemble_mean(field)), "omori_late": fits.omori(events.ensemble_mean(field), 5),
        "tau": tau, "spearman": seen, "spearman_bootstrap": nulls.summarise(boot, ["series"], "spearman", 11), "omori_bootstrap": nulls.summarise(boot_p, ["series"], "p", 11),
        "tau_bootstrap": nulls.summarise(boot_tau, ["series", "age_bin"], "tau", 11), "spearman_null": nulls.summarise(both, ["series"], "spearman"),
    }


def phase_of_day(prepared: DataFrame, draws: int = 50, seed: int = 7, n_bins: int = 8, level: float = 0.05) -> dict[str, DataFrame]:
    """Observables by phase, their modulation, and its p against rotations of each day; verdict by replication across series."""
    obs = phase.observables(prepared, ["series"], n_bins)
    p = phase.empirical_p(phase.rotation_null(prepared, draws, seed, n_bins), ["series", "observable"], "modulation")
    return {"observables": obs, "modulation": phase.modulation(obs, ["series"]), "p": p, "verdict": evaluation.replicated(p, F.col("p"), ["observable"], level)}


def second_order(bars: DataFrame, prepared: DataFrame, hour: Column, max_lag: int = 60) -> dict[str, DataFrame]:
    """Shape of the effective temperature, two regimes of memory (raw and without the daily cycle), Gaussian transfer by phase."""
    pf = flow.price_and_flow(bars)
    acf = lagcorr.flow_autocorrelation(pf, max_lag)
    teff = lagcorr.effective_temperature(lagcorr.response_function(pf, max_lag), acf)
    x = flow.imbalance(bars).join(bars.select("series", "idx", hour.alias("hour")), ["series", "idx"])
    flat = lagcorr.flow_autocorrelation(lagcorr.deseasonalise(x), max_lag, "x")
    return {"teff": teff, "teff_shape": lagcorr.teff_shape(teff), "regimes": lagcorr.two_regimes(acf), "regimes_deseasonalised": lagcorr.two_regimes(flat), "transfer": phase.gaussian_transfer(prepared)}


def crossover(x: DataFrame, octaves: Sequence[int] = (3, 8), amplitudes: Sequence[float] = (0.3, 0.6, 1.0, 3.0)) -> dict[str, DataFrame]:
    """Variance exponent by blocks and by wavelets of 1 to 3 vanishing moments, on the series and with ramps and parabolas added."""
    cases = x.select("series", F.lit("clean").alias("case"), "idx", "x")
    for power, name in ((1, "ramp"), (2, "parabola")):
        for a in amplitudes:
            cases = cases.unionByName(nulls.drift(x, a, power).select("series", F.lit(f"{name} {a}").alias("case"), "idx", "x"))
    both = cases.select(F.concat_ws("\x1f", "series", "case").alias("series"), "idx", "x")
    split = lambda df: df.withColumn("case", F.split("series", "\x1f")[1]).withColumn("series", F.split("series", "\x1f")[0])
    out = {"blocks": split(blocks.nu_blocks(both, range(octaves[0], octaves[1] + 1))), "slow_mean": wavelet.drift_average(x)}
    for length in (2, 4, 6):
        out[f"db{length // 2}"] = split(wavelet.nu_wavelet(wavelet.log_scale_diagram(wavelet.decompose(both, length)), octaves))
    return out
