"""Lag correlation and response of price and flow, all lags in one window pass.

A series is cut into blocks of rows; each block borrows the first ``max_lag`` rows of the next one,
so a window never holds more than a block and one long series is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.fourier import correlations
from tideflow.functions.scalar import finite, log, ratio
from tideflow.functions.series import BLOCK, blocks, in_block
from tideflow.functions.stats import grid, ols

MIN_PAIRS = 30
#: Up to so many lags, sums of products are taken one by one.
DIRECT_LAGS = 64


def _by_lag(df: DataFrame, keys: Sequence[str], lags: int, columns: Sequence[str]) -> DataFrame:
    """Columns c_1..c_L become rows (lag, c)."""
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), *[F.col(f"{c}_{k}").alias(c) for c in columns]) for k in range(1, lags + 1)])
    return df.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")


def _centred(df: DataFrame, value: str) -> DataFrame:
    stats = df.groupBy("series").agg(F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    return df.join(stats, "series").withColumn("_c", F.col(value) - F.col("_m"))


def response_function(pf: DataFrame, max_lag: int = 60, block: int = BLOCK) -> DataFrame:
    """series, lag, r, pairs: mean((p[t+lag] - p[t]) * ec[t]) / mean(ec^2); needs more than 30 pairs. pf: series, idx, p, e."""
    d = _centred(pf.select("series", "idx", finite(F.col("p")).alias("p"), finite(F.col("e")).alias("e")), "e")
    d = blocks(d, after=max_lag, block=block)
    prod = d.select("series", "_v", "_home", *[((F.lead("p", k).over(in_block()) - F.col("p")) * F.col("_c")).alias(f"y_{k}") for k in range(1, max_lag + 1)]).where("_home")
    agg = prod.groupBy("series", "_v").agg(*[f(f"y_{k}").alias(f"{n}_{k}") for k in range(1, max_lag + 1) for f, n in ((F.avg, "y"), (F.count, "pairs"))])
    ok = (F.col("pairs") > MIN_PAIRS) & (F.col("_v") > 0)
    return _by_lag(agg, ["series", "_v"], max_lag, ["y", "pairs"]).select("series", "lag", F.when(ok, ratio(F.col("y"), F.col("_v"))).alias("r"), "pairs")


def flow_autocorrelation(df: DataFrame, max_lag: int = 60, value: str = "e", block: int = BLOCK) -> DataFrame:
    """series, lag, c, pairs: mean over pairs of the centred product / mean(ec^2), with the full-sample mean."""
    d = blocks(_centred(df.select("series", "idx", finite(F.col(value)).alias("e")), "e"), after=max_lag, block=block)
    prod = d.select("series", "_v", "_home", *[(F.col("_c") * F.lead("_c", k).over(in_block())).alias(f"y_{k}") for k in range(1, max_lag + 1)]).where("_home")
    agg = prod.groupBy("series", "_v").agg(*[f(f"y_{k}").alias(f"{n}_{k}") for k in range(1, max_lag + 1) for f, n in ((F.avg, "y"), (F.count, "pairs"))])
    ok = (F.col("pairs") > MIN_PAIRS) & (F.col("_v") > 0)
    return _by_lag(agg, ["series", "_v"], max_lag, ["y", "pairs"]).select("series", "lag", F.when(ok, ratio(F.col("y"), F.col("_v"))).alias("c"), "pairs")


def correlation_sums(df: DataFrame, a: str, b: str, max_lag: int | None = None, block: int = BLOCK) -> DataFrame:
    """series, lag, s, pairs: the plain sums of a[t] * b[t + lag] over pairs without missing values, lag = 0..max_lag (n - 1 of each series by default).

    s is NULL without pairs. Up to DIRECT_LAGS lags are summed from products; more come from transforms, n log n in all.
    """
    d = df.select("series", "idx", finite(F.col(a)).alias("a"), finite(F.col(b)).alias("b"))
    if max_lag is None or max_lag > DIRECT_LAGS:
        return correlations(d, "a", "b", max_lag)
    d = blocks(d, after=max_lag, block=block)
    prod = d.select("series", "_home", *[(F.col("a") * (F.lead("b", k).over(in_block()) if k else F.col("b"))).alias(f"s_{k}") for k in range(max_lag + 1)]).where("_home")
    sums = prod.groupBy("series").agg(*[f(f"s_{k}").alias(f"{n}_{k}") for k in range(max_lag + 1) for f, n in ((F.sum, "s"), (F.count, "pairs"))])
    rows = F.array(*[F.struct(F.lit(k).cast("long").alias("lag"), F.col(f"s_{k}").alias("s"), F.col(f"pairs_{k}").alias("pairs")) for k in range(max_lag + 1)])
    return sums.select("series", F.explode(rows).alias("_r")).select("series", "_r.*")


def pooled_correlation(sums: DataFrame) -> DataFrame:
    """lag, c, pairs: the mean product at each lag over the pairs of all series together, from ``correlation_sums``."""
    s = sums.groupBy("lag").agg(F.sum("s").alias("s"), F.sum("pairs").alias("pairs"))
    return s.select("lag", F.when(F.col("pairs") > 0, F.col("s") / F.col("pairs")).alias("c"), "pairs")


def effective_temperature(r: DataFrame, c: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """keys, lag, r, c, t_eff = -dC/dlag / R, by central differences, one-sided at the ends; needs |R| > 1e-12 and 3 lags."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("lag")
    d = r.select(*keys, "lag", "r").join(c.select(*keys, "lag", "c"), [*keys, "lag"])
    up, dn, n = F.lead("c").over(w), F.lag("c").over(w), F.count("*").over(Window.partitionBy(*keys))
    first, last = F.lag("lag").over(w).isNull(), F.lead("lag").over(w).isNull()
    dc = F.when(n >= 3, F.when(first, up - F.col("c")).when(last, F.col("c") - dn).otherwise((up - dn) / 2))
    return d.withColumn("t_eff", F.when(F.abs("r") > 1e-12, -ratio(dc, F.col("r"))))


def fdt_violation(t_eff: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """keys, fdt_violation: population deviation of T_eff over the median of its size, from 5 lags on."""
    s = t_eff.groupBy(*keys).agg(F.stddev_pop("t_eff").alias("s"), F.percentile(F.abs("t_eff"), F.lit(0.5)).alias("m"), F.count("t_eff").alias("n"))
    return s.select(*keys, F.when((F.col("n") >= 5) & (F.col("m") > 0), ratio(F.col("s"), F.col("m"))).alias("fdt_violation"), F.when(F.col("n") >= 5, F.col("m")).alias("level"))


def rolling_fdt(pf: DataFrame, window: int = 500, max_lag: int = 30, step: int = 1) -> DataFrame:
    """series, t_w, fdt_violation, level of every trailing window of ``window`` rows, each treated as a series of its own.

    A row goes to every window that covers it, so each task holds single windows only.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("idx") - (window - 1)) / step))
    ends = F.sequence(first, F.floor(F.col("idx") / step))
    last = pf.groupBy("series").agg(F.max("idx").alias("_last"))
    w = pf.join(last, "series").select("series", "idx", "p", "e", "_last", F.explode(ends).alias("_k"))
    w = w.withColumn("t_w", F.col("_k") * step + (window - 1)).where("t_w <= _last")
    one = w.select(F.concat_ws("\x1f", "series", "t_w").alias("series"), (F.col("idx") - (F.col("t_w") - (window - 1))).alias("idx"), "p", "e")
    v = fdt_violation(effective_temperature(response_function(one, max_lag), flow_autocorrelation(one, max_lag)))
    key = F.split("series", "\x1f")
    return v.select(key[0].alias("series"), key[1].cast("long").alias("t_w"), "fdt_violation", "level")


def gamma_acf(acf: DataFrame, least: int = 10, low: int = 1, high: int | None = None) -> DataFrame:
    """Exponent of C(lag): slope of ln C on ln lag over lags with C > 0."""
    use = acf.where((F.col("c") > 0) & (F.col("lag") >= low) & (F.lit(high is None) | (F.col("lag") <= (high or 0))))
    return ols(use, ["series"], log(F.col("c")), F.ln("lag"), least).select("series", F.col("slope").alias("gamma"), F.col("se_slope").alias("se_gamma"), "n")


def two_regimes(acf: DataFrame, split: int = 10, low: int = 2, high: int = 50) -> DataFrame:
    """Slopes of ln C over short and long lags; each needs more than 4 points."""
    fast = gamma_acf(acf, 5, low, split).select("series", F.col("gamma").alias("slope_fast"))
    slow = gamma_acf(acf, 5, split, high).select("series", F.col("gamma").alias("slope_slow"))
    return fast.join(slow, "series", "full")


def deseasonalise(df: DataFrame, hour: str = "hour", value: str = "x") -> DataFrame:
    """Takes the mean of its hour of day from each value; the means are a small table."""
    means = df.groupBy("series", hour).agg(F.avg(value).alias("_m"))
    return df.join(means, ["series", hour]).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def k2_from_acf(flow: DataFrame, acf: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """series, T, k2_pred: variance of block sums implied by the autocorrelation, var * (T + 2 sum_{k<T} (T-k) C(k))."""
    var = flow.groupBy("series").agg(F.var_samp("e").alias("v"))
    t = grid(flow.sparkSession, "T", lengths)
    s = var.crossJoin(t).join(acf.select("series", "lag", "c"), "series", "left")
    part = F.when(F.col("lag") < F.col("T"), (F.col("T") - F.col("lag")) * F.col("c"))
    return s.groupBy("series", "T", "v").agg(F.sum(part).alias("s")).select("series", "T", (F.col("v") * (F.col("T") + 2 * F.coalesce("s", F.lit(0.0)))).alias("k2_pred"))


def teff_shape(t_eff: DataFrame, low: int = 2, high: int = 50) -> DataFrame:
    """Slope of ln|T_eff| against (gamma - 1) - b_R, with errors in quadrature."""
    use = t_eff.where((F.col("lag") >= low) & (F.col("lag") <= high))
    fit = lambda y, n: ols(use, ["series"], log(y), F.ln("lag"), 5).select("series", F.col("slope").alias(f"b_{n}"), F.col("se_slope").alias(f"se_{n}"))
    a = fit(F.abs("t_eff"), "t").join(fit(F.col("c"), "c"), "series").join(fit(F.abs("r"), "r"), "series")
    pred = F.col("b_c") - 1 - F.col("b_r")
    se = F.sqrt(F.col("se_t") ** 2 + F.col("se_c") ** 2 + F.col("se_r") ** 2)
    return a.select("series", "b_t", pred.alias("b_pred"), ratio(F.col("b_t") - pred, se).alias("z"))
