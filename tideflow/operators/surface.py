"""Two-time surfaces: the local autocorrelation of trailing windows, and what is read from it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.quantiles import quantiles
from tideflow.functions.scalar import finite, ratio, volatility_field
from tideflow.functions.series import BLOCK, blocks, in_block
from tideflow.functions.stats import grid


def two_time_surface(returns: DataFrame, window: int = 250, max_lag: int = 40, step: int = 1, field: str = "abs") -> DataFrame:
    """series, t_w, k (window number), lag, rho for every trailing window; windows with a missing value give NULL.

    rho(lag) is the sum of centred products over the centred sum of squares, with the window's mean,
    written as framed sums so that every lag of every window comes from one sorted pass.
    """
    if window < 20:
        raise ValueError("window must be at least 20")
    if max_lag >= window // 2:
        raise ValueError("max_lag must be below half the window")
    x = returns.select("series", "idx", volatility_field(finite(F.col("r")), field).alias("x"))
    # values about the series' mean: the framed differences below then lose no digits
    mean = x.groupBy("series").agg(F.avg("x").alias("_m"))
    x = x.join(mean, "series").select("series", "idx", (F.col("x") - F.col("_m")).alias("x"))
    x = blocks(x, before=window - 1)
    full = in_block().rowsBetween(-(window - 1), 0)
    m = F.avg("x").over(full)
    cols = [F.count("x").over(full).alias("n"), m.alias("m"), (F.sum(F.col("x") * F.col("x")).over(full) - window * m * m).alias("d")]
    for k in range(1, max_lag + 1):
        prod = F.sum(F.col(f"_p{k}")).over(in_block().rowsBetween(-(window - 1 - k), 0))
        late, early = F.sum("x").over(in_block().rowsBetween(-(window - 1 - k), 0)), F.sum("x").over(in_block().rowsBetween(-(window - 1), -k))
        cols.append((prod - m * (late + early) + (window - k) * m * m).alias(f"s_{k}"))
    x = x.withColumns({f"_p{k}": F.col("x") * F.lag("x", k).over(in_block()) for k in range(1, max_lag + 1)})
    s = x.select("series", "idx", "_home", *cols).where(F.col("_home") & (F.col("idx") >= window - 1) & ((F.col("idx") - (window - 1)) % step == 0))
    rho = lambda k: F.when((F.col("n") == window) & (F.col("d") > 0), ratio(F.col(f"s_{k}"), F.col("d")))
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), rho(k).alias("rho")) for k in range(1, max_lag + 1)])
    long = s.select("series", F.col("idx").alias("t_w"), ((F.col("idx") - (window - 1)) / step).cast("long").alias("k"), F.explode(rows).alias("_r"))
    return long.select("series", "t_w", "k", "_r.lag", "_r.rho")


def mean_profile(surface: DataFrame) -> DataFrame:
    return surface.groupBy("series", "lag").agg(F.avg("rho").alias("rho_mean"))


def tti_breaking(surface: DataFrame, reference: str = "expanding", min_windows: int = 20, block: int = BLOCK) -> DataFrame:
    """series, t_w, distance of each window's profile from the mean of earlier windows, or of all ('full', not causal)."""
    if reference == "expanding":
        # sums over the windows before, within buckets of windows and shifted by the buckets ahead of them
        s = surface.withColumn("_b", F.floor(F.col("k") / block))
        total = s.groupBy("series", "lag", "_b").agg(F.sum("rho").alias("_s"), F.count("rho").alias("_n"))
        ahead = Window.partitionBy("series", "lag").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        base = total.select("series", "lag", "_b", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_base{c}") for c in ("_s", "_n")])
        inside = Window.partitionBy("series", "lag", "_b").orderBy("t_w").rowsBetween(Window.unboundedPreceding, -1)
        s = s.withColumns({"_s": F.coalesce(F.sum("rho").over(inside), F.lit(0.0)), "_n": F.coalesce(F.count("rho").over(inside), F.lit(0))}).join(base, ["series", "lag", "_b"])
        s = s.withColumn("_ref", ratio(F.col("_s") + F.col("_base_s"), F.col("_n") + F.col("_base_n"))).where(F.col("k") >= min_windows)
    elif reference == "full":
        s = surface.join(surface.groupBy("series", "lag").agg(F.avg("rho").alias("_ref")), ["series", "lag"])
    else:
        raise ValueError(f"unknown reference: {reference!r}")
    d = F.col("rho") - F.col("_ref")
    a = s.groupBy("series", "t_w").agg(F.count(d).alias("n"), F.sqrt(F.sum(d * d)).alias("d"), F.sqrt(F.sum(F.col("_ref") * F.col("_ref"))).alias("norm"))
    return a.select("series", "t_w", F.when(F.col("n") >= 2, F.col("d") / (F.col("norm") + 1e-12)).alias("distance"))


def correlation_time(surface: DataFrame, method: str = "integral") -> DataFrame:
    """series, t_w, tau: the sum of rho before its first rho <= 0, or the first lag index (from 0) with rho < 1/e, interpolated."""
    keys = ["series", "t_w"]
    if method == "integral":
        cut = surface.groupBy(*keys).agg(F.min(F.when(F.col("rho") <= 0, F.col("lag"))).alias("cut"), F.count("rho").alias("n"))
        s = surface.join(cut, keys).groupBy(*keys, "cut", "n").agg(F.sum(F.when(F.col("cut").isNull() | (F.col("lag") < F.col("cut")), F.col("rho"))).alias("tau"))
        return s.select(*keys, F.when((F.col("n") > 0) & (F.col("cut").isNull() | (F.col("cut") > 1)), F.coalesce("tau", F.lit(0.0))).alias("tau"))
    if method != "efold":
        raise ValueError(f"unknown method: {method!r}")
    thr = 1 / math.e
    before = F.lag("rho").over(Window.partitionBy(*keys).orderBy("lag"))
    s = surface.withColumn("before", before)
    frac = F.when(F.col("before") == F.col("rho"), 0.0).otherwise(ratio(F.col("before") - thr, F.col("before") - F.col("rho")))
    hit = F.min(F.when(F.col("rho") < thr, F.struct("lag", F.when(F.col("lag") == 1, 0.0).otherwise(F.col("lag") - 1 + frac).alias("tau"))))
    a = s.groupBy(*keys).agg(hit.alias("hit"), F.count("*").alias("lags"), F.count("rho").alias("n"))
    return a.select(*keys, F.when(F.col("n") > 0, F.when(F.col("hit").isNull(), F.col("lags").cast("double")).otherwise(F.col("hit.tau"))).alias("tau"))


def truncated_sum(rho: DataFrame, keys: Sequence[str], lag: str = "lag") -> DataFrame:
    """keys, tau: like the integral time, but a missing value counts as 0 and so ends the sum."""
    r = rho.withColumn("_r", F.coalesce("rho", F.lit(0.0)))
    cut = r.groupBy(*keys).agg(F.min(F.when(F.col("_r") <= 0, F.col(lag))).alias("cut"), F.min(lag).alias("first"), F.count("rho").alias("n"))
    s = r.join(cut, list(keys)).groupBy(*keys, "cut", "first", "n").agg(F.sum(F.when(F.col("cut").isNull() | (F.col(lag) < F.col("cut")), F.col("_r"))).alias("tau"))
    return s.select(*keys, F.when((F.col("n") > 0) & (F.col("cut").isNull() | (F.col("cut") > F.col("first"))), F.col("tau")).alias("tau"))


def aging_curve(surface: DataFrame, mu: Sequence[float] | None = None, n_bins: int = 30, min_rows: int = 5) -> DataFrame:
    """series, mu, residual: variance of rho within quantile bins of lag / t_w^mu, over complete windows only."""
    mu = [i / 20 for i in range(21)] if mu is None else list(mu)
    lags = surface.groupBy("series", "t_w").agg(F.count("rho").alias("n"), F.count("*").alias("all")).where("n = all AND t_w > 0").select("series", "t_w")
    rows = lags.groupBy("series").agg(F.count("*").alias("rows")).where(F.col("rows") >= min_rows).select("series")
    s = surface.join(lags, ["series", "t_w"]).join(rows, "series").crossJoin(grid(surface.sparkSession, "mu", mu, "double"))
    s = s.withColumn("x", F.col("lag") / F.pow(F.col("t_w").cast("double"), F.col("mu")))
    edges = quantiles(s, ["series", "mu"], F.col("x"), [i / n_bins for i in range(n_bins + 1)], "edges").drop("edges_n")
    b = F.least(F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("x"))) - 1, F.lit(0)), F.lit(n_bins - 1))
    inside = s.join(edges, ["series", "mu"]).withColumn("bin", b).groupBy("series", "mu", "bin").agg((F.var_pop("rho") * F.count("*")).alias("ss"), F.count("*").alias("n"))
    return inside.groupBy("series", "mu").agg((F.sum("ss") / F.sum("n")).alias("residual"))


def aging_collapse(surface: DataFrame, mu: Sequence[float] | None = None, n_bins: int = 30) -> DataFrame:
    """series, mu_best, residual_best, residual_0 (no ageing)."""
    c = aging_curve(surface, mu, n_bins)
    best = F.min(F.struct("residual", "mu"))
    return c.groupBy("series").agg(best.alias("b"), F.max(F.when(F.col("mu") == 0, F.col("residual"))).alias("residual_0")).select("series", F.col("b.mu").alias("mu_best"), F.col("b.residual").alias("residual_best"), "residual_0")
