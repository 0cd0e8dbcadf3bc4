"""Volatility labels, recursions and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite
from tideflow.functions.scan import SCAN_BLOCK, affine_path
from tideflow.functions.series import blocks, in_block


def realized_vol_forward(returns: DataFrame, horizon: int) -> DataFrame:
    """series, idx, rv: root mean square of the next ``horizon`` returns; a label, it sees the future.

    NULL in the last ``horizon`` rows and where fewer than max(2, horizon // 2) are present.
    """
    ahead = in_block().rowsBetween(1, horizon)
    r = finite(F.col("r"))
    d = blocks(returns.select("series", "idx", "r"), after=horizon)
    s = d.select("series", "idx", "_home", F.sqrt(F.avg(r * r).over(ahead)).alias("rv"), F.count(r).over(ahead).alias("n"), F.lead("idx", horizon).over(in_block()).alias("last"))
    return s.where("_home").select("series", "idx", F.when(F.col("last").isNotNull() & (F.col("n") >= max(2, horizon // 2)), F.col("rv")).alias("rv"))


def ewma_vol(returns: DataFrame, lam: float = 0.94, block: int = SCAN_BLOCK) -> DataFrame:
    """series, idx, r, sigma: EWMA forecast with data up to idx - 1. The seed is the variance of the first 50 returns.

    Missing returns count as 0. The recursion is a scan of affine maps, so a series is spread over blocks.
    """
    d = returns.select("series", "idx", finite(F.col("r")).alias("r"))
    first = F.var_pop(F.when(F.col("idx") < 50, F.col("r")))
    seed = d.groupBy("series").agg(F.when(first > 0, first).otherwise(1e-8).alias("_seed"))
    r = F.coalesce("r", F.lit(0.0))
    v = affine_path(d.join(seed, "series"), F.lit(lam), (1 - lam) * r * r, F.col("_seed"), "_v", block)
    return v.select("series", "idx", "r", F.sqrt("_v").alias("sigma"))


def garch_path(returns: DataFrame, params: DataFrame, block: int = SCAN_BLOCK) -> DataFrame:
    """series, idx, r, sigma: GARCH(1,1) forecasts with given parameters (series, omega, alpha, beta).

    Starts at the stationary variance, or the sample's where there is none. A step whose variance would be 0 keeps the
    one before. Parameters must be 0 or more and beta at most 1, as any fit gives them; others have no variance path, and sigma is NULL.
    """
    d = returns.select("series", "idx", finite(F.col("r")).alias("r"))
    every = d.groupBy("series").agg(F.var_pop("r").alias("_all"))
    rest = 1 - F.col("alpha") - F.col("beta")
    sound = (F.col("omega") >= 0) & (F.col("alpha") >= 0) & F.col("beta").between(0, 1) & (F.greatest("omega", "alpha") < float("inf"))
    start = F.when(sound, F.when(rest > 0, F.col("omega") / rest).otherwise(F.col("_all")))
    d = d.join(params.select("series", "omega", "alpha", "beta").join(every, "series").withColumn("_start", start), "series")
    r = F.coalesce("r", F.lit(0.0))
    drive = F.col("omega") + F.col("alpha") * r * r
    still = (F.col("beta") == 0) & (drive <= 0)  # what would be 0 keeps the value before
    v = affine_path(d, F.when(still, 1.0).otherwise(F.col("beta")), F.when(still, 0.0).otherwise(drive), F.col("_start"), "_v", block)
    return v.select("series", "idx", "r", F.sqrt("_v").alias("sigma"))
