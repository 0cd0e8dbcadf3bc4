"""Memory exponents besides regression and wavelets: the log-periodogram and detrended fluctuations."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.fourier import lowest
from tideflow.functions.scalar import log, ratio
from tideflow.functions.series import BLOCK, running_sum, whole
from tideflow.functions.stats import grid, ols
from tideflow.operators.flow import compact


def log_periodogram(df: DataFrame, power: float = 0.5, value: str = "x") -> DataFrame:
    """series, k, omega, i: the periodogram at the lowest n^power Fourier frequencies, with the mean taken out.

    Done by transforms of n log n products (``functions/fourier.py``), so neither n nor the number of frequencies is bounded by a task.
    """
    x = whole(compact(df.select("series", "idx", value), value), n=F.count("*"), m=F.avg(value))
    top = F.floor(F.pow(F.col("n").cast("double"), F.lit(power)))
    s = lowest(x.select("series", "n", "idx", (F.col(value) - F.col("m")).alias("c")), "c", top)
    i = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (2 * math.pi * F.col("n"))
    return s.select("series", "k", (2 * math.pi * F.col("k") / F.col("n")).alias("omega"), i.alias("i"))


def gamma_gph(df: DataFrame, power: float = 0.5) -> DataFrame:
    """series, d, gamma, se, n: minus the slope of ln I against ln(4 sin^2(omega / 2)); gamma = 1 - 2 d."""
    half = F.sin(F.col("omega") / 2)
    fit = ols(log_periodogram(df, power), ["series"], log(F.col("i")), F.ln(4 * half * half))
    return fit.select("series", (-F.col("slope")).alias("d"), (1 + 2 * F.col("slope")).alias("gamma"), (2 * F.col("se_slope")).alias("se"), "n")


def fluctuation(df: DataFrame, scales: Sequence[int], least: int = 4, value: str = "x") -> DataFrame:
    """series, T, boxes, f2: mean squared distance of the profile from its straight line in each box of T rows."""
    x = whole(compact(df.select("series", "idx", value), value), m=F.avg(value))
    y = running_sum(x, ["series"], F.floor(F.col("idx") / BLOCK), [F.col("idx")], F.col(value) - F.col("m"), "y")
    boxes = y.crossJoin(grid(df.sparkSession, "T", scales)).groupBy("series", "T", F.floor(F.col("idx") / F.col("T")).alias("box"))
    t = F.col("idx") % F.col("T")
    s = boxes.agg(F.count("*").alias("rows"), F.regr_syy("y", t).alias("syy"), F.regr_sxy("y", t).alias("sxy"), F.regr_sxx("y", t).alias("sxx")).where(F.col("rows") == F.col("T"))
    rest = F.greatest(F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0)) / F.col("T")
    return s.groupBy("series", "T").agg(F.count("*").alias("boxes"), F.avg(rest).alias("f2")).where(F.col("boxes") >= least)


def gamma_dfa(df: DataFrame, scales: Sequence[int]) -> DataFrame:
    """series, hurst, gamma, se, n: half the log-log slope of the squared fluctuation; gamma = 2 - 2 hurst."""
    fit = ols(fluctuation(df, scales), ["series"], log(F.col("f2")) / 2, F.ln("T"))
    return fit.select("series", F.col("slope").alias("hurst"), (2 - 2 * F.col("slope")).alias("gamma"), (2 * F.col("se_slope")).alias("se"), "n")
