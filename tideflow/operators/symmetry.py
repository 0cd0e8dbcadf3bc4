"""Fluctuation symmetry: log ratio of counts at +q and -q, and the affinity fitted to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.quantiles import quantiles
from tideflow.functions.scalar import ratio


def symmetry_function(q: DataFrame, keys: Sequence[str], n_bins: int = 15, quantile: float = 0.99, min_count: int = 10, most: int | None = None) -> DataFrame:
    """keys, bin, centre, s, se of column ``q``: bins (lo, hi] of |q| up to its quantile, kept with enough counts of both signs.

    ``most``: a number of rows that no key exceeds, if known.
    """
    keys = list(keys)
    if "bin" in keys:
        raise ValueError("'bin' is a column of the result")
    q = q.where("q IS NOT NULL")
    top = quantiles(q, keys, F.abs("q"), [quantile], "_q", most=most).where(F.col("_q_n") >= 4 * min_count).select(*keys, F.col("_q")[0].alias("top"))
    d = q.join(top.where("top > 0"), keys)
    width, a = F.col("top") / n_bins, F.abs("q")
    guess = F.ceil(a / width)
    bin_ = F.when(a <= width * (guess - 1), guess - 1).when(a > width * guess, guess + 1).otherwise(guess)
    d = d.where(F.col("q") != 0).withColumn("bin", bin_.cast("int") - 1).withColumn("width", width).where(F.col("bin") < n_bins)
    n = d.groupBy(*keys, "width", "bin").agg(F.count_if(F.col("q") > 0).alias("p"), F.count_if(F.col("q") < 0).alias("m"))
    n = n.where((F.col("p") >= min_count) & (F.col("m") >= min_count))
    return n.select(*keys, "bin", (F.col("width") * (F.col("bin") + 0.5)).alias("centre"), F.ln(F.col("p") / F.col("m")).alias("s"), F.sqrt(1 / F.col("p") + 1 / F.col("m")).alias("se"))


def fit_affinity(sym: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, se_a, chi2_dof (s = A q), c3, se_c3 (s = A q + c3 q^3), n_bins; weighted by 1/se^2."""
    w, q, s = 1 / (F.col("se") * F.col("se")), F.col("centre"), F.col("s")
    m = sym.groupBy(*keys).agg(
        F.count("*").alias("n_bins"), F.sum(w * q * q).alias("q2"), F.sum(w * q * q * q * q).alias("q4"), F.sum(w * F.pow(q, F.lit(6))).alias("q6"),
        F.sum(w * q * s).alias("qs"), F.sum(w * q * q * q * s).alias("q3s"), F.sum(w * s * s).alias("ss"),
    )
    n, q2, q4, q6, qs, q3s = (F.col(c) for c in ("n_bins", "q2", "q4", "q6", "qs", "q3s"))
    det = q2 * q6 - q4 * q4
    three, four = n >= 3, n >= 4
    return m.select(
        *keys, F.when(three, ratio(qs, q2)).alias("a"), F.when(three, ratio(F.lit(1.0), F.sqrt(q2))).alias("se_a"),
        F.when(three, ratio(F.col("ss") - ratio(qs * qs, q2), n - 1)).alias("chi2_dof"),
        F.when(four, ratio(q2 * q3s - q4 * qs, det)).alias("c3"), F.when(four, F.sqrt(F.greatest(ratio(q2, det), F.lit(0.0)))).alias("se_c3"), "n_bins",
    )
