"""Wavelet scaling exponents: pyramid by Daubechies filters, log-scale diagram, weighted fit."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import digamma, ratio, trigamma
from tideflow.functions.series import blocks, cut, in_block
from tideflow.functions.stats import ols
from tideflow.operators.flow import compact

_S2, _S3 = math.sqrt(2.0), math.sqrt(3.0)
_A, _B = math.sqrt(10.0), math.sqrt(5 + 2 * math.sqrt(10.0))
# Low-pass filters with 1 to 3 vanishing moments in closed form, and with 4 as fixed values.
FILTERS: dict[int, tuple[float, ...]] = {
    2: (1 / _S2, 1 / _S2),
    4: tuple(v / (4 * _S2) for v in (1 + _S3, 3 + _S3, 3 - _S3, 1 - _S3)),
    6: tuple(v / (16 * _S2) for v in (1 + _A + _B, 5 + _A + 3 * _B, 10 - 2 * _A + 2 * _B, 10 - 2 * _A - 2 * _B, 5 + _A - 3 * _B, 1 + _A - _B)),
    8: (0.23037781330885523, 0.7148465705525415, 0.6308807679295904, -0.02798376941698385, -0.18703481171888114, 0.030841381835986965, 0.032883011666982945, -0.010597401784997278),
}


def filters(length: int) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Low-pass h and high-pass g[k] = (-1)^k h[L-1-k]."""
    if length not in FILTERS:
        raise ValueError(f"no filter of length {length}")
    h = FILTERS[length]
    return h, tuple((-1) ** k * h[length - 1 - k] for k in range(length))


def _step(x: DataFrame, length: int) -> DataFrame:
    """series, idx, size, a, d: one octave, circular: y[k] = sum_m x[(2k+m) mod n] f[L-1-m]."""
    h, g = filters(length)
    n = F.col("size")
    # the first L-1 values once more behind the end close the circle; a series shorter than that goes round again
    laps = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((length - 2) / n).cast("long") + 1), lambda r: F.col("idx") + r * n)
    x = x.withColumn("idx", F.explode(F.filter(laps, lambda i: i < n + length - 1)))
    x, w = blocks(x, after=length - 1), in_block()
    tap = [F.lead("x", m).over(w) if m else F.col("x") for m in range(length)]
    y = lambda f: sum((tap[m] * f[length - 1 - m] for m in range(1, length)), tap[0] * f[length - 1])
    y = x.select("series", "idx", "size", "_home", y(h).alias("a"), y(g).alias("d"))
    return y.where(F.col("_home") & (F.col("idx") < F.col("size")) & (F.col("idx") % 2 == 0)).select("series", (F.col("idx") / 2).cast("long").alias("idx"), "size", "a", "d")


def decompose(df: DataFrame, length: int = 6, octaves: int = 16, min_rows: int = 64) -> DataFrame:
    """series, octave, d: detail coefficients with both ends trimmed, for series of at least ``min_rows`` values.

    A series of n values has floor(log2(n / (2 L))) octaves; each is one window over half the rows, taken
    once and written to the checkpoint folder.
    """
    x = compact(df.select("series", "idx", "x"))
    s = x.groupBy("series").agg(F.count("*").alias("size"), F.avg("x").alias("_m")).where(F.col("size") >= min_rows)
    s = s.withColumn("top", F.least(F.floor(F.log2(F.col("size") / (2 * length))), F.lit(octaves)))
    depth = s.agg(F.max("top")).first()[0] or 0
    tops = s.select("series", "top")
    cur, out = x.join(s, "series").select("series", "idx", "size", (F.col("x") - F.col("_m")).alias("x")), None
    for j in range(1, int(depth) + 1):
        y = cut(_step(cur, length))  # each octave starts from what the one before has written
        half = F.ceil(F.col("size") / 2).cast("long")
        trim = F.least(F.lit(length - 1), F.greatest(F.floor(half / 4), F.lit(1)))
        inside = F.when(half > 2 * trim, (F.col("idx") >= trim) & (F.col("idx") < half - trim)).otherwise(True)
        d = y.where(inside).join(tops.where(F.col("top") >= j), "series").select("series", F.lit(j).alias("octave"), "d")
        out = d if out is None else out.unionByName(d)
        cur = y.select("series", "idx", half.alias("size"), F.col("a").alias("x"))
    return out if out is not None else x.select("series", F.lit(1).alias("octave"), F.col("x").alias("d")).limit(0)


def log_scale_diagram(details: DataFrame, least: int = 8) -> DataFrame:
    """series, octave, n, y, var: log2 of the mean energy less its bias, and its variance."""
    s = details.groupBy("series", "octave").agg(F.count("*").alias("n"), F.avg(F.col("d") * F.col("d")).alias("e"))
    s = s.where((F.col("n") >= least) & (F.col("e") > 0))
    half, ln2 = F.col("n") / 2, math.log(2)
    bias = digamma(half) / ln2 - F.log2(half)
    return s.select("series", "octave", "n", (F.log2("e") - bias).alias("y"), (trigamma(half) / ln2**2).alias("var"))


def gamma_wavelet(diagram: DataFrame, low: int = 2, high: int | None = None) -> DataFrame:
    """series, alpha, gamma, hurst, se, chi2_dof, n: weighted line through the diagram, from 3 octaves on."""
    d = diagram.where((F.col("octave") >= low) & (F.lit(high is None) | (F.col("octave") <= (high or 0))))
    w, j, y = 1 / F.col("var"), F.col("octave"), F.col("y")
    s = d.groupBy("series").agg(
        F.count("*").alias("n"), F.sum(w).alias("s0"), F.sum(w * j).alias("s1"), F.sum(w * j * j).alias("s2"), F.sum(w * y).alias("sy"), F.sum(w * j * y).alias("sjy"), F.sum(w * y * y).alias("syy")
    )
    det = F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1")
    a = ratio(F.col("s0") * F.col("sjy") - F.col("s1") * F.col("sy"), det)
    b = ratio(F.col("s2") * F.col("sy") - F.col("s1") * F.col("sjy"), det)
    chi2 = F.col("syy") - a * F.col("sjy") - b * F.col("sy")
    return s.where((F.col("n") >= 3) & (det > 0)).select(
        "series", a.alias("alpha"), (1 - a).alias("gamma"), ((1 + a) / 2).alias("hurst"), F.sqrt(F.col("s0") / det).alias("se"), ratio(chi2, F.col("n") - 2).alias("chi2_dof"), "n"
    )


def nu_wavelet(diagram: DataFrame, octaves: Sequence[int] = (3, 8)) -> DataFrame:
    """Slope of the diagram over a range of octaves, plus one."""
    d = diagram.where((F.col("octave") >= octaves[0]) & (F.col("octave") <= octaves[1]))
    return ols(d, ["series"], F.col("y"), F.col("octave"), 2).select("series", (F.col("slope") + 1).alias("nu"), "n")


def drift_average(df: DataFrame, width: int = 1024) -> DataFrame:
    """Centred moving average of ``width`` rows, zeros beyond the ends: the slow mean of a series."""
    w = in_block().rowsBetween(-(width // 2), width - width // 2 - 1)
    x = blocks(df.select("series", "idx", "x"), width // 2, width - width // 2 - 1)
    return x.select("series", "idx", "_home", (F.sum("x").over(w) / width).alias("slow")).where("_home").drop("_home")


def haar_identity(df: DataFrame, lengths: Sequence[int]) -> DataFrame:
    """series, T, var_d, from_blocks = 4 V_T - V_2T: equal in expectation."""
    from tideflow.operators.blocks import haar_variance, net_charge

    h = haar_variance(df, lengths).select("series", "T", "var_d")
    v = net_charge(df, sorted({*lengths, *(2 * t for t in lengths)})).groupBy("series", "T").agg(F.var_samp("q").alias("v"))
    twice = v.select("series", (F.col("T") / 2).alias("T"), F.col("v").alias("v2"))
    return h.join(v, ["series", "T"]).join(twice, ["series", "T"]).select("series", "T", "var_d", (4 * F.col("v") - F.col("v2")).alias("from_blocks"))


__all__ = ["FILTERS", "decompose", "drift_average", "filters", "gamma_wavelet", "haar_identity", "log_scale_diagram", "nu_wavelet"]
