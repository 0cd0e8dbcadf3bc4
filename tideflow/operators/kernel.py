"""Autocorrelations as a sum of two power laws, by variable projection.

For a given pair of exponents the best amplitudes solve two linear equations, whose sums over the lags are one aggregation for
all pairs and series. So only exponents are searched: a coarse grid of pairs, then finer ones around the best pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import ratio
from tideflow.functions.series import cut

#: Exponents are multiples of 1 / UNITS. The coarse grid has steps of STEPS[0] of them up to LARGEST; each later one reaches as far as the step before.
UNITS = 1250
STEPS = (125, 25, 5, 1)
LARGEST = 3750
#: Both exponents are at least so many units apart, or their amplitudes could not be told.
GAP = 125
LEAST_LAGS = 6


def _fits(acf: DataFrame, pairs: DataFrame) -> DataFrame:
    """series, f, s, n, amp_f, amp_s, rest, total: least squares of c at each pair of exponents. pairs: series, f, s in units."""
    x, y = (F.pow(F.col("lag").cast("double"), -F.col(e) / UNITS) for e in ("f", "s"))
    c = F.col("c")
    terms = {"xx": x * x, "xy": x * y, "yy": y * y, "xc": x * c, "yc": y * c, "cc": c * c, "sum_c": c}
    s = acf.join(pairs, "series").groupBy("series", "f", "s").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in terms.items()])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    s = s.withColumns({"amp_f": ratio(F.col("xc") * F.col("yy") - F.col("yc") * F.col("xy"), det), "amp_s": ratio(F.col("yc") * F.col("xx") - F.col("xc") * F.col("xy"), det)})
    rest = F.col("cc") - F.col("amp_f") * F.col("xc") - F.col("amp_s") * F.col("yc")
    total = F.col("cc") - F.col("sum_c") * F.col("sum_c") / F.col("n")
    return s.select("series", "f", "s", "n", "amp_f", "amp_s", rest.alias("rest"), total.alias("total")).where("rest IS NOT NULL")


def _best(fits: DataFrame) -> DataFrame:
    best = fits.groupBy("series").agg(F.min_by(F.struct("f", "s", "n", "amp_f", "amp_s", "rest", "total"), F.struct("rest", "f", "s")).alias("b"))
    return best.select("series", "b.*")


def _around(unit: str, step: int, reach: int) -> Column:
    return F.explode(F.sequence(F.col(unit) - reach, F.col(unit) + reach, F.lit(step)))


def two_component(acf: DataFrame, low: int = 1, high: int | None = None) -> DataFrame:
    """series, a_fast, amp_fast, a_slow, amp_slow, r2, n: C(lag) as amp_fast lag^-a_fast + amp_slow lag^-a_slow, a_fast > a_slow > 0.

    acf: series, lag, c. Lags from ``low`` to ``high`` with a value count; series of fewer than LEAST_LAGS have no row. r2 is NULL
    for a constant C. Of equally good pairs that of the smaller exponents is taken.
    """
    use = (F.col("lag") >= low) & (F.lit(high is None) | (F.col("lag") <= (high or 0)))
    acf = cut(acf.where(F.col("c").isNotNull() & use).select("series", "lag", "c"))
    pairs = acf.groupBy("series").count().where(F.col("count") >= LEAST_LAGS).select("series")
    grid = F.explode(F.sequence(F.lit(STEPS[0]), F.lit(LARGEST), F.lit(STEPS[0])))
    pairs = pairs.withColumn("f", grid).withColumn("s", grid).where(F.col("f") - F.col("s") >= GAP)
    for step, before in zip((*STEPS[1:], None), STEPS):
        best = _best(_fits(acf, pairs))
        if step:
            pairs = best.select("series", "s", _around("f", step, before).alias("f")).select("series", "f", _around("s", step, before).alias("s"))
            pairs = pairs.where((F.col("s") > 0) & (F.col("f") - F.col("s") >= GAP))
    return best.select(
        "series", (F.col("f") / UNITS).alias("a_fast"), F.col("amp_f").alias("amp_fast"), (F.col("s") / UNITS).alias("a_slow"),
        F.col("amp_s").alias("amp_slow"), (1 - ratio(F.col("rest"), F.col("total"))).alias("r2"), "n",
    )


def kernel_temperature(fit: DataFrame, response: DataFrame) -> DataFrame:
    """series, lag, t_eff: what the two power laws say of -C'(lag) / R(lag), at each lag of ``response`` (series, lag, r); needs |R| > 1e-12."""
    lag = F.col("lag").cast("double")
    part = lambda n: F.col(f"a_{n}") * F.col(f"amp_{n}") * F.pow(lag, -1 - F.col(f"a_{n}"))
    d = response.select("series", "lag", "r").join(fit, "series")
    return d.select("series", "lag", F.when(F.abs("r") > 1e-12, ratio(part("fast") + part("slow"), F.col("r"))).alias("t_eff"))
