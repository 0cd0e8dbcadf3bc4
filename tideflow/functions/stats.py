"""Grouped statistics shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.functions.scalar import ratio


def grid(spark: SparkSession, name: str, values: Sequence[float], kind: str = "int") -> DataFrame:
    """A parameter grid as a table; its size is that of the parameter list."""
    return F.broadcast(spark.createDataFrame([(v,) for v in values], f"{name} {kind}"))


def enough(n: Column, least: int, value: Column) -> Column:
    return F.when(n >= least, value)


def ols(df: DataFrame, keys: Sequence[str], y: Column, x: Column, least: int = 3) -> DataFrame:
    """slope, se_slope, intercept, n of a least-squares line by key; NULL below ``least`` points."""
    d = df.select(*keys, y.alias("_y"), x.alias("_x")).where("_y IS NOT NULL AND _x IS NOT NULL")
    s = d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("_y", "_x").alias("b"), F.regr_intercept("_y", "_x").alias("a"),
        F.regr_sxx("_y", "_x").alias("sxx"), F.regr_syy("_y", "_x").alias("syy"), F.regr_sxy("_y", "_x").alias("sxy"),
    )
    rest = F.greatest(F.col("syy") - ratio(F.col("sxy") * F.col("sxy"), F.col("sxx")), F.lit(0.0))
    se = F.sqrt(ratio(rest, F.greatest(F.col("n") - 2, F.lit(1)) * F.col("sxx")))
    n = F.col("n")
    return s.select(*keys, enough(n, least, F.col("b")).alias("slope"), enough(n, least, se).alias("se_slope"), enough(n, least, F.col("a")).alias("intercept"), "n")


def k_statistics(df: DataFrame, keys: Sequence[str], x: str, least: int) -> DataFrame:
    """Unbiased cumulant estimators k1..k4 by key, from moments about the mean."""
    keys = list(keys)
    means = df.groupBy(*keys).agg(F.avg(x).alias("_m"), F.count(x).alias("n"))
    d = F.col(x) - F.col("_m")
    s = df.join(means, keys).groupBy(*keys, "n", "_m").agg(*[F.sum(F.pow(d, F.lit(p))).alias(f"s{p}") for p in (2, 3, 4)])
    n = F.col("n").cast("double")
    k4 = ratio(n * (n + 1) * F.col("s4") - 3 * (n - 1) * F.col("s2") * F.col("s2"), (n - 1) * (n - 2) * (n - 3))
    return s.where(F.col("n") >= least).select(
        *keys, "n", F.col("_m").alias("k1"), ratio(F.col("s2"), n - 1).alias("k2"), ratio(n * F.col("s3"), (n - 1) * (n - 2)).alias("k3"), k4.alias("k4")
    )
