"""Synthetic series as sources, one task a series: positive controls with a known answer."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tideflow.functions import numerics


def _series(spark: SparkSession, names: Sequence[str], make: Callable[[int], np.ndarray]) -> DataFrame:
    seeds = spark.createDataFrame([(n, k) for k, n in enumerate(names)], "series string, seed long")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        x = make(int(pdf["seed"].iloc[0]))
        return pd.DataFrame({"series": pdf["series"].iloc[0], "idx": np.arange(len(x)), "x": x})

    return seeds.groupBy("series").applyInPandas(fill, "series string, idx long, x double")


def power_law_flow(spark: SparkSession, n: int, gamma: float, mu: float = 0.0, names: Sequence[str] = ("flow",)) -> DataFrame:
    """Gaussian flow with autocorrelation (1 + lag)^gamma, unit deviation and mean ``mu``."""
    return _series(spark, names, lambda seed: numerics.synthetic_flow(n, gamma, mu, seed))


def stretched_series(spark: SparkSession, n: int, tau: float, beta: float, names: Sequence[str] = ("kww",)) -> DataFrame:
    """Gaussian series with autocorrelation exp(-(lag / tau)^beta)."""
    return _series(spark, names, lambda seed: numerics.synthetic_stretched(n, tau, beta, seed))


def fractional_noise(spark: SparkSession, n: int, hurst: float, names: Sequence[str] = ("fgn",)) -> DataFrame:
    return _series(spark, names, lambda seed: numerics.fractional_noise(n, hurst, seed))
