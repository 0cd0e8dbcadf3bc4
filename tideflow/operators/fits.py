"""Nonlinear fits by group: stretched-exponential relaxation and the post-shock power law."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions import numerics

_KWW = ["log_a", "log_tau_c", "beta", "se_log_a", "se_log_tau_c", "se_beta", "corr_tau_beta", "r2"]


def rolling_transient_fit(surface: DataFrame, r2_min: float = 0.2) -> DataFrame:
    """Stretched exponential of each window's profile; ``valid`` needs convergence, no bound met and R2 >= r2_min."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("lag")
        got = numerics.fit_stretched_exp(pdf["lag"].to_numpy(), pdf["rho"].to_numpy(float))
        row = {"series": pdf["series"].iloc[0], "t_w": pdf["t_w"].iloc[0], **{k: np.nan for k in _KWW}, "edge": False, "converged": False, **(got or {})}
        return pd.DataFrame([{**row, "valid": bool(row["converged"] and not row["edge"] and row["r2"] >= r2_min)}])

    kinds = ", ".join(f"{k} double" for k in _KWW)
    out = surface.select("series", "t_w", "lag", "rho").groupBy("series", "t_w").applyInPandas(fit, f"series string, t_w long, {kinds}, edge boolean, converged boolean, valid boolean")
    return out.withColumns({k: F.when(~F.isnan(k), F.col(k)) for k in _KWW})


def fit_profile(profile: DataFrame, r2_min: float = 0.2) -> DataFrame:
    """The same for one profile a series (series, lag, rho)."""
    return rolling_transient_fit(profile.withColumn("t_w", F.lit(0).cast("long")), r2_min).drop("t_w")


def omori(mean: DataFrame, u_min: int = 1) -> DataFrame:
    """series, p, se_p, m_inf, c, n of m_inf + c (1+u)^-p, from 12 points on. mean: series, u, m."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u")
        m = np.full(int(pdf["u"].max()), np.nan)
        m[pdf["u"].to_numpy(int) - 1] = pdf["m"].to_numpy(float)
        got = numerics.fit_omori(m, u_min)
        return pd.DataFrame([{"series": pdf["series"].iloc[0], **got}] if got else [], columns=["series", "p", "se_p", "m_inf", "c", "n"])

    return mean.select("series", "u", "m").groupBy("series").applyInPandas(fit, "series string, p double, se_p double, m_inf double, c double, n long")
