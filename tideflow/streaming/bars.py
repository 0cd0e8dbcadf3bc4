"""The bar builder, block sums and the volatility recursion over streams of ticks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tideflow.functions.scalar import flow_imbalance


def stream_bars(ticks: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars by event time of ticks (series, ts, id, price, volume, is_buy); ticks later than ``late`` are dropped."""
    at = F.struct("ts", "id")
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    bars = timed.groupBy("series", F.window("ts", every).alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.when(F.col("is_buy"), F.col("volume")).otherwise(0.0)).alias("tb_base"), F.count("*").cast("double").alias("trades"),
    )
    return bars.select("series", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "tb_base", "trades")


def stream_flow(bars: DataFrame, normalize: str = "volume") -> DataFrame:
    return bars.select("series", "ts", flow_imbalance(F.col("tb_base"), F.col("volume"), normalize).alias("x"))


def stream_block_sums(ticks: DataFrame, every: str, late: str = "10 minutes") -> DataFrame:
    """Signed flow and trades transferred in tumbling windows."""
    sign = F.when(F.col("is_buy"), F.col("volume")).otherwise(-F.col("volume"))
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("series", F.window("ts", every).alias("w")).agg(F.sum(sign).alias("q"), F.count("*").alias("trades")).select("series", F.col("w.start").alias("ts"), "q", "trades")


def stream_ewma(returns: DataFrame, lam: float = 0.94, seed: float = 1e-8) -> DataFrame:
    """series, idx, sigma of returns (series, idx, r) that arrive in order: the forecast made before each return."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        v = state.get[0] if state.exists else seed
        for pdf in batches:
            pdf = pdf.sort_values("idx")
            out = []
            for r in pdf["r"]:
                out.append(v**0.5)
                v = lam * v + (1 - lam) * (r * r if r == r else 0.0)
            yield pd.DataFrame({"series": pdf["series"], "idx": pdf["idx"], "sigma": out})
        state.update((v,))

    return returns.groupBy("series").applyInPandasWithState(step, "series string, idx long, sigma double", "v double", "append", GroupStateTimeout.NoTimeout)
