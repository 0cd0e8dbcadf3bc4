"""Flow and return series of a bar table, and the two grids' alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite, flow_imbalance, log
from tideflow.functions.scan import carry
from tideflow.functions.series import BLOCK, blocks, in_block, number


def imbalance(bars: DataFrame, normalize: str = "volume") -> DataFrame:
    """series, idx, x: the signed flow of each bar."""
    return bars.select("series", "idx", flow_imbalance(F.col("tb_base"), F.col("volume"), normalize).alias("x"))


def log_returns(bars: DataFrame) -> DataFrame:
    """series, idx, r with r[i] = ln close[i+1] - ln close[i]; one row fewer than bars."""
    b = blocks(bars.select("series", "idx", log(F.col("close")).alias("_p")), after=1)
    b = b.select("series", "idx", "_home", (F.lead("_p").over(in_block()) - F.col("_p")).alias("r"), F.lead("idx").over(in_block()).alias("_next"))
    return b.where("_home AND _next IS NOT NULL").select("series", "idx", "r")


def price_and_flow(bars: DataFrame, normalize: str = "volume") -> DataFrame:
    """series, idx, p (log of the open, the price before the bar's flow), e (flow)."""
    return bars.select("series", "idx", log(F.col("open")).alias("p"), flow_imbalance(F.col("tb_base"), F.col("volume"), normalize).alias("e"))


def compact(df: DataFrame, value: str = "x") -> DataFrame:
    """Drops missing values and numbers what is left anew."""
    kept = df.withColumn(value, finite(F.col(value))).where(F.col(value).isNotNull())
    return number(kept.withColumnRenamed("idx", "_at"), ["series"], F.floor(F.col("_at") / BLOCK), [F.col("_at")]).drop("_at")


def align_to_returns(features: DataFrame, bars: DataFrame, block: int = BLOCK) -> DataFrame:
    """A feature known at bar ends (series, t_w, v) on the return grid: at i stands the last value known at bar i+1."""
    f = features.select("series", F.col("t_w").alias("idx"), "v")
    dense = carry(bars.select("series", "idx").join(f, ["series", "idx"], "left"), "v", block)
    return dense.select("series", (F.col("idx") - 1).alias("idx"), "v").where("idx >= 0")
