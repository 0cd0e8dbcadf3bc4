"""Counting statistics of block sums: all block lengths of a grid in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.quantiles import quantiles
from tideflow.functions.scalar import finite, log, ratio
from tideflow.functions.series import whole
from tideflow.functions.stats import grid, k_statistics, ols
from tideflow.operators.flow import compact

MIN_BLOCKS = 30


def net_charge(df: DataFrame, lengths: Sequence[int], value: str = "x") -> DataFrame:
    """series, T, block, q: sums over successive blocks of T values; an incomplete last block is dropped."""
    x = compact(df.select("series", "idx", value), value)
    b = x.crossJoin(grid(df.sparkSession, "T", lengths)).groupBy("series", "T", F.floor(F.col("idx") / F.col("T")).alias("block"))
    return b.agg(F.sum(value).alias("q"), F.count("*").alias("n")).where("n = T").drop("n")


def cumulants(df: DataFrame, lengths: Sequence[int], min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """series, T, n, k1..k4 of the block sums."""
    return k_statistics(net_charge(df, lengths), ["series", "T"], "q", min_blocks)


def cumulant_slopes(cum: DataFrame) -> DataFrame:
    """Log-log slopes of k2 (with error) and, where all have one sign, of |k1| against T."""
    k2 = ols(cum, ["series"], log(F.col("k2")), F.ln("T")).select("series", F.col("slope").alias("slope_k2"), F.col("se_slope").alias("se_slope_k2"), "n")
    signs = cum.groupBy("series").agg((F.min("k1") * F.max("k1") > 0).alias("one_sign"))
    k1 = ols(cum, ["series"], log(F.abs("k1")), F.ln("T")).select("series", F.col("slope").alias("b"))
    return k2.join(signs, "series").join(k1, "series", "left").select("series", "slope_k2", "se_slope_k2", F.when(F.col("one_sign"), F.col("b")).alias("slope_k1"), "n")


def gaussian_affinity(df: DataFrame, lengths: Sequence[int], min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """2 * mean / variance of the block sums, by T."""
    s = net_charge(df, lengths).groupBy("series", "T").agg(F.count("*").alias("n"), F.avg("q").alias("m"), F.var_samp("q").alias("v"))
    return s.where(F.col("n") >= min_blocks).select("series", "T", "n", ratio(2 * F.col("m"), F.col("v")).alias("a_gauss"))


def fano(df: DataFrame, lengths: Sequence[int], min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """Fano factor of raw flow: df has series, idx, flow, volume, trades. series, T, n, q_bar, fano, trades_per_block."""
    ok = df.select("series", "idx", *[finite(F.col(c)).alias(c) for c in ("flow", "volume", "trades")])
    ok = ok.where("flow IS NOT NULL AND volume IS NOT NULL AND trades > 0")
    quantum = quantiles(ok, ["series"], F.col("volume") / F.col("trades"), [0.5], "_q").where(F.col("_q_n") >= 4 * min_blocks).select("series", F.col("_q")[0].alias("q_bar"))
    x = compact(ok, "flow").crossJoin(grid(df.sparkSession, "T", lengths))
    b = x.groupBy("series", "T", F.floor(F.col("idx") / F.col("T")).alias("block")).agg(F.sum("flow").alias("q"), F.sum("trades").alias("tr"), F.count("*").alias("c")).where("c = T")
    s = b.groupBy("series", "T").agg(F.count("*").alias("n"), F.var_samp("q").alias("v"), F.avg("tr").alias("trades_per_block")).where(F.col("n") >= min_blocks)
    return s.join(quantum, "series").select("series", "T", "n", "q_bar", ratio(F.col("v"), F.col("q_bar") * F.col("q_bar") * F.col("trades_per_block")).alias("fano"), "trades_per_block")


def fano_slope(table: DataFrame) -> DataFrame:
    return ols(table, ["series"], log(F.col("fano")), F.ln("T")).select("series", F.col("slope").alias("slope_fano"), "n")


def tranches(df: DataFrame, length: int, pieces: int = 4, min_blocks: int = MIN_BLOCKS) -> DataFrame:
    """Variance of block sums in consecutive pieces of each series; earlier pieces are the longer ones."""
    x = compact(df)
    # pieces of n // pieces rows, the first n % pieces of them one longer
    x = whole(x, n=F.count("*")).withColumn("least", F.expr(f"n div {pieces}"))
    longer = (F.col("least") + 1) * (F.col("n") % pieces)
    late = F.col("idx") - longer
    piece = F.when(late < 0, F.expr("idx div (least + 1)")).otherwise(F.col("n") % pieces + F.floor(F.try_divide(late, F.col("least"))))
    at = F.when(late < 0, F.col("idx") % (F.col("least") + 1)).otherwise(late % F.greatest(F.col("least"), F.lit(1)))
    x = x.withColumn("piece", (piece + 1).cast("int"))
    b = x.withColumn("block", F.floor(at / length)).groupBy("series", "piece", "block").agg(F.sum("x").alias("q"), F.count("*").alias("c")).where(F.col("c") == length)
    s = b.groupBy("series", "piece").agg(F.count("*").alias("n"), F.var_samp("q").alias("var_q"))
    return s.where(F.col("n") >= min_blocks)


def haar_variance(df: DataFrame, scales: Sequence[int], min_pairs: int = 16) -> DataFrame:
    """series, T, n, var_d: variance of the difference of adjacent block sums; and the local slope of its logarithm."""
    x = compact(df).crossJoin(grid(df.sparkSession, "T", scales))
    sign = F.when(F.col("idx") % (2 * F.col("T")) < F.col("T"), -1.0).otherwise(1.0)
    d = x.groupBy("series", "T", F.floor(F.col("idx") / (2 * F.col("T"))).alias("pair")).agg(F.sum(F.col("x") * sign).alias("d"), F.count("*").alias("c")).where("c = 2 * T")
    s = d.groupBy("series", "T").agg(F.count("*").alias("n"), F.var_samp("d").alias("var_d")).where(F.col("n") >= min_pairs)
    return local_slope(s, "var_d")


def local_slope(s: DataFrame, y: str) -> DataFrame:
    """Adds nu: the gradient of ln y by ln T on an uneven grid, one-sided at the ends."""
    w = Window.partitionBy("series").orderBy("T")
    ly, lt = log(F.col(y)), F.ln("T")
    up, dn = F.lead(lt).over(w) - lt, lt - F.lag(lt).over(w)
    fwd, bwd = ratio(F.lead(ly).over(w) - ly, up), ratio(ly - F.lag(ly).over(w), dn)
    mid = (fwd * dn + bwd * up) / (up + dn)
    return s.withColumn("nu", F.coalesce(mid, fwd, bwd))


def nu_blocks(df: DataFrame, octaves: Sequence[int]) -> DataFrame:
    """Slope of ln Var(block sum) against ln T at T = 2^j."""
    v = net_charge(df, [2**j for j in octaves]).groupBy("series", "T").agg(F.var_samp("q").alias("v"))
    return ols(v, ["series"], log(F.col("v")), F.ln("T"), 2).select("series", F.col("slope").alias("nu"), "n")


def affinity_dilution(affinities: DataFrame, variances: DataFrame, short: int = 1, long: int = 16) -> DataFrame:
    """Observed ratio of affinities at two block lengths against long * V_short / V_long."""
    at = lambda c, t: F.max(F.when(F.col("T") == t, F.col(c)))
    a = affinities.groupBy("series").agg(at("a", short).alias("a1"), at("a", long).alias("a2"))
    v = variances.groupBy("series").agg(at("k2", short).alias("v1"), at("k2", long).alias("v2"))
    both = a.join(v, "series").where("a1 IS NOT NULL AND a2 IS NOT NULL AND v1 IS NOT NULL AND v2 IS NOT NULL")
    return both.select("series", ratio(F.col("a2"), F.col("a1")).alias("observed"), ratio(long * F.col("v1"), F.col("v2")).alias("predicted"))
