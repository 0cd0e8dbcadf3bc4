"""Shocks and what follows them: detection, post-shock ensemble, correlation by age."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.quantiles import quantiles
from tideflow.functions.scalar import ratio
from tideflow.functions.scan import carry
from tideflow.functions.series import BLOCK, blocks, cut, in_block, number, running_sum
from tideflow.functions.stats import grid

#: Candidates that a cluster may hold to be walked in one task.
CLUSTER = 4096


def shock_candidates(sigma: DataFrame, quantile: float = 0.995, after: int = 300, before: int = 200, least: int = 100) -> DataFrame:
    """series, idx, ratio, threshold of returns whose |r| / sigma exceeds its quantile over the whole series (not causal).

    sigma: series, idx, r, sigma. Candidates leave ``before`` rows to the start and ``after`` to the end.
    """
    d = sigma.select("series", "idx", F.when(F.col("sigma") > 0, ratio(F.abs("r"), F.col("sigma"))).alias("ratio"))
    top = quantiles(d, ["series"], F.col("ratio"), [quantile], "_q").where(F.col("_q_n") >= least).select("series", F.col("_q")[0].alias("threshold"))
    rows = d.groupBy("series").agg((F.max("idx") + 1).alias("rows"))
    c = d.join(top, "series").where(F.col("ratio") > F.col("threshold")).join(rows, "series")
    return c.where((F.col("idx") >= before) & (F.col("idx") < F.col("rows") - after)).select("series", "idx", "ratio", "threshold")


def separate(candidates: DataFrame, distance: int = 384, most: int = CLUSTER) -> DataFrame:
    """The first candidate of each series, then always the next at least ``distance`` rows later.

    Up to ``most`` candidates of a series are walked in order. Where there are more, a gap of ``distance`` rows cuts a series:
    the candidate after it is taken whatever was before. Clusters between such gaps are walked, and in those that
    still hold more, pointers to the next candidate that may follow are doubled until all that are taken are reached.
    """
    if candidates.groupBy("series").count().where(F.col("count") > most).isEmpty():
        kept = _walked(candidates.select("series", F.col("idx").alias("_at")), ["series"], distance)
        return candidates.join(kept.withColumnRenamed("_at", "idx"), ["series", "idx"], "left_semi").select(*candidates.columns)
    d = number(candidates, ["series"], F.floor(F.col("idx") / BLOCK), [F.col("idx")], "_nth")
    d = cut(d.withColumnRenamed("idx", "_at").withColumnRenamed("_nth", "idx"))
    prior = blocks(d.select("series", "idx", "_at"), before=1).withColumn("_gap", F.col("_at") - F.lag("_at").over(in_block())).where("_home")
    starts = prior.select("series", "idx", F.when(F.col("_gap").isNull() | (F.col("_gap") >= distance), F.col("_at")).alias("_first"))
    d = cut(d.join(carry(starts, "_first"), ["series", "idx"]))  # a cluster is known by the place of its first
    sizes = d.groupBy("series", "_first").agg(F.count("*").alias("_size"))
    kept = _walked(d.join(sizes.where(F.col("_size") <= most).select("series", "_first"), ["series", "_first"], "left_semi"), ["series", "_first"], distance)
    large = d.join(sizes.where(F.col("_size") > most).select("series", "_first"), ["series", "_first"], "left_semi").select("series", "idx", "_at", "_first")
    if not large.isEmpty():
        kept = kept.unionByName(_reached(d, large, distance))
    return d.join(kept, ["series", "_at"], "left_semi").drop("idx", "_first").withColumnRenamed("_at", "idx").select(*candidates.columns)


def _walked(d: DataFrame, keys: Sequence[str], distance: int) -> DataFrame:
    """(series, _at) taken of the places _at of each key, in order."""
    start = F.struct(F.lit(-(1 << 62)).cast("long").alias("last"), F.slice(F.array(F.lit(0).cast("long")), 1, 0).alias("kept"))
    step = lambda acc, t: F.when(t - acc["last"] >= distance, F.struct(t.alias("last"), F.concat(acc["kept"], F.array(t)).alias("kept"))).otherwise(acc)
    places = d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col("_at").cast("long"))).alias("_all"))
    return places.select("series", F.explode(F.aggregate("_all", start, step, lambda acc: acc["kept"])).alias("_at"))


def _reached(d: DataFrame, large: DataFrame, distance: int) -> DataFrame:
    """(series, _at) of the candidates taken in ``large``, rows of whole clusters of ``d`` (series, idx: number in the series, _at, _first).

    A round knows the first 2^k of each cluster and pointers 2^k steps ahead, so rounds grow with the logarithm of a cluster.
    """
    # a candidate's successor has as its number how many candidates lie before the place from which one may follow
    seen = d.select("series", F.col("_at").alias("_x"), F.lit(1.0).alias("_one"), F.lit(None).cast("long").alias("_from"))
    asked = large.select("series", (F.col("_at") + distance).alias("_x"), F.lit(0.0).alias("_one"), F.col("_at").alias("_from"))  # first at its place
    upto = running_sum(seen.unionByName(asked), ["series"], F.floor(F.col("_x") / BLOCK), [F.col("_x"), F.col("_one")], F.col("_one"), "_before")
    upto = upto.where("_from IS NOT NULL").select("series", F.col("_from").alias("_at"), F.col("_before").cast("long").alias("idx"))
    after = d.select("series", "idx", F.col("_at").alias("_next"), "_first")
    jump = cut(upto.join(after, ["series", "idx"]).join(large.select("series", "_at", "_first"), ["series", "_at", "_first"]).select("series", "_at", "_next"))
    reached = cut(large.where("_at = _first").select("series", "_at"))
    while True:
        new = cut(reached.join(jump, ["series", "_at"]).select("series", F.col("_next").alias("_at")))
        if new.isEmpty():
            return reached
        reached = cut(reached.unionByName(new))
        jump = cut(jump.join(jump.select("series", F.col("_at").alias("_next"), F.col("_next").alias("_after")), ["series", "_next"]).select("series", "_at", F.col("_after").alias("_next")))


def post_shock_field(sigma: DataFrame, shocks: DataFrame, u_max: int) -> DataFrame:
    """series, shock, u, w = |r(shock + u)| / sigma(shock), u = 1..u_max, for shocks with a whole window after them."""
    last = sigma.groupBy("series").agg(F.max("idx").alias("last"))
    at = shocks.select("series", F.col("idx").alias("shock")).join(last, "series").where(F.col("shock") + u_max <= F.col("last"))
    scale = sigma.select("series", F.col("idx").alias("shock"), F.col("sigma").alias("scale")).where("scale > 0")
    spread = at.join(scale, ["series", "shock"]).crossJoin(grid(sigma.sparkSession, "u", range(1, u_max + 1)))
    spread = spread.withColumn("idx", F.col("shock") + F.col("u"))
    return spread.join(sigma.select("series", "idx", "r"), ["series", "idx"]).select("series", "shock", "u", ratio(F.abs("r"), F.col("scale")).alias("w"))


def ensemble_mean(field: DataFrame, keys: Sequence[str] = ("series",)) -> DataFrame:
    """keys, u, m, sd (sample) over shocks."""
    return field.groupBy(*keys, "u").agg(F.avg("w").alias("m"), F.stddev_samp("w").alias("sd"), F.count("w").alias("n"))


def thinned(mean: DataFrame, limit: int = 300) -> DataFrame:
    """A curve (series, u, ...) by every (n // limit)-th of its n points, the first included."""
    n = mean.groupBy("series").agg(F.min("u").alias("_low"), F.greatest(F.expr(f"count(*) div {limit}"), F.lit(1)).alias("step"))
    return mean.join(n, "series").where((F.col("u") - F.col("_low")) % F.col("step") == 0).drop("_low")


def pool(field: DataFrame, name: str = "POOL") -> DataFrame:
    """Shocks of all series as one more series."""
    return field.unionByName(field.select(F.lit(name).alias("series"), (F.col("shock") * 1000003 + F.pmod(F.xxhash64("series"), F.lit(1000003))).alias("shock"), "u", "w"))


def age_correlation(field: DataFrame, edges: Sequence[int], max_lag: int, least: int = 10) -> DataFrame:
    """series, age_bin, lag, rho, n_ages: ensemble correlation at two ages, averaged over the ages of a bin.

    The covariance divides by n and the deviations by n - 1. Ages count from 0 (age u - 1); the
    product table has one row for each shock, age and lag.
    """
    m = ensemble_mean(field)
    d = field.join(m.select("series", "u", "m", "sd"), ["series", "u"]).select("series", "shock", "u", (F.col("w") - F.col("m")).alias("dw"), "sd")
    later = d.select("series", "shock", F.col("u").alias("u2"), F.col("dw").alias("dw2"), F.col("sd").alias("sd2"))
    lags = grid(field.sparkSession, "lag", range(1, max_lag + 1))
    pairs = d.crossJoin(lags).withColumn("u2", F.col("u") + F.col("lag")).join(later, ["series", "shock", "u2"]).where("sd > 0 AND sd2 > 0")
    one = pairs.groupBy("series", "u", "lag", "sd", "sd2").agg(F.avg(F.col("dw") * F.col("dw2")).alias("c"), F.count(F.col("dw") * F.col("dw2")).alias("n"))
    one = one.where(F.col("n") >= least).withColumn("rho", F.col("c") / (F.col("sd") * F.col("sd2")))
    return one.withColumn("age_bin", age_bin(edges)).where("age_bin IS NOT NULL").groupBy("series", "age_bin", "lag").agg(F.avg("rho").alias("rho"), F.count("*").alias("n_ages"))


def resampled_age_correlation(field: DataFrame, weights: DataFrame, edges: Sequence[int], max_lag: int, least: int = 10) -> DataFrame:
    """series, draw, age_bin, lag, rho: ``age_correlation`` of resampled shocks, whose weights count how often each is drawn.

    Sums of products are weighted, so a shock drawn twice costs no further row: with n = sum of
    weights, cov = S_xy / n - m_x m_y and sd^2 = (S_xx - n m^2) / (n - 1). field: complete rows.
    """
    f = field.where("w IS NOT NULL")
    one = f.join(weights, ["series", "shock"]).groupBy("series", "draw", "u").agg(
        F.sum("weight").alias("n"), (F.sum(F.col("weight") * F.col("w")) / F.sum("weight")).alias("m"), F.sum(F.col("weight") * F.col("w") * F.col("w")).alias("ss")
    )
    one = one.select("series", "draw", "u", "m", F.sqrt(F.greatest(ratio(F.col("ss") - F.col("n") * F.col("m") * F.col("m"), F.col("n") - 1), F.lit(0.0))).alias("sd"))
    later = f.select("series", "shock", F.col("u").alias("u2"), F.col("w").alias("w2"))
    pairs = f.crossJoin(grid(field.sparkSession, "lag", range(1, max_lag + 1))).withColumn("u2", F.col("u") + F.col("lag")).join(later, ["series", "shock", "u2"])
    xy = pairs.join(weights, ["series", "shock"]).groupBy("series", "draw", "u", "lag", "u2").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("w") * F.col("w2")).alias("xy"))
    second = one.select("series", "draw", F.col("u").alias("u2"), F.col("m").alias("m2"), F.col("sd").alias("sd2"))
    r = xy.where(F.col("n") >= least).join(one, ["series", "draw", "u"]).join(second, ["series", "draw", "u2"]).where("sd > 0 AND sd2 > 0")
    rho = (F.col("xy") / F.col("n") - F.col("m") * F.col("m2")) / (F.col("sd") * F.col("sd2"))
    return r.withColumn("rho", rho).withColumn("age_bin", age_bin(edges)).where("age_bin IS NOT NULL").groupBy("series", "draw", "age_bin", "lag").agg(F.avg("rho").alias("rho"))


def age_bin(edges: Sequence[int]) -> Column:
    """Bin of age u - 1 among [edge, next edge)."""
    out = F.lit(None).cast("int")
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        out = F.when((F.col("u") - 1 >= a) & (F.col("u") - 1 < b), k).otherwise(out)
    return out


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 3) -> DataFrame:
    """keys, spearman, n: correlation of ranks, ties at their mean rank; NULL below ``least`` rows."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rank = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2
    r = d.select(*keys, rank(x).alias("_x"), rank(y).alias("_y")).groupBy(*keys).agg(F.corr("_x", "_y").alias("c"), F.count("*").alias("n"))
    return r.select(*keys, F.when(F.col("n") >= least, F.col("c")).alias("spearman"), "n")
