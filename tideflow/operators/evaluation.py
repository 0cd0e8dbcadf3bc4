"""Forecast evaluation: losses, Diebold-Mariano, splits, features standardised on training rows, contrasts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.quantiles import quantiles
from tideflow.functions.scalar import erfc, finite, log, log_loss, logistic, qlike, ratio
from tideflow.functions.series import blocks, cut, in_block, whole
from tideflow.operators.flow import compact
from tideflow.operators.logit import fit_logistic
from tideflow.operators.vol import realized_vol_forward


def split(df: DataFrame, train: float = 0.6) -> DataFrame:
    """Adds n, cut and oos: whether the row lies at or after floor(train * n) of its series."""
    return whole(df, n=F.max("idx") + 1).withColumn("cut", F.floor(F.col("n") * train)).withColumn("oos", F.col("idx") >= F.col("cut"))


def embargo(df: DataFrame, horizon: int, train: float = 0.6) -> DataFrame:
    """Adds ``train``: rows whose label, ``horizon`` rows long, ends before the out-of-sample part."""
    return split(df, train).withColumn("train", F.col("idx") < F.greatest(F.col("cut") - horizon, F.lit(0)))


def walk_forward_folds(df: DataFrame, train: int, test: int) -> DataFrame:
    """series, fold, train_start, train_end, test_start, test_end (ends exclusive), advancing by ``test``."""
    n = df.groupBy("series").agg((F.max("idx") + 1).alias("n")).where(F.col("n") >= train + test)
    f = n.select("series", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - train - test) / test))).alias("fold"))
    s = F.col("fold") * test
    return f.select("series", "fold", s.alias("train_start"), (s + train).alias("train_end"), (s + train).alias("test_start"), (s + train + test).alias("test_end"))


def losses(df: DataFrame, keys: Sequence[str] = ("series",), least: int = 10) -> DataFrame:
    """keys, n, qlike, rmse of forecasts ``sigma`` of ``rv``; NULL below ``least`` valid rows."""
    q = qlike(F.col("rv"), F.col("sigma"))
    e = F.col("rv") - F.col("sigma")
    s = df.groupBy(*keys).agg(F.count(q).alias("n"), F.avg(q).alias("q"), F.count(e).alias("m"), F.sqrt(F.avg(e * e)).alias("r"))
    return s.select(*keys, "n", F.when(F.col("n") >= least, F.col("q")).alias("qlike"), F.when(F.col("m") >= least, F.col("r")).alias("rmse"))


def diebold_mariano(df: DataFrame, horizon: int, least: int = 30) -> DataFrame:
    """series, n, mean_diff, dm, p of losses la, lb: a positive difference favours b.

    Long-run variance with Bartlett weights over ``horizon`` - 1 lags of the rows where both losses exist.
    """
    d = df.select("series", "idx", (F.col("la") - F.col("lb")).alias("d")).where("d IS NOT NULL")
    d = whole(compact(d, "d"), m=F.avg("d"), n=F.count("*"))
    c = blocks(d.withColumn("c", F.col("d") - F.col("m")), before=horizon)
    lags = range(1, horizon)
    c = c.select("series", "m", "n", "c", "_home", *[(F.col("c") * F.lag("c", k).over(in_block())).alias(f"g{k}") for k in lags]).where("_home")
    g = c.groupBy("series", "m", "n").agg(F.sum(F.col("c") * F.col("c")).alias("g0"), *[F.sum(f"g{k}").alias(f"g{k}") for k in lags])
    n = F.col("n")
    g0 = F.col("g0") / n
    lrv = g0
    for k in lags:
        lrv = lrv + 2 * (1 - k / horizon) * F.coalesce(F.col(f"g{k}"), F.lit(0.0)) / n
    lrv = F.when(lrv > 0, lrv).when(g0 > 0, g0).otherwise(1e-12)
    dm = F.col("m") / F.sqrt(lrv / n)
    s = g.select("series", "n", F.col("m").alias("mean_diff"), F.when(n >= least, dm).alias("dm"))
    return s.withColumn("p", erfc(F.abs("dm") / math.sqrt(2)))


def standardise(df: DataFrame, value: str = "v", lo: float = 0.01, hi: float = 0.99, least: int = 200) -> DataFrame:
    """Adds x: ln v clipped to the training rows' quantiles, with their mean and deviation taken out.

    df has ``train``. v = 0 stands at the lower limit, v < 0 is missing; NULL with fewer than ``least``
    training rows or no spread.
    """
    v = finite(F.col(value))
    d = df.withColumn("_l", log(v)).withColumn("_zero", v == 0)
    tr = lambda c: F.when(F.col("train"), F.col(c))
    d = cut(d)
    d = d.join(quantiles(d, ["series"], tr("_l"), [lo, hi], "_q").drop("_q_n"), "series", "left")
    clipped = F.when(F.col("_zero"), F.col("_q")[0]).otherwise(F.greatest(F.least(F.col("_l"), F.col("_q")[1]), F.col("_q")[0]))
    d = d.withColumn("_c", F.when(F.col("_zero") | F.col("_l").isNotNull(), clipped))
    d = whole(d, _m=F.avg(tr("_c")), _s=F.stddev_pop(tr("_c")), _n=F.count(tr("_c")))
    return d.withColumn("x", F.when((F.col("_n") >= least) & (F.col("_s") > 0), (F.col("_c") - F.col("_m")) / F.col("_s"))).drop("_l", "_zero", "_q", "_c", "_m", "_s", "_n")


def transition_target(base: DataFrame, horizon: int, train: float = 0.6, quantile: float = 0.8, least: int = 200) -> DataFrame:
    """series, idx, s (1 if rv / sigma exceeds the training quantile theta), ratio, theta. base: series, idx, r, sigma."""
    d = embargo(base.join(realized_vol_forward(base, horizon), ["series", "idx"]), horizon, train)
    d = d.withColumn("ratio", F.when(F.col("sigma") > 0, ratio(F.col("rv"), F.col("sigma"))))
    known = F.when(F.col("train"), F.col("ratio"))
    d = cut(d.select("series", "idx", "ratio", "train"))
    theta = quantiles(d, ["series"], known, [quantile], "_q").where(F.col("_q_n") >= least).select("series", F.col("_q")[0].alias("theta"))
    d = d.join(theta, "series", "left")
    return d.select("series", "idx", (F.col("ratio") > F.col("theta")).cast("int").alias("s"), "ratio", "theta")


def _two_fits(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """series, b1 (of y on 1, a), b2 (of y on 1, a, b), n: least squares from covariances, in one aggregation."""
    cov = {(u, v): F.covar_pop(u, v).alias(f"{u}{v}") for u, v in ((a, a), (a, b), (b, b), (a, y), (b, y))}
    s = df.groupBy("series").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in (a, b, y)], *cov.values())
    g = {k: F.col(f"{k[0]}{k[1]}") for k in cov}
    det = g[a, a] * g[b, b] - g[a, b] * g[a, b]
    one = ratio(g[a, y], g[a, a])
    two = (ratio(g[b, b] * g[a, y] - g[a, b] * g[b, y], det), ratio(g[a, a] * g[b, y] - g[a, b] * g[a, y], det))
    m = {c: F.col(f"m_{c}") for c in (a, b, y)}
    return s.select("series", F.array(m[y] - one * m[a], one).alias("b1"), F.array(m[y] - two[0] * m[a] - two[1] * m[b], *two).alias("b2"), "n")


def feature_contrast(base: DataFrame, feature: DataFrame, horizon: int, train: float = 0.6, least: int = 200) -> DataFrame:
    """Does a feature add to a recalibrated volatility forecast? One row a series.

    base: series, idx, r, sigma. feature: series, idx, v. ln rv is regressed on ln sigma, and on ln
    sigma and the standardised feature, over the same embargoed training rows; losses and tests are out
    of sample. dm_context sets raw against recalibrated, dm_decisive recalibrated against with feature.
    """
    d = base.join(realized_vol_forward(base, horizon), ["series", "idx"]).join(feature.select("series", "idx", "v"), ["series", "idx"], "left")
    d = standardise(embargo(d, horizon, train), "v", least=least)
    d = d.withColumn("y", log(F.col("rv"))).withColumn("ls", log(F.col("sigma"))).where("y IS NOT NULL AND ls IS NOT NULL AND x IS NOT NULL")
    fit = _two_fits(d.where("train").select("series", "y", "ls", "x"), "y", "ls", "x").where(F.col("n") >= least)
    o = d.where("oos").drop("n").join(fit.withColumnRenamed("n", "n_train"), "series")
    s1 = F.exp(F.col("b1")[0] + F.col("b1")[1] * F.col("ls"))
    s2 = F.exp(F.col("b2")[0] + F.col("b2")[1] * F.col("ls") + F.col("b2")[2] * F.col("x"))
    q = {"raw": F.col("sigma"), "recal": s1, "full": s2}
    o = cut(o.select("series", "idx", "n_train", "b2", "x", "y", *[qlike(F.col("rv"), v).alias(f"q_{k}") for k, v in q.items()]))
    s = o.groupBy("series", "n_train", F.col("b2")[2].alias("coef_x")).agg(F.count("*").alias("n_oos"), *[F.avg(f"q_{k}").alias(f"qlike_{k}") for k in q], F.when(F.count("*") > 50, F.corr("x", "y")).alias("corr_x"))
    dm = lambda a, b, n: diebold_mariano(o.select("series", "idx", F.col(a).alias("la"), F.col(b).alias("lb")), horizon).select("series", F.col("dm").alias(n))
    return s.join(dm("q_raw", "q_recal", "dm_context"), "series", "left").join(dm("q_recal", "q_full", "dm_decisive"), "series", "left")


def transition_contrast(base: DataFrame, feature: DataFrame, horizon: int, train: float = 0.6, least_train: int = 200, least_eval: int = 100) -> DataFrame:
    """Does a feature help to foresee transitions? Logistic on ln sigma, and on ln sigma and the feature; log losses and DM out of sample."""
    t = transition_target(base, horizon, train)
    d = base.join(t, ["series", "idx"]).join(feature.select("series", "idx", "v"), ["series", "idx"], "left")
    d = standardise(embargo(d, horizon, train), "v", least=least_train).withColumn("ls", log(F.col("sigma")))
    d = d.where("s IS NOT NULL AND ls IS NOT NULL AND x IS NOT NULL").select("series", "idx", "s", "ls", "x", "train", "oos")

    # both models in the same rounds: the one without the feature sees 0 in its place, where the ridge holds its coefficient
    d = cut(d)
    both = d.where("train").select("series", F.explode(F.array(F.lit(1), F.lit(2))).alias("model"), "s", "ls", "x").withColumn("x", F.when(F.col("model") == 2, F.col("x")).otherwise(0.0))
    fits = fit_logistic(both, "s", ["ls", "x"], ["series", "model"], least_train)
    b = fits.groupBy("series").agg(F.max(F.when(F.col("model") == 1, F.col("b"))).alias("b1"), F.max(F.when(F.col("model") == 2, F.col("b"))).alias("b2"), F.max("n").alias("n_train")).where("b1 IS NOT NULL AND b2 IS NOT NULL")
    o = d.where("oos").join(b, "series")
    p1 = logistic(F.col("b1")[0] + F.col("b1")[1] * F.col("ls"))
    p2 = logistic(F.col("b2")[0] + F.col("b2")[1] * F.col("ls") + F.col("b2")[2] * F.col("x"))
    o = cut(o.select("series", "idx", "s", "n_train", F.col("b2")[2].alias("coef_x"), log_loss(p1, F.col("s")).alias("la"), log_loss(p2, F.col("s")).alias("lb")))
    s = o.groupBy("series", "n_train", "coef_x").agg(F.count("*").alias("n_oos"), F.avg("la").alias("loss_base"), F.avg("lb").alias("loss_full"), F.count_distinct("s").alias("classes"))
    s = s.where((F.col("n_oos") >= least_eval) & (F.col("classes") == 2)).drop("classes")
    return s.join(diebold_mariano(o, horizon).select("series", "dm", "p"), "series", "left")


def within(table: DataFrame, value: Column, bound: float, share: float, keys: Sequence[str] = ()) -> DataFrame:
    """keys, hits, n, verdict: whether at least ``share`` of the values present lie within the bound, either side of 0."""
    s = table.groupBy(*keys).agg(F.count_if(F.abs(value) < bound).alias("hits"), F.count(value).alias("n"))
    return s.withColumn("verdict", (F.col("n") > 0) & (F.col("hits") >= F.col("n") * share))


def above_null(draws: DataFrame, keys: Sequence[str], value: str, quantile: float = 0.975) -> DataFrame:
    """keys, observed, limit, verdict: whether draw 0 lies above a quantile of the other draws."""
    null, seen = F.when(F.col("draw") > 0, F.col(value)), F.when(F.col("draw") == 0, F.col(value))
    s = draws.groupBy(*keys).agg(F.max(seen).alias("observed"), F.percentile(null, F.lit(quantile)).alias("limit"))
    return s.withColumn("verdict", F.coalesce(F.col("observed") > F.col("limit"), F.lit(False)))


def replicated(table: DataFrame, p: Column, keys: Sequence[str], level: float = 0.05, share: float = 0.75) -> DataFrame:
    """keys, hits, n, verdict: whether at least ``share`` of the rows have p below ``level``."""
    s = table.groupBy(*keys).agg(F.count_if(p < level).alias("hits"), F.count("*").alias("n"))
    return s.withColumn("verdict", F.col("hits") >= F.col("n") * share)
