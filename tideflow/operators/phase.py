"""Transport by phase of day: observables of each bin of hours, their modulation, and the rotation null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import draw_int, finite, phase_bin, phase_label, ratio
from tideflow.functions.quantiles import quantiles
from tideflow.functions.series import blocks, cut, in_block
from tideflow.operators.symmetry import fit_affinity, symmetry_function

MIN_PER_BIN = 500
OBSERVABLES = ("bias", "activity", "a1", "r1", "f1")


def prepare(bars: DataFrame) -> DataFrame:
    """series, idx, day, hour, e, dp, raw, trades with declared winsorisation over the whole series.

    bars: series, idx, day, hour, e (flow), p (log price), raw (raw flow), volume, trades. dp is the
    next price change. Clip limits (0.99 of trades, 0.995 of |dp|, 0.99 of |raw|) need over 100 values.
    """
    w = in_block()
    d = blocks(bars.select("series", "idx", "day", "hour", "e", "p", "raw", "volume", "trades"), after=1).select("_home", "series", "idx", "day", "hour", finite(F.col("e")).alias("e"), finite(F.lead("p").over(w) - F.col("p")).alias("dp"), finite(F.col("raw")).alias("raw"), finite(F.col("trades")).alias("trades"), "volume", F.lead("idx").over(w).alias("_next"))
    d = d.where("_home AND _next IS NOT NULL").drop("_next", "_home")
    tr, dp, raw = F.when(F.col("trades") > 0, F.col("trades")), F.abs("dp"), F.abs("raw")
    q_bar = F.when((F.col("trades") > 0) & F.col("raw").isNotNull() & F.col("volume").isNotNull(), F.col("volume") / F.col("trades"))
    # four quantities and their quantiles as one long table, so that they are found together
    sought = {"lt": (tr, 0.99), "ld": (dp, 0.995), "lr": (raw, 0.99), "q_bar": (q_bar, 0.5)}
    d = cut(d)
    long = d.select("series", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), x.alias("x")) for k, (x, _) in sought.items()])).alias("_r")).select("series", "_r.*")
    found = quantiles(long, ["series", "k"], F.col("x"), sorted({p for _, p in sought.values()}), "_q")
    at = {p: i for i, p in enumerate(sorted({p for _, p in sought.values()}))}
    pick = lambda k, p: F.max(F.when((F.col("k") == k) & ((F.col("_q_n") > 100) | (F.col("k") == "q_bar")), F.col("_q")[at[p]])).alias(k)
    top = found.groupBy("series").agg(*[pick(k, p) for k, (_, p) in sought.items()])
    clip = lambda x, hi: F.greatest(F.least(x, F.coalesce(hi, x)), F.coalesce(-hi, x))
    d = d.join(top, "series", "left")
    return d.select(
        "series", "idx", "day", "hour", "e", F.when(F.col("dp").isNotNull(), clip(F.col("dp"), F.col("ld"))).alias("dp"),
        F.when(F.col("raw").isNotNull(), clip(F.col("raw"), F.col("lr"))).alias("raw"), F.when(F.col("trades").isNotNull(), F.least("trades", F.coalesce("lt", "trades"))).alias("trades"), "q_bar",
    )


def observables(d: DataFrame, keys: Sequence[str], n_bins: int = 8, least: int = MIN_PER_BIN) -> DataFrame:
    """keys, bin, hours, n, bias, se_bias, activity, a1, se_a1, r1, f1; all NULL in bins of fewer than ``least`` rows."""
    keys = [*keys, "bin"]
    d = d.withColumn("bin", phase_bin(F.col("hour"), n_bins)).where("e IS NOT NULL AND dp IS NOT NULL AND bin IS NOT NULL")
    means = d.groupBy(*keys).agg(F.avg("e").alias("_m"))
    dec = F.col("e") - F.col("_m")
    act, tr = F.col("trades") > 0, (F.col("trades") > 0) & F.col("raw").isNotNull()
    s = d.join(means, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("_m").alias("m"), F.stddev_samp("e").alias("sd"), F.count_if(act).alias("n_act"), F.avg(F.when(act, F.col("trades"))).alias("act"),
        F.avg(F.col("dp") * dec).alias("cov"), F.avg(dec * dec).alias("var"), F.count_if(tr).alias("n_tr"),
        F.var_samp(F.when(tr, F.col("raw"))).alias("vr"), F.avg(F.when(tr, F.col("trades"))).alias("mt"), F.max("q_bar").alias("qb"),
    )
    by_phase = [*keys[:-1], "phase"]  # the symmetry function has bins of its own
    sym = symmetry_function(d.select(*keys[:-1], F.col("bin").alias("phase"), F.col("e").alias("q")), by_phase)
    fit = fit_affinity(sym, by_phase).select(*keys[:-1], F.col("phase").alias("bin"), "a", "se_a")
    ok = lambda x, n="n": F.when((F.col("n") >= least) & (F.col(n) >= least), x)
    return s.join(fit, keys, "left").select(
        *keys, phase_label(F.col("bin"), n_bins).alias("hours"), "n", ok(F.col("m")).alias("bias"), ok(F.col("sd") / F.sqrt("n")).alias("se_bias"), ok(F.col("act"), "n_act").alias("activity"),
        ok(F.col("a")).alias("a1"), ok(F.col("se_a")).alias("se_a1"), ok(F.when(F.col("var") > 0, ratio(F.col("cov"), F.col("var")))).alias("r1"),
        ok(F.when(F.col("qb") > 0, ratio(F.col("vr"), F.col("qb") * F.col("qb") * F.col("mt"))), "n_tr").alias("f1"),
    )


def modulation(obs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, observable, modulation: population variance across bins, from 3 bins on."""
    rows = F.array(*[F.struct(F.lit(o).alias("observable"), F.col(o).alias("v")) for o in OBSERVABLES if o in obs.columns])
    long = obs.select(*keys, F.explode(rows).alias("_r")).select(*keys, "_r.*")
    s = long.groupBy(*keys, "observable").agg(F.var_pop("v").alias("v"), F.count("v").alias("n"))
    return s.select(*keys, "observable", F.when(F.col("n") >= 3, F.col("v")).alias("modulation"))


def rotate_days(d: DataFrame, draws: int, seed: int) -> DataFrame:
    """Adds draw 0 (as observed) to ``draws``: in each draw every day's hours turn by a random amount of its own."""
    # a day's turns are drawn once, not for each of its rows; the rows are dealt out before they are multiplied
    turn = F.when(F.col("draw") == 0, 0).otherwise(F.pmod(draw_int(F.lit(seed), F.col("draw"), F.date_format("day", "yyyy-MM-dd")), F.lit(24)))
    turns = d.select("day").distinct().crossJoin(F.broadcast(d.sparkSession.range(draws + 1).withColumnRenamed("id", "draw"))).select("day", "draw", turn.cast("int").alias("_turn"))
    dealt = d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "series", "day", "hour")
    return dealt.join(turns, "day").withColumn("hour", ((F.col("hour") + F.col("_turn")) % 24).cast("int")).drop("_turn")


def hour_moments(d: DataFrame) -> DataFrame:
    """Sums by (series, day, hour) from which the additive observables of any set of hours follow."""
    d = d.where("e IS NOT NULL AND dp IS NOT NULL")
    d = d.join(d.groupBy("series").agg(F.avg("e").alias("_m")), "series").withColumn("c", F.col("e") - F.col("_m"))
    tr = (F.col("trades") > 0) & F.col("raw").isNotNull()
    act, t, r = F.when(F.col("trades") > 0, F.col("trades")), F.when(tr, F.col("trades")), F.when(tr, F.col("raw"))
    return d.groupBy("series", "day", "hour", "_m", "q_bar").agg(
        F.count("*").alias("n"), F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.sum("dp").alias("d"), F.sum(F.col("dp") * F.col("c")).alias("dc"),
        F.count(act).alias("na"), F.sum(act).alias("sa"), F.count(t).alias("nt"), F.sum(t).alias("st"), F.sum(r).alias("r"), F.sum(r * r).alias("rr"),
    )


def additive_observables(m: DataFrame, keys: Sequence[str], n_bins: int = 8, least: int = MIN_PER_BIN) -> DataFrame:
    """keys, bin, n, bias, activity, r1, f1 from ``hour_moments``: as ``observables`` gives them, for draws over sums instead of rows."""
    keys = [*keys, "bin"]
    names = ("n", "c", "cc", "d", "dc", "na", "sa", "nt", "st", "r", "rr")
    s = m.withColumn("bin", phase_bin(F.col("hour"), n_bins)).where("bin IS NOT NULL").groupBy(*keys, "_m", "q_bar").agg(*[F.sum(c).alias(c) for c in names])
    n, c, cc, d, dc, na, sa, nt, st, r, rr = (F.col(x) for x in names)
    mean, var = c / n, cc - c * c / n
    raw_var = ratio(rr - ratio(r * r, nt), nt - 1)
    ok = lambda x, k=n: F.when((n >= least) & (k >= least), x)
    return s.select(
        *keys, "n", ok(F.col("_m") + mean).alias("bias"), ok(ratio(sa, na), na).alias("activity"), ok(F.when(var > 0, ratio(dc - mean * d, var))).alias("r1"),
        ok(F.when(F.col("q_bar") > 0, ratio(raw_var, F.col("q_bar") * F.col("q_bar") * ratio(st, nt))), nt).alias("f1"),
    )


def phase_affinity(d: DataFrame, keys: Sequence[str], n_bins: int = 8, most: int | None = None) -> DataFrame:
    """keys, bin, a1: the affinity of each bin's flow, whose value bins depend on the draw, so it is counted from rows (``most`` at most in a bin, if known)."""
    rows = d.where("e IS NOT NULL AND dp IS NOT NULL").select(*keys, phase_bin(F.col("hour"), n_bins).alias("phase"), F.col("e").alias("q")).where("phase IS NOT NULL")
    fit = fit_affinity(symmetry_function(rows, [*keys, "phase"], most=most), [*keys, "phase"])
    return fit.select(*keys, F.col("phase").alias("bin"), F.col("a").alias("a1"))


def rotation_null(d: DataFrame, draws: int, seed: int, n_bins: int = 8, least: int = MIN_PER_BIN) -> DataFrame:
    """series, draw, observable, modulation of all observables, as seen (draw 0) and with the days turned.

    All but a1 follow from sums by day and hour, so that draws turn those and not the rows.
    """
    keys = ["series", "draw"]
    most = d.groupBy("series").count().agg(F.max("count")).first()[0] or 0  # a draw has the rows of its series
    sums = additive_observables(rotate_days(hour_moments(d), draws, seed), keys, n_bins, least)
    turned = rotate_days(d.select("series", "day", "hour", "e", "dp"), draws, seed)
    both = sums.join(phase_affinity(turned, keys, n_bins, most), [*keys, "bin"], "left")
    return modulation(both.withColumn("a1", F.when(F.col("n") >= least, F.col("a1"))), keys)


def empirical_p(table: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, observed, p = (1 + #{null >= observed}) / (K + 1), K nulls; draw 0 is the observed one."""
    seen = table.where("draw = 0").select(*keys, F.col(value).alias("observed"))
    null = table.where(F.col("draw") > 0).select(*keys, F.col(value).alias("v")).where("v IS NOT NULL")
    a = seen.join(null, list(keys), "left").groupBy(*keys, "observed").agg(F.count_if(F.col("v") >= F.col("observed")).alias("above"), F.count("v").alias("draws"))
    return a.select(*keys, "observed", F.when(F.col("observed").isNotNull() & (F.col("draws") > 0), (1 + F.col("above")) / (1 + F.col("draws"))).alias("p"), "draws")


def gaussian_transfer(d: DataFrame, n_bins: int = 8, least: int = MIN_PER_BIN) -> DataFrame:
    """series, bin, z = (a1 - 2 mean / variance) / se_a1."""
    s = d.withColumn("bin", phase_bin(F.col("hour"), n_bins)).where("e IS NOT NULL AND dp IS NOT NULL AND bin IS NOT NULL").groupBy("series", "bin").agg(F.avg("e").alias("m"), F.var_samp("e").alias("v"))
    o = observables(d, ["series"], n_bins, least)
    return o.join(s, ["series", "bin"]).select("series", "bin", ratio(F.col("a1") - ratio(2 * F.col("m"), F.col("v")), F.col("se_a1")).alias("z"))


def matched_response(d: DataFrame, n_bins: int = 8, low: float = 0.1, high: float = 0.9, least: int = MIN_PER_BIN) -> DataFrame:
    """series, bin, n, r1, n_matched, activity, r1_matched: R(1) over all of a bin's rows, and over those whose trades all bins share.

    The band goes from the largest of the bins' ``low`` quantiles of trades to the smallest of their ``high`` ones, so that activity
    is matched across bins; ``activity`` is its mean there. Values of fewer than ``least`` rows are NULL, as are all matched ones where the
    bins share nothing. d: as of ``prepare``.
    """
    d = d.withColumn("bin", phase_bin(F.col("hour"), n_bins)).where("e IS NOT NULL AND dp IS NOT NULL AND bin IS NOT NULL AND trades > 0").select("series", "bin", "e", "dp", "trades")
    q = quantiles(d, ["series", "bin"], F.col("trades"), [low, high])
    band = q.groupBy("series").agg(F.max(F.col("q")[0]).alias("_lo"), F.min(F.col("q")[1]).alias("_hi"))
    here = F.col("trades").between(F.col("_lo"), F.col("_hi"))
    s = d.join(band, "series").withColumn("_dp", F.when(here, F.col("dp"))).groupBy("series", "bin").agg(
        F.count("*").alias("n"), F.regr_slope("dp", "e").alias("r1"), F.count("_dp").alias("n_matched"), F.avg(F.when(here, F.col("trades"))).alias("activity"), F.regr_slope("_dp", "e").alias("r1_matched"),
    )
    ok = lambda x, n: F.when(F.col(n) >= least, F.col(x)).alias(x)
    return s.select("series", "bin", "n", ok("r1", "n"), "n_matched", ok("activity", "n_matched"), ok("r1_matched", "n_matched"))


def response_spread(matched: DataFrame) -> DataFrame:
    """series, bins, spread, ratio, spread_matched, ratio_matched: the largest R(1) of the bins less the smallest, and over it where that is positive.

    Only bins with both values count; from 3 on.
    """
    both = matched.where("r1 IS NOT NULL AND r1_matched IS NOT NULL").groupBy("series").agg(F.count("*").alias("bins"), *[f(c).alias(f"{n}_{c}") for c in ("r1", "r1_matched") for f, n in ((F.max, "hi"), (F.min, "lo"))])
    enough = F.col("bins") >= 3
    parts = []
    for c, end in (("r1", ""), ("r1_matched", "_matched")):
        hi, lo = F.col(f"hi_{c}"), F.col(f"lo_{c}")
        parts += [F.when(enough, hi - lo).alias(f"spread{end}"), F.when(enough & (lo > 0), ratio(hi, lo)).alias(f"ratio{end}")]
    return both.select("series", "bins", *parts)
