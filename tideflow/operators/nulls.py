"""Null distributions as relational plans: draws are rows, draw 0 is the observed sample."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.bijection import place, place_keys
from tideflow.functions.scalar import draw_int, finite
from tideflow.functions.series import BLOCK, blocks, cut, in_block, number
from tideflow.operators.blocks import nu_blocks

#: Random events at first look at this many places for each that is wanted, and this many more.
FIRST_LOOK = (4, 64)


def _draws(df: DataFrame, draws: int) -> DataFrame:
    return df.crossJoin(F.broadcast(df.sparkSession.range(draws + 1).withColumnRenamed("id", "draw")))


def sign_flip(df: DataFrame, draws: int, seed: int, value: str = "x") -> DataFrame:
    """series (series, draw joined by '#'), idx, x: sizes kept, signs drawn anew; kills sign and signed memory."""
    sign = F.when(F.pmod(draw_int(F.lit(seed), F.col("draw"), F.col("idx")), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    d = _draws(df.select("series", "idx", finite(F.col(value)).alias("x")), draws)
    return d.select("series", "draw", "idx", F.when(F.col("draw") == 0, F.col("x")).otherwise(F.abs("x") * sign).alias("x"))


def permutation(df: DataFrame, draws: int, seed: int, value: str = "x") -> DataFrame:
    """series, draw, idx, x: values in random order; keeps the marginal, kills memory.

    A row's place follows from (seed, series, draw, idx) by a keyed bijection of the series' places, so nothing is sorted or
    numbered; rows must be numbered from 0. Where places have no row, the places of the result have none either.
    """
    d = df.select("series", "idx", finite(F.col(value)).alias("x"))
    sizes = _draws(d.groupBy("series").agg((F.max("idx") + 1).alias("n")), draws)
    keyed = place_keys(sizes, [F.lit(seed), F.col("series"), F.col("draw")])
    return d.join(keyed, "series").select("series", "draw", F.when(F.col("draw") == 0, F.col("idx")).otherwise(place(F.col("idx"))).alias("idx"), "x")


def as_series(drawn: DataFrame) -> DataFrame:
    """One series for each draw, so that every operator by series runs over the nulls too."""
    return drawn.withColumn("series", F.concat_ws("#", "series", "draw")).drop("draw")


def of_series(df: DataFrame) -> DataFrame:
    """The inverse of ``as_series`` on a result."""
    return df.withColumn("draw", F.substring_index("series", "#", -1).cast("long")).withColumn("series", F.expr("substring(series, 1, length(series) - length(substring_index(series, '#', -1)) - 1)"))


def summarise(table: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """keys, observed, q025, median, q975 of the null draws."""
    null = F.when(F.col("draw") > 0, F.col(value))
    s = table.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col(value))).alias("observed"), F.percentile(null, [0.025, 0.5, 0.975]).alias("q"), F.count(null).alias("n"))
    ok = F.col("n") >= least
    return s.select(*keys, "observed", *[F.when(ok, F.col("q")[i]).alias(n) for i, n in enumerate(("q025", "median", "q975"))])


def max_t(cells: DataFrame) -> DataFrame:
    """cell, stat, p: family-wise p = (1 + #{draw maxima >= stat}) / (K + 1). cells: draw, cell, stat (draw 0 observed).

    A draw's maximum runs over the observed cells; missing statistics are skipped. Raises without an
    observed statistic or without draws.
    """
    seen = cells.where("draw = 0 AND stat IS NOT NULL").select("cell", "stat")
    if seen.isEmpty():
        raise ValueError("no observed statistic")
    top = cells.where(F.col("draw") > 0).join(seen.select("cell"), "cell", "left_semi").groupBy("draw").agg(F.max("stat").alias("t")).where("t IS NOT NULL")
    draws = top.count()
    if not draws:
        raise ValueError("the null is empty")
    # ranks of statistics among the sorted maxima, rather than a product of both
    both = seen.select(F.lit(1).alias("g"), "cell", F.col("stat").alias("v")).unionByName(top.select(F.lit(1).alias("g"), F.lit(None).cast(seen.schema["cell"].dataType).alias("cell"), F.col("t").alias("v")))
    above = F.count_if(F.col("cell").isNull()).over(Window.partitionBy("g").orderBy(F.col("v").desc()))
    return both.withColumn("above", above).where("cell IS NOT NULL").select("cell", F.col("v").alias("stat"), ((1 + F.col("above")) / (1 + draws)).alias("p"))


def max_t_summary(cells: DataFrame) -> DataFrame:
    """mean, sd (population), q95 of the draws' maxima, and the best observed cell (largest statistic, then name)."""
    seen = cells.where("draw = 0 AND stat IS NOT NULL")
    top = cells.where(F.col("draw") > 0).join(seen.select("cell"), "cell", "left_semi").groupBy("draw").agg(F.max("stat").alias("t"))
    s = top.agg(F.avg("t").alias("mean_max"), F.stddev_pop("t").alias("sd_max"), F.percentile("t", F.lit(0.95)).alias("q95_max"), F.count("t").alias("draws"))
    best = seen.agg(F.min(F.struct((-F.col("stat")).alias("s"), F.col("cell").alias("cell"))).alias("b"))
    return s.crossJoin(best).select("mean_max", "sd_max", "q95_max", "draws", F.col("b.cell").alias("best_cell"), (-F.col("b.s")).alias("best_stat"))


def bootstrap_weights(units: DataFrame, draws: int, seed: int, unit: str = "shock") -> DataFrame:
    """series, draw, unit, weight: how often each unit is drawn with replacement; draw 0 takes each once.

    Weighted sums over them equal sums over the resampled units, without repeating their rows.
    """
    u = units.select("series", unit).distinct()
    u = u.withColumn("k", F.row_number().over(Window.partitionBy("series").orderBy(unit)) - 1)
    n = u.groupBy("series").agg(F.count("*").alias("n"))
    d = _draws(u.join(n, "series"), draws).where(F.col("draw") > 0)
    pick = F.pmod(draw_int(F.lit(seed), F.col("draw"), F.col("k")), F.col("n"))
    w = d.select("series", "draw", pick.cast("int").alias("k")).groupBy("series", "draw", "k").agg(F.count("*").alias("weight"))
    w = w.join(u.select("series", "k", unit), ["series", "k"]).select("series", "draw", unit, "weight")
    return u.select("series", F.lit(0).cast("long").alias("draw"), unit, F.lit(1).cast("long").alias("weight")).unionByName(w)


def bootstrap_mean(field: DataFrame, draws: int, seed: int) -> DataFrame:
    """series, draw, u, m: ensemble mean of resampled shocks."""
    w = bootstrap_weights(field, draws, seed)
    a = field.join(w, ["series", "shock"]).groupBy("series", "draw", "u").agg(F.sum(F.col("w") * F.col("weight")).alias("s"), F.sum(F.when(F.col("w").isNotNull(), F.col("weight"))).alias("n"))
    return a.select("series", "draw", "u", F.try_divide("s", "n").alias("m"))


def _apart(places: DataFrame, distance: int) -> DataFrame:
    """The places (series, idx, u) that stay if they are taken in the order of u, then idx, each ``distance`` or more from those before.

    A place stays once no undecided one within reach comes before it; what it reaches then goes. A round does so for all
    places at once, in blocks that borrow what two reaches hold, and few rounds decide all, since the order has nothing to do with the place.
    """
    reach = distance - 1
    near = in_block().rangeBetween(-reach, reach)
    kept, left = [], places
    while True:
        d = blocks(left, 2 * reach, 2 * reach, max(BLOCK, 2 * distance)).withColumn("_first", F.min(F.struct("u", "idx")).over(near)["idx"] == F.col("idx"))
        d = d.withColumn("_gone", F.max("_first").over(near)).where("_home")
        d = cut(d.select("series", "idx", "u", "_first", "_gone"))
        kept.append(d.where("_first").select("series", "idx", "u"))
        left = d.where("NOT _gone").select("series", "idx", "u")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, kept)


def random_events(sigma: DataFrame, counts: DataFrame, draws: int, seed: int, distance: int = 384, after: int = 300, before: int = 200) -> DataFrame:
    """series, draw, idx: for each series as many random places as it had shocks (series, n), ``distance`` apart from each other.

    Places are rows from ``before`` on that leave ``after`` rows behind them, tried in the order of a random number of (draw,
    series, idx); those too near to one taken are passed over. Fewer are found where no more fit; series without places or counts have no
    row. Only places early in that order are looked at; draws that want more get eight times as many, up to all.
    """
    if distance < 1:
        raise ValueError("a distance of one row at least")
    size = sigma.groupBy("series").agg((F.max("idx") + 1).alias("rows")).join(counts.select("series", "n").where("n > 0"), "series")
    room = F.greatest(F.col("rows") - after - before, F.lit(1))
    # while half of the room stays free, at least every other place is taken
    share = F.when(2 * distance * F.col("n") <= room / 2, F.least((FIRST_LOOK[0] * F.col("n") + FIRST_LOOK[1]) / room, F.lit(1.0))).otherwise(1.0)
    spark = sigma.sparkSession
    want = cut(size.crossJoin(F.broadcast(spark.range(1, draws + 1).withColumnRenamed("id", "draw"))).select("series", "draw", "rows", "n", share.alias("share")))
    found = []
    while True:
        u = draw_int(F.lit(seed), F.col("draw"), F.col("series"), F.col("idx"))
        places = sigma.select("series", "idx").join(want, "series").where((F.col("idx") >= before) & (F.col("idx") < F.col("rows") - after))
        places = places.withColumn("u", u).where(F.col("u") < F.col("share") * 2.0**32)
        taken = _apart(as_series(places.select("series", "draw", "idx", "u")), distance)
        taken = of_series(number(taken, ["series"], F.shiftright("u", 20), [F.col("u"), F.col("idx")], "place"))
        taken = cut(taken.join(want.select("series", "draw", "n", "share"), ["series", "draw"]))
        short = taken.groupBy("series", "draw").agg(F.count("*").alias("_got"))
        short = cut(want.join(short, ["series", "draw"], "left").where((F.col("share") < 1) & (F.coalesce("_got", F.lit(0)) < F.col("n"))).select("series", "draw"))
        found.append(taken.where("place < n").join(short, ["series", "draw"], "left_anti").select("series", "draw", "idx"))
        if short.isEmpty():
            return reduce(DataFrame.unionByName, found)
        want = cut(want.join(short, ["series", "draw"], "left_semi").withColumn("share", F.least(8 * F.col("share"), F.lit(1.0))))


def drift_sweep(df: DataFrame, amplitudes: Sequence[float], octaves: Sequence[int], least: float = 0.2) -> DataFrame:
    """series, amplitude, nu, shift, moved: the block exponent under ramps of rising amplitude (0: none), and whether it has moved.

    Amplitudes are a grid of cases, all measured in one pass; the first with ``moved`` ends a sweep.
    """
    cases = df.select("series", F.lit(0.0).alias("amplitude"), "idx", "x")
    for a in amplitudes:
        cases = cases.unionByName(drift(df, a).select("series", F.lit(float(a)).alias("amplitude"), "idx", "x"))
    keyed = cases.select(F.concat_ws("\x1f", "series", F.col("amplitude").cast("string")).alias("series"), "idx", "x")
    nu = nu_blocks(keyed, octaves).select(F.split("series", "\x1f")[0].alias("series"), F.split("series", "\x1f")[1].cast("double").alias("amplitude"), "nu")
    clean = nu.where("amplitude = 0").select("series", F.col("nu").alias("clean"))
    shift = F.col("nu") - F.col("clean")
    return nu.join(clean, "series").select("series", "amplitude", "nu", shift.alias("shift"), (F.abs(shift) >= least).alias("moved"))


def drift(df: DataFrame, amplitude: float, power: int = 1, value: str = "x") -> DataFrame:
    """Adds amplitude * t^power, t in 0..1 along each series: a positive control of trend immunity."""
    n = df.groupBy("series").agg(F.max("idx").alias("_n"))
    t = F.col("idx") / F.greatest(F.col("_n"), F.lit(1))
    return df.join(n, "series").withColumn(value, F.col(value) + amplitude * F.pow(t, F.lit(power))).drop("_n")
