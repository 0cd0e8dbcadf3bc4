"""Exact quantiles of very many values, for all keys and ranks at once.

Doubles are mapped to longs in the same order. A first count by the leading bits finds the bin that holds each
rank, a second one splits that bin by the next bits, and a third by the last, where a bin is a single value. So
each pass counts what it reads in bins of a bounded number, combined before the shuffle, and no task or buffer
holds the distinct values of a key. Where no key has more values than a buffer may hold, the aggregate that keeps
them gives the same doubles in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite

#: Bits of the second and third digit; the first has the sign, the exponent and what is left of the mantissa.
DIGIT = 22
#: Values of a key that an aggregate may hold.
LOCAL_VALUES = 1 << 20
_MANTISSA = 1 << 52
_LEAST_EXPONENT = -1022
_LEAST = 5e-324


def ordered_bits(x: Column) -> Column:
    """A long for each finite double, in the same order; both zeros get the same. From the value by powers of two, which are exact."""
    a = F.abs(x)
    power = lambda e: F.pow(F.lit(2.0), e)
    guess = F.floor(F.log2(a)).cast("double")  # may be one off next to a power of two
    e = guess + F.when(a < power(guess), -1.0).when(a / power(guess) >= 2, 1.0).otherwise(0.0)
    normal = ((e - _LEAST_EXPONENT) * float(_MANTISSA)).cast("long") + (a / power(e) * float(_MANTISSA)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a < 2.0**_LEAST_EXPONENT, (a / F.lit(_LEAST)).cast("long")).otherwise(normal)
    return F.when(x < 0, -bits).otherwise(bits)


def _descend(counts: DataFrame, keys: Sequence[str], digit: str, wanted: DataFrame) -> DataFrame:
    """(keys, digit, rank, rest): the bin of each wanted rank; ``rest`` is the rank within the bin. counts: keys, digit, n, ...; wanted: keys, rank, rest."""
    before = Window.partitionBy(*keys).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    upto = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ranks = wanted.groupBy(*keys).agg(F.collect_list(F.struct("rank", "rest")).alias("_ranks"))
    here = F.filter("_ranks", lambda r: (r["rest"] >= F.col("_before")) & (r["rest"] < F.col("_before") + F.col("n")))
    found = upto.join(ranks, list(keys)).withColumn("_r", F.explode(here))
    return found.withColumns({"rank": F.col("_r.rank"), "rest": F.col("_r.rest") - F.col("_before")}).drop("_before", "_ranks", "_r", "n")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: Sequence[float], out: str = "q", local: int = LOCAL_VALUES, most: int | None = None) -> DataFrame:
    """keys, ``out`` (an array, one entry for each of ``probs``), ``out``_n (values counted): linear interpolation between order statistics.

    Missing and non-finite values don't count; keys (no nulls) without values have no row. Equal bit by bit to ``percentile``.
    ``most`` is a number of values that no key exceeds, where the caller knows one; else they are counted.
    """
    keys = list(keys)
    x = df.select(*keys, finite(value.cast("double")).alias("_x")).where("_x IS NOT NULL")
    if most is not None and most <= local or x.groupBy(*keys).count().where(F.col("count") > local).isEmpty():
        return x.groupBy(*keys).agg(F.percentile("_x", [float(p) for p in probs]).alias(out), F.count("*").alias(f"{out}_n"))
    x = x.withColumn("_bits", ordered_bits(F.col("_x")))
    low = (1 << DIGIT) - 1
    x = x.select(*keys, "_x", F.shiftright("_bits", 2 * DIGIT).alias("_d1"), F.shiftright("_bits", DIGIT).bitwiseAND(low).alias("_d2"), F.col("_bits").bitwiseAND(low).alias("_d3"))

    first = x.groupBy(*keys, "_d1").agg(F.count("*").alias("n"))
    total = first.groupBy(*keys).agg(F.sum("n").alias("_n"))
    place = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    ends = F.array_distinct(F.array(*[f(h).cast("long") for h in place for f in (F.floor, F.ceil)]))
    wanted = total.select(*keys, F.explode(ends).alias("rank")).withColumn("rest", F.col("rank"))
    one = _descend(first, keys, "_d1", wanted)

    inside = x.join(one.select(*keys, "_d1").distinct(), [*keys, "_d1"], "left_semi")
    two = _descend(inside.groupBy(*keys, "_d1", "_d2").agg(F.count("*").alias("n")), [*keys, "_d1"], "_d2", one)
    inside = x.join(two.select(*keys, "_d1", "_d2").distinct(), [*keys, "_d1", "_d2"], "left_semi")
    last = inside.groupBy(*keys, "_d1", "_d2", "_d3").agg(F.count("*").alias("n"), F.min("_x").alias("_v"))
    three = _descend(last, [*keys, "_d1", "_d2"], "_d3", two)

    got = three.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", (F.col("_v") + 0.0).alias("v")))).alias("_at"))  # two entries a prob at most
    at = lambda r: F.element_at("_at", r.cast("long"))

    def between(h: Column) -> Column:
        lo, hi = F.floor(h), F.ceil(h)
        return F.when((lo == hi) | (at(lo) == at(hi)), at(lo)).otherwise((hi - h) * at(lo) + (h - lo) * at(hi))

    return got.join(total, keys).select(*keys, F.array(*[between(h) for h in place]).alias(out), F.col("_n").alias(f"{out}_n"))
