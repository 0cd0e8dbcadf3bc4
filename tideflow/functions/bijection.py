"""Keyed bijections of 0 .. n - 1: a row's place in a random order from its number alone, without a sort.

A number below a b is taken as (v mod a, v div a). Rounds add a hash of one half to the other, modulo that half's size, which can
be undone, so that numbers below a b are shuffled among themselves. a and b are next to sqrt(n); the few numbers from n on
that a pass gives are sent through it again until one below n comes, which keeps it one to one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import draw_int

#: Rounds of a pass, an even number.
ROUNDS = 6
#: Passes for each number at most. Series of up to MAX_PASSES^2 rows never need more; for others one fails with a chance below 64^-64.
MAX_PASSES = 64
#: Multipliers of the round's hash: odd, and small enough for products of 32 bits by them to stay longs.
MULTIPLIERS = (1_664_525, 1_103_515_245)
_WORD = (1 << 32) - 1


def _hash(half: Column, key: Column) -> Column:
    t = (half * MULTIPLIERS[0] + key).bitwiseAND(F.lit(_WORD))
    t = (t.bitwiseXOR(F.shiftright(t, 15)) * MULTIPLIERS[1]).bitwiseAND(F.lit(_WORD))
    return t.bitwiseXOR(F.shiftright(t, 16))


def _pass(v: Column, a: Column, b: Column, keys: Column) -> Column:
    halves = F.struct((v % a).alias("l"), ((v - v % a) / a).cast("long").alias("r"), a.alias("m"), b.alias("o"))

    def turn(s: Column, key: Column) -> Column:
        return F.struct(s["r"].alias("l"), ((s["l"] + _hash(s["r"], key)) % s["m"]).alias("r"), s["o"].alias("m"), s["m"].alias("o"))

    return F.aggregate(keys, halves, turn, lambda s: s["r"] * a + s["l"])


def place_keys(sizes: DataFrame, parts: Sequence[Column]) -> DataFrame:
    """Adds _a, _b (the halves' sizes) and _keys (a number a round) to ``sizes`` (n, ...): what ``place`` needs for each key of ``parts``."""
    a = F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long")
    d = sizes.withColumn("_a", F.greatest(a, F.lit(1).cast("long")))
    d = d.withColumn("_b", F.greatest(F.ceil(F.col("n") / F.col("_a")), F.lit(1)).cast("long"))
    return d.withColumn("_keys", F.array(*[draw_int(*parts, F.lit(k)) for k in range(ROUNDS)]))


def place(v: Column) -> Column:
    """Where ``v`` (0 .. n - 1) goes, from the columns n, _a, _b and _keys."""
    n, a, b, keys = (F.col(c) for c in ("n", "_a", "_b", "_keys"))
    once = _pass(v.cast("long"), a, b, keys)
    again = F.sequence(F.lit(2), F.lit(MAX_PASSES))
    found = F.aggregate(again, once, lambda p, _: F.when(p < n, p).otherwise(_pass(p, a, b, keys)))
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("no place found")).cast("long"))
