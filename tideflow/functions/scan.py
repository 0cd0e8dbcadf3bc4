"""Recursions over long series as associative scans.

What a row does to a state is a small record, and two records in a row make one of the same kind. The rows of a
block are composed in order, block totals likewise one level up, and every row's composite follows from those of
the blocks before and of the rows before it in its block. No task holds more of a series than a block, but for
the top level: a record for each BLOCK^2 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.functions.series import BLOCK

#: Rows of a block of a scan.
SCAN_BLOCK = 512
Record = dict[str, Column]
Combine = Callable[[Record, Record], Record]


def _composed(rows: Column, names: Sequence[str], combine: Combine, identity: Record) -> tuple[Column, Column]:
    """Of a block's records in order: the composites before each of them, and that of all."""
    record = lambda r: F.struct(*[r[c].alias(c) for c in names])
    of = lambda x: {c: x[c] for c in names}
    one = record(identity)
    total = F.aggregate(rows, one, lambda acc, x: record(combine(of(acc), of(x))))
    none = F.slice(F.array(one), 1, 0)
    step = lambda acc, x: F.struct(record(combine(of(acc["s"]), of(x))).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out"))
    before = F.aggregate(rows, F.struct(one.alias("s"), none.alias("out")), step, lambda acc: acc["out"])
    return before, total


def scan(df: DataFrame, names: Sequence[str], combine: Combine, identity: Record, block: int = SCAN_BLOCK, levels: int = 2) -> DataFrame:
    """``df`` (series, idx from 0 without gaps, names, ...) with ``names`` replaced by the composite of all records before the row.

    ``combine(l, r)`` is the record of doing l, then r; it must be associative.
    """
    others = [c for c in df.columns if c not in ("series", "idx", *names)]
    own = F.floor(F.col("idx") / block) if levels else F.lit(0).cast("long")
    rows = df.groupBy("series", own.alias("_block")).agg(F.sort_array(F.collect_list(F.struct("idx", *names, *others))).alias("_rows"))
    before, total = _composed(F.col("_rows"), names, combine, identity)
    out = rows.withColumn("_before", before)
    if levels:
        heads = rows.select("series", F.col("_block").alias("idx"), total.alias("_t")).select("series", "idx", "_t.*")
        heads = scan(heads, names, combine, identity, block, levels - 1)
        out = out.join(heads.select("series", F.col("idx").alias("_block"), F.struct(*names).alias("_base")), ["series", "_block"])
    else:
        out = out.withColumn("_base", F.struct(*[identity[c].alias(c) for c in names]))
    out = out.select("series", "_base", F.explode(F.arrays_zip("_rows", "_before")).alias("_r"))
    both = combine({c: F.col(f"_base.{c}") for c in names}, {c: F.col(f"_r._before.{c}") for c in names})
    return out.select("series", "_r._rows.idx", *[both[c].alias(c) for c in names], *[F.col(f"_r._rows.{c}").alias(c) for c in others])


def affine_path(df: DataFrame, a: Column, b: Column, start: Column, out: str, block: int = SCAN_BLOCK) -> DataFrame:
    """Adds ``out``: v[0] = start, v[t] = a[t-1] v[t-1] + b[t-1], by composing maps v -> a v + b."""

    def then(first: Record, last: Record) -> Record:
        return {"_a": first["_a"] * last["_a"], "_b": last["_a"] * first["_b"] + last["_b"]}

    maps = df.withColumns({"_a": a.cast("double"), "_b": b.cast("double"), "_start": start.cast("double")})
    done = scan(maps, ["_a", "_b"], then, {"_a": F.lit(1.0), "_b": F.lit(0.0)}, block)
    return done.withColumn(out, F.col("_a") * F.col("_start") + F.col("_b")).drop("_a", "_b", "_start")


def carry(df: DataFrame, value: str, block: int = BLOCK) -> DataFrame:
    """``df`` (series, idx, value, ...) with the last value that is not null up to each row.

    The last known value of each block is carried over the blocks' heads, a row a block, and within a block over its rows.
    """
    df = df.withColumn("_block", F.floor(F.col("idx") / block))
    last = df.groupBy("series", "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("idx"))).alias("_last"))
    before = Window.partitionBy("series").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    heads = last.select("series", "_block", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    inside = Window.partitionBy("series", "_block").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    held = df.withColumn(value, F.last(value, ignorenulls=True).over(inside)).join(heads, ["series", "_block"])
    return held.withColumn(value, F.coalesce(value, "_before")).drop("_block", "_before")
