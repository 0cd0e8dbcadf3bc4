"""Order-dependent steps over long series, cut so that no task holds a whole series.

Windows that reach a known number of rows back or ahead run in blocks that borrow their neighbours'
rows; positions and running sums are taken within buckets and shifted by the buckets before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

#: Rows of a block.
BLOCK = 1 << 16


def in_block() -> WindowSpec:
    return Window.partitionBy("series", "_block").orderBy("idx")


def blocks(df: DataFrame, before: int = 0, after: int = 0, block: int = BLOCK) -> DataFrame:
    """Adds _block and _home to df (series, idx, ...): each block also holds, as guests, the ``before`` rows ahead of it and the ``after`` rows behind it."""
    if max(before, after) > block:
        raise ValueError("a block must be as long as what it borrows")
    own = F.floor(F.col("idx") / block)
    where = [own]
    if after:
        where.append(F.when((F.col("idx") % block < after) & (own > 0), own - 1))
    if before:
        where.append(F.when(F.col("idx") % block >= block - before, own + 1))
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(F.array_compact(F.array(*where))))
    return spread.withColumn("_home", F.col("_block") == F.col("_own")).drop("_own")


def _shifted(df: DataFrame, keys: Sequence[str], bucket: Column, total: Column) -> DataFrame:
    """Adds _bucket and _base: the total of the key's earlier buckets."""
    dealt = cut(df.withColumn("_bucket", bucket))  # read twice below, and by callers who do the same
    sums = dealt.groupBy(*keys, "_bucket").agg(total.alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", F.sum("_total").over(earlier).alias("_base"))
    return dealt.join(base, [*keys, "_bucket"])


def number(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], out: str = "idx") -> DataFrame:
    """Adds ``out``: the 0-based place among the key's rows in ``order``, of which ``bucket`` is a coarser form (both without nulls)."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    place = F.coalesce("_base", F.lit(0)) + F.row_number().over(inside) - 1
    return _shifted(df, keys, bucket, F.count("*")).withColumn(out, place.cast("long")).drop("_bucket", "_base")


def running_sum(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the key's rows up to this one in ``order``."""
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.coalesce("_base", F.lit(0.0)) + F.sum(value).over(inside)
    return _shifted(df, keys, bucket, F.sum(value)).withColumn(out, upto).drop("_bucket", "_base")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: plans that use it often stay small.

    The folder is that of spark.checkpoint.dir. Only where it is unset, and only on a local master (tests), one
    is made under the temp folder.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tideflow-"))
    return df.checkpoint()


def whole(df: DataFrame, **stats: Column) -> DataFrame:
    """Adds aggregates over each series, combined before the shuffle, to its rows."""
    df = cut(df)
    return df.join(df.groupBy("series").agg(*[c.alias(n) for n, c in stats.items()]), "series")
