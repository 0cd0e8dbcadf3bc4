"""Helpers the operators share: written intermediate tables, distributed running totals, ranks."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN_DIR = "spark.tideflow.checkpointDir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only where it is unset, and only on a local master (tests), one is made under the temp folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    found = found or spark.conf.get(_OWN_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tideflow-')}"
        spark.conf.set(_OWN_DIR, found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tideflow-{uuid.uuid4().hex}/{name}"


#: A query's shuffle files go when it has ended; texts are sent to Python workers in small batches.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, lost executors cost nothing.

    Once the files are written nothing reads the shuffles they came from, and their disk is freed.
    """
    spark = df.sparkSession
    path, before = scratch_path(spark, name), {k: spark.conf.get(k, None) for k in _WHILE_WRITING}
    for k, v in _WHILE_WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        parent = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "tideflow-" in parent.toString():
            parent.getFileSystem(spark._jsc.hadoopConfiguration()).delete(parent, True)


#: A table of known size is broadcast up to so many bytes, and joined by a shuffle beyond.
MAX_BROADCAST_BYTES = 16 << 20
#: What a row of a few numbers takes there.
NARROW = 80


def bounded(df: DataFrame, size: int) -> DataFrame:
    """``df``, of some ``size`` bytes, as a side to be broadcast if it is small enough."""
    return F.broadcast(df) if size <= MAX_BROADCAST_BYTES else df.hint("merge")


def bucket_count(rows: int) -> int:
    """Buckets a key: their number and the rows in each both grow with the square root of the table.

    They are small enough for many to meet in a task, so that tasks are even.
    """
    return max(1, 8 * math.isqrt(max(rows, 1)))


def hash_bucket(h: Column, buckets: int) -> Column:
    """Bucket of a non-negative 60-bit hash, in the hash's order."""
    return F.least(F.floor(h / F.lit(float(1 << 60)) * buckets), F.lit(buckets - 1)).cast("int")


def order_hash(*cols: Column) -> Column:
    """Non-negative 60-bit hash that other SQL engines can compute too."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def running_total(
    df: DataFrame, keys: Sequence[str], h: str, weight: str, buckets: int, ties: Sequence[Column] = (), out: str = "before"
) -> DataFrame:
    """Adds ``out``: the sum of ``weight`` over the rows of the same key that come earlier in order of ``h``.

    A key's rows are split into hash buckets; bucket sums (combined before the shuffle) give each
    bucket's base, and only rows of one bucket meet in a window. A key with a third of all rows is
    spread over as many tasks as any other rows. ``keys`` must hold no nulls.
    """
    keys = list(keys)
    cut = df.withColumn("_bucket", hash_bucket(F.col(h), buckets))
    sums = cut.groupBy(*keys, "_bucket").agg(F.sum(weight).alias("_sum"))
    by_key = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*keys, "_bucket", F.coalesce(F.sum("_sum").over(by_key), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.col(h), *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(base, [*keys, "_bucket"])
        .withColumn(out, F.col("_base") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .drop("_bucket", "_base")
    )


def ordered_rank(df: DataFrame, order: Sequence[Column], name: str, out: str = "rank") -> DataFrame:
    """Adds ``out``: 0-based rank in the global ``order``, by range partitions and their row counts."""
    parts = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()), name)
    counts = {r["_part"]: r["count"] for r in parts.groupBy("_part").count().collect()}  # one row a partition
    base, seen = [], 0
    for part in sorted(counts):
        base += [F.lit(part), F.lit(seen).cast("long")]
        seen += counts[part]
    start = F.create_map(*base)[F.col("_part")] if base else F.lit(0).cast("long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn(out, start + within).drop("_part")
