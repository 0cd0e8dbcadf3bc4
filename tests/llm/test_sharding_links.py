"""Links that sharding cuts where copies leave little or no room for unlinked documents."""

import pytest
from pyspark.sql import functions as F
from test_operators import check_shards

from tideflow.llm import sharding


@pytest.mark.parametrize("group", [lambda i: i // 2, lambda i: i // 2 if i < 594 else -i, lambda i: i % 37 if i < 594 else -i])
def test_at_most_one_class_is_cut_at_a_boundary(spark, group):
    d = spark.createDataFrame([(i, f"text {group(i)}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_documents(d, 8)
    check_shards(got.collect(), 600, 8)
    assert sharding.cut_edges(got).first()["cut"] <= 7


def test_partitioned_tables_and_odd_names(spark, tmp_path):
    """Folders of a partitioned table hold files of the same names; no row may come twice. Names may hold dots or be Spark's own."""
    d = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 150).alias("text"), (F.col("id") % 20).alias("source"), F.lit(1).alias("a.b"), F.lit("m").alias("_metadata"), F.lit("r").alias("rank"), F.lit("s").alias("rank_before"), F.lit("q").alias("x`y"))
    d.coalesce(1).write.partitionBy("source").parquet(f"{tmp_path}/t")
    d.repartition(3).write.parquet(f"{tmp_path}/flat")
    for table in (spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/flat"), d):
        got = sharding.shard_corpus(table, 7)
        rows = got.collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(200)) and sorted(r["rank"] for r in rows) == list(range(200))
        assert {"a.b", "_metadata", "rank_before", "rank_before_before", "x`y", "rank", "shard", "slot"} <= set(got.columns)
        assert all((r["a.b"], r["_metadata"], r["rank_before_before"], r["rank_before"]) == (1, "m", "r", "s") for r in rows)
