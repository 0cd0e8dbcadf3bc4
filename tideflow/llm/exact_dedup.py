"""Exact dedup by distributed MSD radix partitioning.

Documents are split by the successive bytes of their normalised text. A level compares one block of
bytes: groups of one leave, groups whose text has ended are classes of equal texts, the rest goes to
the next level without the bytes already compared. Blocks widen from level to level, up to
``MAX_BLOCK``, so most texts take a few levels. Equality is decided on the bytes themselves; no digest takes part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, drop_scratch, materialize, table

FIRST_BLOCK = 64
WIDENING = 16
#: Bytes of a block at most: what a group's key may hold.
MAX_BLOCK = 1 << 18
BLANKS = r"[\x20\x09-\x0D]+"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def duplicate_classes(texts: DataFrame, first_block: int = FIRST_BLOCK, widening: int = WIDENING) -> DataFrame:
    """(rid, keep_rid, keep_id, group_size) of the rows whose text another row has too.

    ``texts``: rid (unique), doc_id, body (binary). The row that stays has the smallest doc_id, null
    last, then the smallest rid.
    """
    keep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid"))).alias("keep")
    # the first level takes the text's length along: groups then end together
    keys = texts.select("rid", "doc_id", F.octet_length("body").alias("gid"), F.expr(f"substring(body, 1, {first_block})").alias("block"))
    # written apart, so that the join deals out both sides itself and can split a group with very many rows
    groups = materialize(keys.groupBy("gid", "block").agg(keep, F.count("*").alias("n")).where("n > 1"), "groups0")
    alive = keys.select("rid", "gid", "block").join(bounded(groups, groups.agg(F.coalesce(F.sum(F.octet_length("block") + NARROW), F.lit(0))).first()[0]), ["gid", "block"]).select("rid", "gid", "keep", "n")
    alive = materialize(alive, "alive0")
    found = [alive.where(F.col("gid") <= first_block).drop("gid")]
    longer = alive.where(F.col("gid") > first_block)
    rest = texts.join(bounded(longer, longer.count() * NARROW), "rid")
    rest = rest.select("rid", "doc_id", F.col("keep.rid").alias("gid"), F.expr(f"substring(body, {first_block + 1})").alias("body"))
    rest, width, level = materialize(rest, "rest0"), first_block * widening, 1
    while not rest.isEmpty():
        block = F.expr(f"substring(body, 1, {width})").alias("block")
        groups = rest.select("rid", "doc_id", "gid", block).groupBy("gid", "block").agg(keep, F.count("*").alias("n")).where("n > 1")
        groups = materialize(groups, f"groups{level}")
        split = rest.withColumn("block", block).withColumn("body", F.expr(f"substring(body, {width + 1})")).join(groups.hint("merge"), ["gid", "block"])
        split = materialize(split.select("rid", "doc_id", "keep", "n", "body", (F.octet_length("body") == 0).alias("ended")), f"level{level}")
        found.append(materialize(split.where("ended").select("rid", "keep", "n"), f"ended{level}"))
        drop_scratch(rest)
        rest = split.where("NOT ended").select("rid", "doc_id", F.col("keep.rid").alias("gid"), "body")
        width, level = min(width * widening, MAX_BLOCK), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("rid", F.col("keep.rid").alias("keep_rid"), F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    A null text equals an empty one. Of rows with the same text and doc_id exactly one stays. Rows
    with a null doc_id stay only if no row of their group has one. An empty table gives no rows.
    """
    norm = normalise(F.col("text"))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2(norm, 256).alias("text_sha256"), norm.cast("binary").alias("body"))
    rows = materialize(rows, "texts")
    classes = duplicate_classes(rows.select("rid", "doc_id", "body"))
    out = rows.select("rid", "doc_id", "text_sha256").join(classes, "rid", "left")
    alone = F.col("keep_rid").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("keep_rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_exact_dedup": op3_exact_dedup}
SQL = {"op3_exact_dedup": OP3_SQL}
