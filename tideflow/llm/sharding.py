"""Balanced label propagation: documents of equal text gather in few shards of equal row counts.

Documents with the same text are linked. All of them look alike to the propagation, so its state is
the table (class, shard, documents): a class of any size has at most one row a shard. At the start the
linked classes lie one after another over equal shares of the shards, so that at most one class is cut
at each boundary, and the room that unlinked documents leave is the same everywhere. Each round, every class aims at the shard that holds most of it among
those with room, requests to a shard are admitted in order up to its quota, and unlinked documents
fill what is left. No round changes any shard's row count, so counts stay at most one apart.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, bucket_count, drop_scratch, hash_bucket, materialize, order_hash, running_total, table

SHARDS = 40


def _quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _by_shard(df: DataFrame, column: str, shards: int) -> list[int]:
    """Sum of ``column`` by shard: one row a shard, whatever the input's size."""
    got = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.sum(column).alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _at(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), index + 1)


def _shard_of(position: Column, ends: list[int]) -> Column:
    """The shard whose range holds ``position``; ``ends`` are the ranges' ends."""
    shard = F.lit(len(ends) - 1)
    for s in reversed(range(len(ends) - 1)):
        shard = F.when(position < ends[s], s).otherwise(shard)
    return shard.cast("int")


def propagate(state: DataFrame, quotas: list[int], max_rounds: int | None = None) -> DataFrame:
    """Label propagation of (key, h, shard, n) under ``quotas``, until no move is admitted.

    Rows only go where their class has as many or more, so the sum of squares of n grows with every move and the rounds end.
    """
    shards = len(quotas)
    for k in itertools.count() if max_rounds is None else range(max_rounds):
        load = _by_shard(state, "n", shards)
        room = [q - n for q, n in zip(quotas, load)]
        # the class's neighbours: how many of it each shard holds; ties by a hash, so that classes spread
        rank = F.struct("n", F.xxhash64("h", "shard"), "shard")
        best = state.where(_at(room, F.col("shard")) > 0).groupBy("key").agg(F.max(rank).alias("best"))
        wish = state.join(best, "key").where((F.col("shard") != F.col("best.shard")) & (F.col("n") <= F.col("best.n")))
        wish = wish.select("key", "h", F.col("shard").alias("src"), F.col("best.shard").alias("shard"), "n")
        wish = running_total(wish, ["shard"], "h", "n", bucket_count(sum(quotas)), [F.col("key"), F.col("src")])
        moved = F.greatest(F.least(F.col("n"), _at(room, F.col("shard")) - F.col("before")), F.lit(0))
        moves = wish.withColumn("n", moved).where("n > 0")
        moves = materialize(moves.select("key", "h", "src", "shard", "n"), f"moves{k}")
        if moves.isEmpty():
            break
        change = moves.select("key", "h", F.explode(F.array(F.struct("shard", "n"), F.struct(F.col("src").alias("shard"), (-F.col("n")).alias("n")))).alias("c"))
        after = state.unionByName(change.select("key", "h", "c.shard", "c.n")).groupBy("key", "h", "shard").agg(F.sum("n").alias("n")).where("n > 0")
        before, state = state, materialize(after, f"state{k}")
        drop_scratch(before)
        drop_scratch(moves)
    return state


def shard_documents(docs: DataFrame, shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    ``size`` is the UTF-8 length plus 16. A null text counts as empty and is linked with empty ones.
    Repeated rows are documents of their own. With fewer rows than shards some shards stay empty;
    an empty table gives no rows. Rows with a null doc_id are placed like others. Other columns are
    ignored. ``slot`` counts from 0 in each shard without gaps; documents of a class lie together.
    """
    found = _place(_slim(docs), shards, max_rounds)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _named(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def in_file_order(docs: DataFrame) -> DataFrame:
    """rank, row: the rows of ``docs`` as structs and their 0-based places in the files, which Spark writes in the order of a sort.

    Files go by their whole paths, since those of a partitioned table share their names between folders.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        docs.select(meta.getField("row_index")).schema
    except AnalysisException:  # no plain table of files yet
        docs = materialize(docs, "ordered")
        meta = docs.metadataColumn("_metadata")
    listed = docs.select(meta.getField("file_path").alias("file"), meta.getField("row_index").alias("at"), F.struct(*[_named(c).alias(c) for c in docs.columns]).alias("row"))
    sizes = materialize(listed.groupBy("file").agg(F.count("*").alias("rows")), "files")  # a row a file
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # a path is no short column
    return listed.join(bounded(starts, sizes.count() * 16 * NARROW), "file").select((F.col("start") + F.col("at")).alias("rank"), "row")


def shard_corpus(docs: DataFrame, shards: int = SHARDS, max_rounds: int | None = None) -> DataFrame:
    """The corpus in shards: every column of ``docs`` with rank (its place in ``docs``), shard and slot.

    Shards are those of ``shard_documents``; within a shard, slots keep the order of ``docs``, so a corpus
    sorted by training position stays sorted, and repeated passes of a document differ in rank and
    slot. Null and empty texts, null doc_ids and repeated rows are placed like others; columns of ``docs``
    with the added names stay as ``rank_before`` and the like; an empty table gives no rows.
    """
    ordered = in_file_order(docs)
    slim = _slim(ordered.select("row.doc_id", "row.text", "rank"), ("rank",))
    placed = materialize(_place(slim, shards, max_rounds).select("rank", "shard", "size", F.lit(1).cast("long").alias("one")), "placed")
    rows = placed.count()
    # ranks are spread over the hash's range, so buckets are even
    scaled = placed.withColumn("h", (F.col("rank") * F.lit((1 << 60) // max(rows, 1))).cast("long"))
    slots = running_total(scaled, ["shard"], "h", "one", bucket_count(rows), out="slot")
    slots = materialize(slots.select("rank", "shard", "slot"), "slots")
    taken = {c.lower() for c in docs.columns}

    def name(c: str) -> str:
        new = c
        while new.lower() in ("rank", "shard", "slot") or (new != c and new.lower() in taken):
            new += "_before"
        return new

    kept = [F.col("row").getField(c).alias(name(c)) for c in docs.columns]
    return ordered.join(bounded(slots, rows * NARROW), "rank").select(*kept, "rank", "shard", "slot")


def _slim(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Of each document what its place depends on, and the ``carry`` columns."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(*carry, "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("key"))
    return materialize(slim.withColumn("h", order_hash(F.col("doc_id"))), "documents")


def _place(slim: DataFrame, shards: int, max_rounds: int | None) -> DataFrame:
    """``slim`` with law, shard and slot."""
    rows = slim.count()
    buckets = bucket_count(rows)
    quotas = _quotas(rows, shards)

    # (class, bucket of its documents): a class of any size is spread over up to ``buckets`` of them
    parts = slim.groupBy("key", hash_bucket(F.col("h"), buckets).alias("bucket")).agg(F.count("*").alias("n"))
    parts = materialize(parts, "parts")
    classes = parts.groupBy("key").agg(F.sum("n").alias("c")).withColumn("h", order_hash(F.hex("key")))

    linked = materialize(running_total(classes.where("c > 1"), [], "h", "c", buckets, [F.col("key")]), "linked")
    shares = _quotas(linked.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0], shards)
    ends = list(itertools.accumulate(shares))
    upto = F.col("before") + F.col("c")
    dealt = linked.withColumn("shard", F.explode(F.sequence(_shard_of(F.col("before"), ends), _shard_of(upto - 1, ends))))
    end = _at(ends, F.col("shard"))
    part = F.least(upto, end) - F.greatest(F.col("before"), end - _at(shares, F.col("shard")))
    dealt = dealt.select("key", "h", "shard", part.alias("n")).where("n > 0")
    state = propagate(materialize(dealt, "state"), quotas, max_rounds)

    # slots: classes one after another in each shard, unlinked documents behind them
    load = _by_shard(state, "n", shards)
    placed = running_total(state, ["shard"], "h", "n", buckets, [F.col("key")])
    runs = placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("shard", "n", "before"))).alias("runs"))  # a run a shard
    single = running_total(classes.where("c = 1"), [], "h", "c", buckets, [F.col("key")])
    room = [q - n for q, n in zip(quotas, load)]
    ends = list(itertools.accumulate(room))
    single = single.withColumn("shard", _shard_of(F.col("before"), ends))
    slot = _at(load, F.col("shard")) + F.col("before") - _at([e - r for e, r in zip(ends, room)], F.col("shard"))
    single = single.select("key", F.array(F.struct("shard", F.lit(1).cast("long").alias("n"), slot.alias("before"))).alias("runs"))

    by_class = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.withColumn("base", F.coalesce(F.sum("n").over(by_class), F.lit(0))).drop("n").join(runs.unionByName(single), "key")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "doc_id", "size")
    ranked = slim.withColumn("bucket", hash_bucket(F.col("h"), buckets)).join(base, ["key", "bucket"])
    ranked = ranked.withColumn("nth", F.col("base") + F.row_number().over(inside) - 1)
    # the run that holds the rank: (shard, its slot base, ranks before it)
    start = F.struct(F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(0).cast("long").alias("seen"))

    def step(acc: Column, run: Column) -> Column:
        here = (acc["shard"] < 0) & (F.col("nth") < acc["seen"] + run["n"])
        return F.when(here, F.struct(run["shard"].alias("shard"), (run["before"] + F.col("nth") - acc["seen"]).alias("slot"), acc["seen"].alias("seen"))).otherwise(
            F.struct(acc["shard"].alias("shard"), acc["slot"].alias("slot"), (acc["seen"] + run["n"]).alias("seen"))
        )

    found = ranked.withColumn("at", F.aggregate("runs", start, step))
    return found.select(*slim.columns, F.lit("rows").alias("law"), F.col("at.shard").alias("shard"), F.col("at.slot").alias("slot"))


def cut_edges(sharded: DataFrame) -> DataFrame:
    """(linked, cut): links of a spanning chain of each class of equal texts, and those between shards."""
    by_class = sharded.groupBy("text_crc32", "size").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("s"))
    return by_class.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("linked"), F.coalesce(F.sum(F.col("s") - 1), F.lit(0)).alias("cut"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_sharding": op5_sharding}
SQL: dict[str, str] = {}
