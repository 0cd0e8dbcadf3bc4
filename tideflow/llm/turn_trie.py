"""Prefix trie of conversations by distributed MSD radix partitioning.

Turns (role and text) are encoded by a dictionary. Equal conversations become one sequence of turn ids. Buckets of
sequences that share a prefix are split by their next id, level after level, in aggregations and joins over all
buckets at once, until a bucket is small enough for one task; there multikey quicksort orders what is left and emits its nodes.
Nodes above the small buckets come from the levels themselves, and their subtree sums from the levels below.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import drop_scratch, materialize, table

#: Turns that a bucket may hold to be finished in one task.
LOCAL_TURNS = 1 << 14
#: Conversations are rebuilt on the first turns of another, this many ids before at most.
FAMILY, HEAD = 20, 4
#: Ids of conversations that are joined to one text before they are hashed.
CHUNK = 1024
NO_ENDS = hashlib.sha256(b"").hexdigest()


def encode(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, id, words): turns by their id in the dictionary of distinct (role, text), in whose order ids ascend.

    Only distinct turns are sorted. The join is free to split a turn that very many conversations share.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    known = turns.groupBy("role", "text").agg(F.count("*").alias("n")).orderBy("role", "text").select("role", "text", words.alias("words"), F.monotonically_increasing_id().alias("id"))
    known = materialize(known, "dictionary")
    coded = materialize(turns.join(known.hint("merge"), ["role", "text"]).select("conv_id", "turn", "id", "words"), "turns")
    drop_scratch(known)
    return coded


def rebuild(coded: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """(conv_id, turns: array of (id, words)): each conversation on the first h turns of the first of its family, its own after its first h.

    Turns stand in order of ``turn``, null first, those of equal number by role and text. A conversation is one row.
    """
    order = F.sort_array(F.collect_list(F.struct(F.col("turn").isNotNull().alias("given"), "turn", "id", "words")))
    own = materialize(coded.groupBy("conv_id").agg(F.transform(order, lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns")), "conversations")
    first = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("first"), F.slice("turns", 1, head - 1).alias("shared"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")).cast("long") % head
    both = own.withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(first, "first", "left").withColumn("h", h.cast("int"))
    none = F.expr("CAST(array() AS array<struct<id: bigint, words: bigint>>)")
    turns = F.concat(F.slice(F.coalesce("shared", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    return both.select("conv_id", turns.alias("turns"))


def sequences(rebuilt: DataFrame) -> DataFrame:
    """(ids, words, conv_id, n, ends): distinct sequences with their smallest conversation, number, and the hash of all their ids in order.

    A digest is taken in one pass by its nature, so a sequence's conversations come to one task in order, but as
    texts of CHUNK ids, made before, and only the digest's state is held.
    """
    ids, words = F.transform("turns", lambda t: t["id"]), F.transform("turns", lambda t: t["words"])
    parts = rebuilt.select(ids.alias("ids"), words.alias("words"), "conv_id", F.expr(f"conv_id div {CHUNK}").alias("chunk")).groupBy("ids", "words", "chunk")
    parts = parts.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("part"))
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("conv_id", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in it:
            out = []
            for ids, words, conv, n, part in zip(*(c.to_pylist() for c in batch.select(["ids", "words", "conv_id", "n", "part"]).columns)):
                if ids != last:
                    if last is not None:
                        out.append((*state[:4], state[4].hexdigest()))
                    last, state = ids, [ids, words, conv, 0, hashlib.sha256()]
                else:
                    state[4].update(b",")
                state[3] += n
                state[4].update(part.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind.types)], schema=kind)
        if last is not None:
            out = [(*state[:4], state[4].hexdigest())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kind.types)], schema=kind)

    return parts.repartition("ids").sortWithinPartitions("ids", "chunk").mapInArrow(hashed, "ids array<long>, words array<long>, conv_id long, n long, ends string")


def multikey_nodes(items: list[tuple], depth: int, parent_conv: int) -> list[list]:
    """Nodes of the sequences ``items`` (ids, words, conv_id, n, ends), which share their first ``depth`` turns, from the node of these on.

    [conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved_tokens, ends] in the order of a multikey
    quicksort: items are dealt by the next id into those below, at and above a pivot's; those at it make a child.
    """
    nodes: list[list] = []
    parents: list[int] = []
    todo: list[tuple[list, int, int]] = [(items, depth, -1)]  # depth counts the shared turns; ~depth marks items still to be dealt
    while todo:
        some, at, up = todo.pop()
        if at >= 0:
            conv, n, ends, rest = min(x[2] for x in some), sum(x[3] for x in some), NO_ENDS, []
            for x in some:
                if len(x[0]) == at:
                    ends = x[4]
                else:
                    rest.append(x)
            saved = (n - 1) * some[0][1][at - 1] if at else 0
            nodes.append([conv, at, nodes[up][0] if up >= 0 else parent_conv, n, 0, 0, saved, ends])
            parents.append(up)
            if rest:
                todo.append((rest, ~at, len(nodes) - 1))
            continue
        d = ~at
        pivot = some[len(some) // 2][0][d]
        below, above, same = [x for x in some if x[0][d] < pivot], [x for x in some if x[0][d] > pivot], [x for x in some if x[0][d] == pivot]
        nodes[up][4] += 1
        if above:
            todo.append((above, at, up))
        if below:
            todo.append((below, at, up))
        todo.append((same, d + 1, up))
    for k in range(len(nodes) - 1, -1, -1):  # children come after their parents
        node = nodes[k]
        node[5] += not node[4]
        if parents[k] >= 0:
            nodes[parents[k]][5] += node[5]
            nodes[parents[k]][6] += node[6]
    return nodes


_FIELDS = [("node", pa.int64()), ("parent", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string())]
_OUT = "node long, parent long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole buckets, whose rows come one after the other; ``node`` and ``parent`` are set on a bucket's first node alone."""
    kind = pa.schema(_FIELDS)
    bucket, held, out = None, [], []

    def done() -> None:
        if held:
            node, parent, depth, parent_conv = bucket
            for k, (conv, d, up, *rest) in enumerate(multikey_nodes(held, depth, parent_conv)):
                out.append((node if k == 0 else None, parent if k == 0 else None, conv, d, up, *rest))
            held.clear()

    def batches() -> Iterator[pa.RecordBatch]:
        while out:
            some, out[:] = out[:10_000], out[10_000:]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), kind.types)], schema=kind)

    for batch in it:
        for node, parent, depth, parent_conv, *item in zip(*(c.to_pylist() for c in batch.select(["node", "parent", "depth", "parent_conv", "ids", "words", "conv_id", "n", "ends"]).columns)):
            if bucket is None or node != bucket[0]:
                done()
                bucket = (node, parent, depth, parent_conv)
            held.append(tuple(item))
        if len(out) >= 10_000:
            yield from batches()
    done()
    yield from batches()


def prefix_trie(conversations: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie of rebuilt conversations.

    Null roles and texts count as empty, null turns come first, and turns of one number are ordered by role and text. Repeated
    rows are turns of their own. Rows without a conv_id belong to no conversation and are left out. Other columns are
    ignored. An empty table has no nodes, not even a root. Rounds grow with the depth to which over ``local_turns`` turns stay together.
    """
    items = materialize(sequences(rebuild(encode(conversations))), "sequences")
    weigh = lambda depth: F.size("ids") - depth + 1
    whole = items.agg(F.min("conv_id").alias("conv"), F.sum("n").alias("n")).first()
    if whole["conv"] is None:
        return conversations.sparkSession.createDataFrame([], _OUT).drop("node", "parent")
    spark = conversations.sparkSession
    items = items.withColumns({"node": F.lit(0).cast("long"), "conv": F.lit(whole["conv"]).cast("long")})
    upper = [spark.createDataFrame([(0, None, whole["conv"], None, whole["n"], 0)], "node long, parent long, conv_id long, parent_conv_id long, n_convs long, own long")]
    ended, finished, depth, next_id = [], [], 0, 1
    while True:
        ended.append(items.where(F.size("ids") == depth).select("node", F.col("ends").alias("ends_sha256")))
        going = items.where(F.size("ids") > depth).withColumn("turn", F.col("ids")[depth])
        stats = going.groupBy("node", "conv", "turn").agg(F.min("conv_id").alias("low"), F.sum("n").alias("members"), F.count("*").alias("kinds"), F.sum(weigh(depth).cast("long")).alias("weight"), F.max(F.col("words")[depth]).alias("last"))
        stats = stats.select("node", "turn", F.col("conv").alias("parent_conv"), "low", "members", F.col("last"), ((F.col("weight") <= local_turns) | (F.col("kinds") == 1)).alias("small"), (F.monotonically_increasing_id() + next_id).alias("child"))
        stats = materialize(stats, f"buckets{depth}")
        deal = going.join(stats.select("node", "turn", "child", "small", "parent_conv", "low").hint("merge"), ["node", "turn"])
        dealt = materialize(deal.select("child", F.col("node").alias("parent"), "parent_conv", "low", "small", "ids", "words", "conv_id", "n", "ends"), f"dealt{depth}")
        depth += 1
        small = dealt.where("small").select(F.col("child").alias("node"), "parent", F.lit(depth).alias("depth"), "parent_conv", "ids", "words", "conv_id", "n", "ends")
        finished.append(materialize(small.repartition("node").sortWithinPartitions("node").mapInArrow(_local, _OUT), f"nodes{depth}"))
        large = stats.where("NOT small")
        if large.isEmpty():
            break
        upper.append(large.select(F.col("child").alias("node"), F.col("node").alias("parent"), F.col("low").alias("conv_id"), F.col("parent_conv").alias("parent_conv_id"), F.col("members").alias("n_convs"), ((F.col("members") - 1) * F.col("last")).alias("own")))
        next_id = stats.agg(F.max("child")).first()[0] + 1
        items = dealt.where("NOT small").select("ids", "words", "conv_id", "n", "ends", F.col("child").alias("node"), F.col("low").alias("conv"))
    return _joined(upper, ended, finished)


def _joined(upper: list[DataFrame], ended: list[DataFrame], finished: list[DataFrame]) -> DataFrame:
    """Nodes of the small buckets and, from the deepest level up, those above them with the sums of what is below."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = finished[0].select(*names)
    for f in finished[1:]:
        out = out.unionByName(f.select(*names))
    below = None
    for level in range(len(upper) - 1, -1, -1):
        tops = finished[level].where("parent IS NOT NULL").select("parent", "n_leaves", "saved_tokens")
        below = tops if below is None else tops.unionByName(below.select("parent", "n_leaves", "saved_tokens"))
        sums = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rows = upper[level].join(sums, "node", "left").join(ended[level], "node", "left")
        rows = rows.select(
            "parent", "conv_id", F.lit(level).cast("long").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"),
            (F.col("own") + F.coalesce("saved", F.lit(0).cast("long"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
        )
        below = materialize(rows, f"upper{level}")
        out = out.unionByName(below.select(*names))
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH t AS (SELECT conv_id, turn, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS t FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST, t) AS q FROM t GROUP BY conv_id),
h AS (SELECT conv_id, q, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 4 AS h FROM o),
s AS (SELECT c.conv_id, list_concat(coalesce(list_slice(f.q, 1, c.h), []), list_slice(c.q, c.h + 1, len(c.q))) AS q FROM h c LEFT JOIN o f ON f.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS depth FROM s),
m AS (SELECT conv_id, depth, len(q) = depth AS ends, md5(to_json(list_slice(q, 1, depth))::VARCHAR) AS node, md5(to_json(list_slice(q, 1, depth - 1))::VARCHAR) AS up,
  CASE WHEN depth > 0 THEN len(list_filter(string_split_regex(q[depth].x, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words FROM p),
n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
  sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM m GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, up AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
g AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, node)),
a AS (SELECT DISTINCT lo.depth AS bd, lo.node AS bn, hi.depth AS depth, hi.node AS node FROM m lo JOIN m hi ON hi.conv_id = lo.conv_id AND hi.depth <= lo.depth),
u AS (SELECT a.depth, a.node, sum(g.own) AS saved_tokens, count(*) FILTER (g.n_children = 0) AS n_leaves FROM a JOIN g ON g.depth = a.bd AND g.node = a.bn GROUP BY ALL)
SELECT g.conv_id, g.depth, f.conv_id AS parent_conv_id, g.n_convs, g.n_children, u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, g.ends_sha256
FROM g JOIN u USING (depth, node) LEFT JOIN n f ON f.depth = g.depth - 1 AND f.node = g.up
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_prefix_trie": op13_prefix_trie}
SQL = {"op13_prefix_trie": OP13_SQL}
