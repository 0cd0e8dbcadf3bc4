"""Near copies of 5-word Jaccard 0.8 or more: SimHash near-dedup where its few bits are not enough.

At a similarity of 0.8 two 64-bit fingerprints differ in some 10 bits, where the Manhattan bound of a grid
cell prunes nothing. So the fingerprints' grid join gives only part of the candidates, and minhash buckets
give the others; the exact sets of shingles decide on all of them.

Each distinct text (words lower-cased, blanks collapsed) is a node with its SimHash, the set of its
shingles' 64-bit hashes and ``BANDS`` bucket keys of ``BAND_ROWS`` minima each. Two texts of similarity
0.8 share no bucket with a probability of (1 - 0.8^5)^60, under 1e-10, and more similar ones still less.

Only the connection of a bucket's texts matters, so they are not all paired. First every text is compared
with its bucket's lead: the text that shares most buckets with others, to which edits of one
original are nearer than to each other. What is still apart in a bucket is mostly texts that share a passage and little
else, far too many to pair. In any order of shingles, two sets of similarity s share one of the first n - s n + 1 of
each; with the rare ones first, texts that have so many rare shingles are compared only where they share a rare one, of
which each has few owners. Texts of common shingles alone meet those of their bucket in other components, and become a pair
only if a lower bound of their distance allows it: each has a sketch of the common shingles, whose bits are the parities
of those hashed there, and two sets differ in at least as many shingles as their sketches in bits. So no link is lost,
whatever the size of a bucket, and few pairs that are none are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideflow.llm._shared import NARROW, bounded, drop_scratch, materialize
from tideflow.llm.components import components
from tideflow.llm.simhash import links, majority

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 60
BAND_ROWS = 5
#: Texts of which a shingle may be part and still be rare.
RARE = 8
#: Longs of a sketch.
SKETCH = 8
SEED = 42
_PIECE = 1 << 10
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None]
_MUL = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64)[:, None] | np.uint64(1)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> tuple[int, int, np.ndarray]:
    """A hash of the text's words, its SimHash, and the sorted distinct XXH64 values of its shingles (of all words, if they are fewer)."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z and ASCII blanks only
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if not words:
        return digest(joined, SEED), 0, np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[: n - 1]))
    stops = ends[min(shingle, len(words)) - 1 :] - 1
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist())), np.uint64, n)
    return digest(joined, SEED), majority(hashes), np.unique(hashes)


def bands(hashes: np.ndarray) -> list[int]:
    """Bucket keys of a set; the empty set has buckets of its own."""
    import xxhash

    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PIECE):  # bounded memory for very long texts
        low = np.minimum(low, ((hashes[None, at : at + _PIECE] ^ _XOR) * _MUL).min(axis=1))
    raw, width = low.tobytes(), 8 * BAND_ROWS
    return [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)]


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, node (of the words), fp (SimHash), n, shingles, keys of every row."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = [shingle_set(t, shingle) for t in part.column(2).to_pylist()]
                sets = [s for _, _, s in found]
                ends = pa.array(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32))
                shingles = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
                keys = pa.array(np.array([bands(s) for s in sets], np.uint64).view(np.int64).ravel())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), keys)
                node, fp = (pa.array(np.array(c, np.uint64).view(np.int64)) for c in list(zip(*found))[:2])
                n = pa.array([len(s) for s in sets], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, fp, n, shingles, keys], ["doc_id", "text_hash", "node", "fp", "n", "shingles", "keys"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return slim.mapInArrow(batches, f"doc_id {id_type}, text_hash long, node long, fp long, n int, shingles array<long>, keys array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float, name: str) -> DataFrame:
    """(u, v) of the ``pairs`` (u, n_u, v, n_v) whose sets reach the similarity."""
    pairs = materialize(pairs.where(F.least("n_u", "n_v") / F.greatest("n_u", "n_v") >= similarity).distinct(), f"{name}-pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("n_u").alias("n")), F.struct(F.col("v").alias("node"), F.col("n_v").alias("n")))).alias("e")).select("e.*").distinct()
    ends = materialize(ends, f"{name}-ends")
    bytes_, known = ends.agg(F.coalesce(F.sum(F.col("n").cast("long") * 8 + NARROW), F.lit(0)), F.count("*")).first()
    sets = sets.join(bounded(ends.select("node"), known * NARROW), "node", "left_semi")
    both = pairs.join(bounded(sets.select(F.col("node").alias("v"), F.col("shingles").alias("s_v")), bytes_), "v")
    both = both.join(bounded(sets.select(F.col("node").alias("u"), F.col("shingles").alias("s_u")), bytes_), "u")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return materialize(both.where(common / (F.col("n_u") + F.col("n_v") - common) >= similarity).select("u", "v"), name)


def simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that the fingerprints' grid join proposes: the leads of linked fingerprints, and each node with its fingerprint's lead."""
    leads = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("lead")), "leads")
    pair = links(leads.select("fp"))
    pair = pair.join(leads.select(F.col("fp").alias("u"), F.col("lead").alias("a")), "u").join(leads.select(F.col("fp").alias("v"), F.col("lead").alias("b")), "v").select("a", "b")
    same = nodes.join(leads, "fp").where("node != lead.node").select(F.col("lead").alias("a"), F.struct("node", "n").alias("b"))
    both = pair.unionByName(same)
    return both.select(F.col("a.node").alias("u"), F.col("a.n").alias("n_u"), F.col("b.node").alias("v"), F.col("b.n").alias("n_v"))


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _merged(roots: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``roots`` after the links ``found`` (u, v), by the components of roots that these link."""
    if not found.count():
        return roots
    nodes = found.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(roots, "node", "left_anti")
    every = materialize(roots.unionByName(nodes.select("node", F.col("node").alias("root"))), f"{name}-nodes")
    r = lambda c: every.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}"))
    linked = found.join(r("u"), "u").join(r("v"), "v").where("r_u != r_v").select(F.col("r_u").alias("u"), F.col("r_v").alias("v")).distinct()
    up = components(linked, f"{name}-up").select(F.col("node").alias("root"), F.col("root").alias("top"))
    return materialize(every.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), name)


def _parities(word: int) -> Column:
    """One long of a sketch: each bit is the parity of the shingles ``s`` hashed there."""
    return F.bit_xor(F.expr(f"CASE WHEN (shiftrightunsigned(s, 6) & {SKETCH - 1}) = {word} THEN shiftleft(1L, CAST(s & 63 AS INT)) ELSE 0L END"))


def _may_link(similarity: float) -> Column:
    """Whether texts a and b that share no rare shingle may reach the similarity, by their numbers of common ones and the sketches."""
    need = F.lit(similarity / (1 + similarity)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    apart = sum((F.bit_count(F.col(f"w{i}_a").bitwiseXOR(F.col(f"w{i}_b"))) for i in range(SKETCH)), F.lit(0))
    return (F.least("common_a", "common_b") >= need) & (F.col("common_a") + F.col("common_b") - apart >= 2 * need)


def _unsettled_pairs(shared: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(u, n_u, v, n_v): pairs of texts of a bucket that may be alike and lie in different components. shared: key, node, n."""
    rooted = _rooted(shared, roots)
    torn = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    live = materialize(rooted.join(torn, "key"), "live")
    texts = materialize(live.select("node", "n", "root").distinct(), "unsettled")
    rows = texts.join(sets.select("node", "shingles"), "node").select("node", "n", "root", F.explode("shingles").alias("s"))
    owners = materialize(rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1"), "owners")
    owned = materialize(rows.join(owners, "s"), "owned")

    rare = owned.where(F.col("df") <= RARE)
    a, b = rare.select("s", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a")), rare.select("s", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"))
    by_rare = a.join(b, "s").where("a < b AND r_a != r_b").select("a", "n_a", "b", "n_b")  # repeats go later

    # texts whose first shingles, rare ones ahead, reach into the common ones
    n = F.col("n")
    common = owned.where(F.col("df") > RARE).groupBy("node", "n").agg(F.count("*").alias("common"), F.array(*map(_parities, range(SKETCH))).alias("sketch"))
    heavy = common.where(n - F.col("common") < n - F.ceil(F.lit(similarity) * n - 1e-9) + 1).select("node", "common", *[F.col("sketch")[i].alias(f"w{i}") for i in range(SKETCH)])
    among = materialize(live.join(heavy, "node"), "heavy")
    parts = among.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("most")).select("key", F.col("most.root").alias("main"))
    among = among.join(parts, "key")
    side = lambda x: [F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "common", *[f"w{i}" for i in range(SKETCH)])], F.col("root").alias(f"r_{x}")]
    left = among.where("root != main").select("key", "main", *side("a"))
    both = left.join(among.select("key", *side("b")).hint("merge"), "key").where("r_a != r_b AND (r_b = main OR a < b)").where(_may_link(similarity))
    pick = lambda x, y: F.when(F.col("a") < F.col("b"), F.col(x)).otherwise(F.col(y))
    by_bucket = both.select(pick("a", "b").alias("a"), pick("n_a", "n_b").alias("n_a"), pick("b", "a").alias("b"), pick("n_b", "n_a").alias("n_b"))
    return by_rare.unionByName(by_bucket).select(F.col("a").alias("u"), F.col("n_a").alias("n_u"), F.col("b").alias("v"), F.col("n_b").alias("n_v"))


def near_copy_roots(marked: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the nodes of ``marked`` that are linked to others."""
    nodes = marked.groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")).where("n > 0")
    nodes = materialize(nodes, "nodes")
    close = materialize(simhash_pairs(nodes.select("node", "n", "fp")), "close")
    placed = materialize(nodes.select("node", "n", F.explode("keys").alias("key")), "placed")
    crowd = placed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = materialize(placed.join(crowd, "key"), "buckets")
    wanted = shared.select("node", F.col("size").alias("score")).unionByName(close.select(F.explode(F.array("u", "v")).alias("node"), F.lit(0).cast("long").alias("score")))
    wanted = materialize(wanted.groupBy("node").agg(F.sum("score").alias("score")), "wanted")
    known = wanted.count() * NARROW
    sets = materialize(marked.select("node", "shingles").join(bounded(wanted.select("node"), known), "node", "left_semi").dropDuplicates(["node"]), "sets")

    scored = materialize(shared.join(bounded(wanted, known), "node"), "scored")
    leads = scored.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("lead"))
    stars = scored.join(leads, "key").where("node != lead.node").select(F.col("lead.node").alias("u"), F.col("lead.n").alias("n_u"), F.col("node").alias("v"), F.col("n").alias("n_v"))
    near = _alike(stars.unionByName(close), sets, similarity, "stars")
    roots = materialize(components(near), "roots")

    for done in (nodes, close, placed, scored):
        drop_scratch(done)
    # what is left: texts of one bucket in different components, all of them
    more = _alike(_unsettled_pairs(shared.select("key", "node", "n"), roots, sets, similarity), sets, similarity, "rest")
    roots = _merged(roots, more, "roots")
    for done in (shared, wanted, sets, near, more):
        drop_scratch(done)
    return roots


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay: one of each component of near copies, that with its smallest doc_id, with all columns.

    Null and empty texts and those of blanks are copies of one another only. Of several equal rows, or of rows with one
    doc_id and texts of the same words, one stays. Rows with a null doc_id link others and all stay. Columns may have any
    name and type. An empty table gives no rows.
    """
    marked = materialize(signatures(docs, shingle), "signatures")
    texts = marked.where("doc_id IS NOT NULL").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    firsts = texts.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("first"))
    kept = _rooted(firsts, near_copy_roots(marked, similarity)).groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(kept.select(F.struct("first.doc_id", "first.text_hash").alias("key"), "first.rows"), "kept")
    drop_scratch(marked)
    # the row beside its key, whatever its columns are called
    whole = docs.select(F.struct("*").alias("row"), F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).alias("key"))
    found = whole.join(bounded(kept, kept.count() * NARROW), "key")
    row = Window.partitionBy("key").orderBy(F.to_json("row"))
    repeated = found.where(F.col("rows") > 1).withColumn("nth", F.row_number().over(row)).where("nth = 1")
    first = found.where(F.col("rows") == 1).select("row.*").unionByName(repeated.select("row.*"))
    return first.unionByName(docs.where("doc_id IS NULL"))
