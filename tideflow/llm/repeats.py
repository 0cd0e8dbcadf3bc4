"""Removal of repeated 50-byte strings by prefix-free parsing.

A rolling hash over 16-byte grams sets triggers: in every 50-byte window the leftmost gram with the
smallest hash, so a window has its trigger wherever it occurs. The parse of a text is its sequence
of triggers. A phrase spells out what the windows of one trigger hold: the bytes before it, which are
the dictionary's, and those from it on, which are the parse's continuation.

Two suffix orders settle which windows are equal, on bytes alone. The dictionary's phrases are sorted
by their suffixes that end at the trigger, the parse's suffixes by what they spell from the trigger
on, each with the lengths that neighbours have in common. A text's suffix that starts ``a`` bytes
before a trigger ranks by its dictionary suffix of ``a`` bytes first and by its parse suffix second;
in this corpus order all suffixes with the same 50 bytes lie together, and those whose doc_id is not
the smallest of their run are repeats.

1. Items (some megabytes of whole texts, or one longer text) send each distinct trigger once; a window
   over the trigger's hash tells which ones other documents have too.
2. Items send each distinct phrase of a shared trigger once. Tasks get them sorted by trigger, put
   them in corpus order and answer, for each phrase, which of its windows are repeats.
3. Items turn the answers into removed spans and digests of what is left.

Every row that is sent stands for a distinct trigger or phrase of an item, so their number grows in
proportion to the text. Texts are written once and not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideflow.llm._shared import materialize, ordered_rank, scratch_path, table
from tideflow.llm.warc import open_store

LENGTH = 50
GRAM = 16
#: Bytes of text of an item, unless a single text is longer.
ITEM_BYTES = 8 << 20
#: A trigger with more phrases than this sends single windows, which Spark groups by their bytes, so that
#: no task gathers all contexts of a common gram (some 10 MB of them). The answers are the same.
HOT_PHRASES = 1 << 17
#: Phrases that a task puts in order at a time; those of one trigger stay together.
CHUNK = 100_000
_PIECE = 1 << 20
#: Bits of a trigger's sort key that hold its place in a piece; the rest are the upper bits of its hash.
_PLACE = 24
_MULT = 0x9E3779B97F4A7C15
_LAST = np.iinfo(np.int64).max
_BEFORE = LENGTH - GRAM


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def rolling(data: np.ndarray, length: int) -> np.ndarray:
    """Hash of every ``length``-byte string of ``data``, built from those of half the length."""
    table = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    cur, size, out, done = table[data], 1, None, 0
    while True:
        if length & size:
            part = cur[done:]
            n = len(data) - done - size + 1
            out = part[:n] if out is None else out[:n] * np.uint64(pow(_MULT, size, 1 << 64)) + part[:n]
            done += size
        if size * 2 > length:
            return mix(out)
        n = len(cur) - size
        cur = cur[:n] * np.uint64(pow(_MULT, size, 1 << 64)) + cur[size:]
        size *= 2


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[: len(a) - size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


@dataclass
class Parse:
    """An item's texts back to back; phrase i has the windows that start at first[i]..last[i] and its trigger, gram[i], at trigger[i]."""

    data: np.ndarray
    ends: np.ndarray
    gram: np.ndarray
    trigger: np.ndarray
    first: np.ndarray
    last: np.ndarray
    rank: np.ndarray  # of the phrase's document


def parse(data: np.ndarray, ends: np.ndarray, ranks: np.ndarray) -> Parse:
    """The phrases of texts that end at ``ends``. A trigger depends on its window alone, wherever pieces are cut."""
    found: list[list[np.ndarray]] = [[], [], [], []]
    for base in range(0, len(data) - LENGTH + 1, _PIECE):
        part = data[base : base + _PIECE + LENGTH - 1]
        h = rolling(part, GRAM)
        place = np.uint64(_PLACE)
        key = (h >> place << place) | np.arange(len(h), dtype=np.uint64)
        at = (sliding_min(key, LENGTH - GRAM + 1) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        whole = np.ones(len(at), bool)  # windows that do not cross into the next text
        for e in (ends[np.searchsorted(ends, base, "right") : np.searchsorted(ends, base + len(part), "left")] - base).tolist():
            whole[max(0, e - LENGTH + 1) : e] = False
        starts = np.flatnonzero(whole)
        if not len(starts):
            continue
        owner = at[starts]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1))))
        last = starts[np.append(new[1:] - 1, len(starts) - 1)]
        for c, v in zip(found, (mix(h[owner[new]] + np.uint64(_MULT)), owner[new] + base, starts[new] + base, last + base)):
            c.append(v)
    gram, trigger, first, last = (np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, (np.uint64, np.int64, np.int64, np.int64)))
    return Parse(data, ends, gram.view(np.int64), trigger, first, last, ranks[np.searchsorted(ends, first, side="right")] if len(first) else first)


def load(file: str, group: int, start: int, count: int) -> tuple[pa.Array, Parse]:
    """doc_ids and parse of an item: ``count`` rows of a row group from ``start`` on."""
    fs, name = open_store(file)
    ids, texts, ranks, seen = [], [], [], 0
    with fs.open_input_file(name) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=512, row_groups=[group], columns=["doc_id", "rank", "text"]):
            part = b.slice(max(0, start - seen), max(0, min(count, start + count - seen)))
            seen += b.num_rows
            if part.num_rows:
                ids.append(part.column(0))
                ranks.append(part.column(1).to_numpy())
                texts += part.column(2).to_pylist()
            if seen >= start + count:
                break
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return pa.concat_arrays(ids), parse(np.frombuffer(b"".join(texts), np.uint8), ends, np.concatenate(ranks))


def triggers(p: Parse) -> tuple[np.ndarray, np.ndarray]:
    """An item's distinct triggers and, for each, twice its phrases, plus one if several documents have it."""
    if not len(p.gram):
        return p.gram, np.zeros(0, np.int32)
    order = np.argsort(p.gram, kind="stable")
    g, ranks = p.gram[order], p.rank[order]
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    several = np.minimum.reduceat(ranks, at) != np.maximum.reduceat(ranks, at)
    return g[at], (2 * np.diff(np.append(at, len(g))) + several).astype(np.int32)


@dataclass
class Dictionary:
    """Distinct phrases of an item's shared triggers: their bytes, triggers, trigger offsets and smallest ranks."""

    phrases: list[bytes]
    gram: np.ndarray
    before: np.ndarray
    rank: np.ndarray
    at: np.ndarray  # of every occurrence: its place among the item's phrases
    of: np.ndarray  # and among the distinct ones


def dictionary(p: Parse, shared: np.ndarray) -> Dictionary:
    at = np.flatnonzero(np.isin(p.gram, shared))
    body, place = p.data.tobytes(), {}
    of = np.fromiter((place.setdefault(body[f:e], len(place)) for f, e in zip(p.first[at].tolist(), (p.last[at] + LENGTH).tolist())), np.int64, len(at))
    _, head = np.unique(of, return_index=True)
    rank = np.full(len(place), _LAST)
    np.minimum.at(rank, of, p.rank[at])
    return Dictionary(list(place), p.gram[at[head]], (p.trigger - p.first)[at[head]], rank, at, of)


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, last word first: the keys that sort them with ``lexsort``."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(wide.view(">u8").astype(np.uint64).T[::-1])


def suffix_order(rows: np.ndarray, lengths: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' order (by group, bytes, length), and the bytes that each has in common with the one before; -1 at a new group."""
    order = np.lexsort([lengths, *_words(rows), groups])
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    common = np.minimum(common, np.minimum(lengths[order[1:]], lengths[order[:-1]]))
    return order, np.concatenate(([-1], np.where(groups[order[1:]] == groups[order[:-1]], common, -1)))


def repeated_windows(data: np.ndarray, offsets: np.ndarray, gram: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each phrase the bits of its windows that a phrase of a smaller rank has too.

    ``data`` holds the phrases between ``offsets``; ``before`` is the trigger's place in each.
    """
    n = len(gram)
    at, size = offsets[:-1] + before, np.diff(offsets)
    after = size - before
    back, forth = np.arange(_BEFORE), np.arange(LENGTH)
    left = np.where(back < before[:, None], data[np.maximum(at[:, None] - 1 - back, 0)], np.uint8(0))
    right = np.where(forth < after[:, None], data[np.minimum(at[:, None] + forth, len(data) - 1)], np.uint8(0))
    d_order, d_common = suffix_order(left, before, gram)
    p_order, p_common = suffix_order(right, after, gram)
    bits, d_run, p_run = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    least = before - (size - LENGTH)  # windows start this many bytes before the trigger at least
    for a in range(_BEFORE + 1):
        here = np.flatnonzero((before >= a) & (least <= a))
        if not len(here):
            continue
        # equal dictionary suffixes of a bytes, and equal parse suffixes of the other bytes, are runs
        d_run[d_order] = np.cumsum(d_common < a)
        p_run[p_order] = np.cumsum(p_common < LENGTH - a)
        place = d_run[here] * (n + 1) + p_run[here]
        order = np.argsort(place, kind="stable")
        new = np.concatenate(([True], place[order][1:] != place[order][:-1]))
        low = np.minimum.reduceat(rank[here][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        gone = here[order[rank[here][order] > low]]
        bits[gone] |= np.uint64(1) << (before[gone] - a).astype(np.uint64)
    return bits


def by_trigger(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some ``CHUNK`` rows from batches sorted by h; the rows of one h stay together."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def removed_spans(p: Parse, d: Dictionary, k: np.ndarray, bits: np.ndarray) -> Iterator[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of the item's documents, from the answers on its distinct phrases ``k``."""
    found = np.zeros(len(d.phrases), np.uint64)
    np.bitwise_or.at(found, k, bits)
    first, windows = p.first[d.at], p.last[d.at] - p.first[d.at] + 1
    whole = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
    mine = np.where(p.rank[d.at] > d.rank[d.of], whole, found[d.of])
    gone = np.zeros(len(p.data) + 1, np.int8)  # at most LENGTH windows cover a byte
    for at in range(0, len(mine), _PIECE >> 4):
        f, w, m = first[at : at + (_PIECE >> 4)], windows[at : at + (_PIECE >> 4)], mine[at : at + (_PIECE >> 4)]
        step = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
        start = (np.repeat(f, w) + step)[(np.repeat(m, w) >> step.astype(np.uint64) & np.uint64(1)).astype(bool)]
        gone[start] += 1  # windows start at one place only once, so no index repeats
        gone[start + LENGTH] -= 1
    cover = np.cumsum(gone[:-1], dtype=np.int8) > 0
    begin = 0
    for end in p.ends.tolist():
        c = cover[begin:end]
        n = int(c.sum())
        spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum()) if n else 0
        kept = p.data[begin:end][~c] if n else p.data[begin:end]
        yield end - begin, n, spans, hashlib.sha256(kept.tobytes()).hexdigest()
        begin = end


def _ranked(docs: DataFrame) -> DataFrame:
    """doc_id, rank (long, in the order of doc_id; null ids last), text (binary)."""
    text = F.coalesce("text", F.lit("")).cast("binary").alias("text")
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("rank"), text)
    ids = ordered_rank(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), [F.col("doc_id")], "ids")
    return docs.select("doc_id", text).join(ids, "doc_id", "left").select("doc_id", F.coalesce("rank", F.lit(_LAST)).alias("rank"), "text")


def _items(spark: SparkSession, path: str) -> DataFrame:
    """item, file, row_group, start, count: the written texts in items of ``ITEM_BYTES``; a row group is cut by the lengths of its texts."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for file in b.column(0).to_pylist():
                rows, (fs, name) = [], open_store(file)
                with fs.open_input_file(name) as f:
                    source = pq.ParquetFile(f)
                    for g in range(source.num_row_groups):
                        sizes = source.read_row_group(g, columns=["size"])["size"].to_numpy()
                        start, held = 0, 0
                        for i, n in enumerate(sizes.tolist()):
                            if held and held + n > ITEM_BYTES:
                                rows.append((file, g, start, i - start))
                                start, held = i, 0
                            held += n
                        if len(sizes):
                            rows.append((file, g, start, len(sizes) - start))
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(("file", "row_group", "start", "count"), r)) for r in rows])

    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file")).distinct()
    cuts = files.mapInArrow(cut, "file string, row_group long, start long, count long")
    return materialize(cuts.withColumn("item", F.monotonically_increasing_id()), "items")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    A null text is empty; texts shorter than a window lose nothing. Only rows with a smaller doc_id
    count: rows that share a doc_id never remove each other's bytes. Null doc_ids come after all
    others (an id of 2^63 - 1 counts as null). doc_ids of any type that can be ordered are taken. An
    empty table gives no rows. Other columns are ignored. A task holds one item: some megabytes of
    text or a single longer one, at some 30 bytes of memory for each of its bytes.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "texts")
    slim = _ranked(docs).withColumn("size", F.octet_length("text").cast("long"))
    slim.write.option("compression", "zstd").option("parquet.block.size", ITEM_BYTES).parquet(path)
    items = _items(spark, path)
    tasks = max(1, min(items.count(), 20_000))
    where, lists = ("file", "row_group", "start", "count"), ("cold", "hot", "k", "bits")

    def send_triggers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for r in b.to_pylist():
                h, n = triggers(load(*(r[c] for c in where))[1])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), r["item"])), pa.array(n)], ["h", "item", "n"])

    sent = items.repartition(tasks).mapInArrow(send_triggers, "h long, item long, n int")
    same = Window.partitionBy("h")
    seen = sent.select("h", "item", "n", F.count("*").over(same).alias("items"), F.sum(F.shiftright("n", 1)).over(same).alias("phrases"))
    seen = seen.where((F.col("items") > 1) | (F.col("n").bitwiseAND(F.lit(1)) == 1))
    hot = F.col("phrases") > HOT_PHRASES
    shared = seen.groupBy("item").agg(F.collect_list(F.when(~hot, F.col("h"))).alias("cold"), F.collect_list(F.when(hot, F.col("h"))).alias("hot"))
    work = materialize(items.join(shared, "item"), "shared")

    def opened(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.Array, Parse, Dictionary]]:
        """Each item with its lists as arrays, and what is made of it."""
        for b in it:
            for i in range(b.num_rows):
                r = {c: x[i].values.to_numpy() if x[i].is_valid else np.zeros(0, np.int64) for c, x in zip(b.schema.names, b.columns) if c in lists}
                r |= {c: x[i].as_py() for c, x in zip(b.schema.names, b.columns) if c not in lists}
                ids, p = load(*(r[c] for c in where))
                yield r, ids, p, dictionary(p, np.concatenate((r["cold"], r["hot"])))

    def send_phrases(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item, k (place among the item's distinct phrases, and the trigger's in the phrase), rank, phrase, of triggers that are not hot."""
        for r, _, _, d in opened(it):
            k = np.flatnonzero(np.isin(d.gram, r["cold"]))
            cols = [pa.array(np.full(len(k), r["item"])), pa.array(k * LENGTH + d.before[k]), pa.array(d.rank[k]), pa.array([d.phrases[i] for i in k.tolist()], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["item", "k", "rank", "phrase"])

    def send_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item, k, bit, rank, window, of hot triggers."""
        for r, _, _, d in opened(it):
            for ks in np.array_split(k := np.flatnonzero(np.isin(d.gram, r["hot"])), len(k) // 10_000 + 1):
                n = [len(d.phrases[i]) - LENGTH + 1 for i in ks.tolist()]
                windows = [d.phrases[i][j : j + LENGTH] for i, w in zip(ks.tolist(), n) for j in range(w)]
                bit = np.uint64(1) << (np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
                cols = [pa.array(np.full(len(bit), r["item"])), pa.array(np.repeat(ks, n)), pa.array(bit.view(np.int64)), pa.array(np.repeat(d.rank[ks], n)), pa.array(windows, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["item", "k", "bit", "rank", "window"])

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_trigger(it):
            phrase = pa.concat_arrays(t["phrase"].chunks)
            offsets = np.frombuffer(phrase.buffers()[1], np.int32)[phrase.offset : phrase.offset + len(phrase) + 1].astype(np.int64)
            k = t["k"].to_numpy()
            bits = repeated_windows(np.frombuffer(phrase.buffers()[2], np.uint8), offsets, t["h"].to_numpy(), k % LENGTH, t["rank"].to_numpy())
            some = np.flatnonzero(bits)
            yield pa.RecordBatch.from_arrays([pa.array(t["item"].to_numpy()[some]), pa.array(k[some] // LENGTH), pa.array(bits[some].view(np.int64))], ["item", "k", "bits"])

    dealt = work.repartition(tasks)
    phrases = dealt.mapInArrow(send_phrases, "item long, k long, rank long, phrase binary")
    trigger = F.xxhash64(F.substring("phrase", F.col("k") % LENGTH + 1, F.lit(GRAM)))  # worked out on either side, not sent
    answers = phrases.repartition(trigger).withColumn("h", trigger).sortWithinPartitions("h").mapInArrow(answer, "item long, k long, bits long")
    if not work.where(F.size("hot") > 0).isEmpty():
        windows = dealt.where(F.size("hot") > 0).mapInArrow(send_windows, "item long, k long, bit long, rank long, window binary")
        windows = windows.withColumn("low", F.min("rank").over(Window.partitionBy("window"))).where("rank > low")
        answers = answers.unionByName(windows.groupBy("item", "k").agg(F.bit_or("bit").alias("bits")))
    told = materialize(answers.groupBy("item").agg(F.collect_list("k").alias("k"), F.collect_list("bits").alias("bits")), "answers")

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, ids, p, d in opened(it):
            columns = zip(*removed_spans(p, d, r["k"], r["bits"].view(np.uint64)))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, columns)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = items.join(work.select("item", "cold", "hot"), "item", "left").join(told, "item", "left").repartition(tasks)
    return known.mapInArrow(finish, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_repeats": op6_repeats}
#: Windows as hex text; some 20 s for DuckDB on 2.5 MB of documents.
OP6_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT doc_id, h, length(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i::INT + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM n)),
m AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
r AS (SELECT doc_id, i FROM w JOIN m USING (g) WHERE low < doc_id),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
  SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM r)) GROUP BY doc_id, island),
t AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT doc_id, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * before::INT + 1, 2 * (a - before)::INT), '' ORDER BY a) AS kept FROM t JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0)::INT + 1))) AS kept_sha256
FROM n LEFT JOIN k USING (doc_id)
"""
SQL = {"op6_repeats": OP6_SQL}
