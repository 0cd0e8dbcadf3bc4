"""The operators against brute force on a sample with every awkward case, and on empty tables."""

import random
from collections import Counter, defaultdict

import brute
import pytest

from pyspark.sql import functions as F
from tideflow.llm import _shared, components, decontamination, exact_dedup, mixing, registry, repeats, secrets, sharding, simhash, warc

SF = "/root/testdata/sf0.001"


def rows(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(registry.queries()[name](spark, SF), registry.oracle_sql()[name], SF)


def test_simhash(edge_docs, no_docs, pairs):
    got = simhash.simhash_components(edge_docs)
    assert rows(got, "doc_id", "fingerprint", "component_id") == Counter(brute.simhash(pairs))
    assert simhash.simhash_components(no_docs).count() == 0


def test_simhash_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want = Counter(brute.simhash([(r["doc_id"], r["text"]) for r in d.collect()]))
    assert rows(registry.queries()["op1_simhash"](spark, SF), "doc_id", "fingerprint", "component_id") == want


def test_crowded_cells_lose_no_link(spark, monkeypatch):
    """A chain and a cloud of fingerprints, paired and dealt out by midpoint, against all pairs."""
    import numpy as np

    rng = np.random.default_rng(0)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    for k in range(120):
        fps.add(base ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))))
        fps.add(base ^ (7 << k % 60))
    fps |= {int(v) for v in rng.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(v,) for v in fps], "fp long")
    order = sorted(fps)
    want = brute_components(order)
    for most in (2, 5, 16, 1000):  # split by the finer grid and dealt out by midpoint, in part or not at all
        monkeypatch.setattr(simhash, "CELL_PAIRS", most)
        got = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
        assert {v: got.get(v, v) for v in order} == want


def brute_components(values):
    parent = {v: v for v in values}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in values}


def test_manhattan_distance_of_bit_counts(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    values = [int(v) for v in rng.integers(-(1 << 63), (1 << 63) - 1, 200)] + [0, -1, 1 << 62, -(1 << 63)]
    pairs = list(zip(values, values[1:]))
    counts = lambda v: [((v >> s) & 3).bit_count() for s in range(0, 64, 2)]
    got = spark.createDataFrame(pairs, "u long, v long").select("u", "v", simhash.manhattan(F.col("u"), F.col("v")).alias("d")).collect()
    for r in got:
        assert r["d"] == sum(abs(a - b) for a, b in zip(counts(r["u"]), counts(r["v"]))) <= ((r["u"] ^ r["v"]) % (1 << 64)).bit_count()


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = components.components(edges)
    assert got.count() == 301 and got.select("root").distinct().count() == 1 and got.first()["root"] == 0
    assert components.components(edges.limit(0)).count() == 0


def test_mixing(spark, edge_docs, edge_rows, no_docs):
    got = mixing.assign(edge_docs, carry=("doc_id", "source", "text")).collect()
    assert len(got) == len(edge_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r["size"] == len(brute.words(r["text"])) and r["taken"] <= 3 * r["size"]
        assert len(r["positions"]) == -(-r["taken"] // max(r["size"], 1)) and all(0 <= p <= 1 for p in r["positions"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute.targets(sizes)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert mixing.assign(no_docs).count() == 0 and mixing.training_order(no_docs).count() == 0
    order = mixing.training_order(edge_docs)
    assert order.columns == edge_docs.columns
    passes = Counter(r["doc_id"] for r in order.collect())
    want = Counter()
    for r in got:
        want[r["doc_id"]] += int(r["taken"] / max(r["size"], 1) + 0.5)
    assert passes == +want
    again = mixing.assign(edge_docs.repartition(3)).select("doc_id", "size", "taken")
    assert rows(again, "doc_id", "size", "taken") == Counter((r["doc_id"], r["size"], r["taken"]) for r in got)


def test_curriculum_moves_sources_in_time(spark):
    d = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("a b c d").alias("text"))
    got = mixing.assign(d, carry=("doc_id", "source")).select("source", F.explode("positions").alias("p")).groupBy("source").agg(F.avg("p").alias("m")).collect()
    mean = {r["source"]: r["m"] for r in got}
    assert mean["s0"] < 0.45 < mean["s1"] < 0.55 < mean["s2"]
    order = [r["source"] for r in mixing.training_order(d).select("source").collect()]
    assert len(order) == 900 and order[:300].count("s2") < order[-300:].count("s2")


def test_inverse_demand(spark):
    s = ((0.0, 1.0), (0.5, 3.0), (1.0, 0.0))
    for share, want in ((0.0, 0.0), (1 / 1.75, 0.5), (1.0, 1.0)):
        assert abs(spark.range(1).select(mixing.inverse_demand(s, F.lit(share))).first()[0] - want) < 1e-7


def test_exact_dedup(edge_docs, no_docs, pairs):
    got = exact_dedup.exact_dedup(edge_docs)
    assert rows(got, "doc_id", "keep_id", "group_size", "text_sha256") == Counter(brute.exact(pairs))
    kept = got.where("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count() == got.select("text_sha256").distinct().count()
    assert kept.where("NOT doc_id <=> keep_id").count() == 0
    assert exact_dedup.exact_dedup(no_docs).count() == 0


def test_exact_dedup_splits_late(spark):
    """Texts that differ only in their last byte, after several levels, or end early."""
    base = "q" * 20_000
    texts = [base + c for c in "aabbc"] + [base, base, base[:64], base[:64], base[:65]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows(exact_dedup.exact_dedup(d), "doc_id", "keep_id", "group_size", "text_sha256") == Counter(brute.exact(list(enumerate(texts))))


def check_shards(got, n, shards):
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(edge_docs, no_docs, edge_rows):
    got = sharding.shard_documents(edge_docs, 7).collect()
    check_shards(got, len(edge_rows), 7)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 16) for r in edge_rows)
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    assert sharding.shard_documents(no_docs).count() == 0


def test_sharding_gathers_copies(spark):
    d = spark.createDataFrame([(i, f"text {i % 97 if i % 2 else 0 if i % 3 == 0 else i}") for i in range(600)], "doc_id long, text string")
    got = sharding.shard_documents(d, 6)
    check_shards(got.collect(), 600, 6)
    cut = sharding.cut_edges(got).first()
    assert cut["cut"] <= 0.1 * cut["linked"]


def test_sharded_corpus_keeps_the_order(spark, edge_docs, no_docs, edge_rows):
    d = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 300).alias("text"), F.lit(1).alias("shard")).orderBy(F.col("doc_id").desc())
    got = sharding.shard_corpus(d, 7).collect()
    check_shards(got, 500, 7)
    assert all(r["rank"] == 499 - r["doc_id"] for r in got)
    for s in range(7):
        own = sorted((r["slot"], r["rank"]) for r in got if r["shard"] == s)
        assert [r for _, r in own] == sorted(r for _, r in own)
    awkward = sharding.shard_corpus(edge_docs, 7)
    assert Counter(r["doc_id"] for r in awkward.collect()) == Counter(r[0] for r in edge_rows)
    assert sharding.shard_corpus(no_docs).count() == 0


REPEATS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats(edge_docs, no_docs, pairs):
    assert rows(repeats.remove_repeats(edge_docs), *REPEATS) == Counter(brute.repeats(pairs))
    assert repeats.remove_repeats(no_docs).count() == 0


def test_repeats_of_other_ids(spark, pairs):
    """Ids that are strings: their order counts."""
    named = [(None if i is None else f"id{i:05d}", t) for i, t in pairs if i not in (10, 11)]
    d = spark.createDataFrame(named, "doc_id string, text string").repartition(3)
    assert rows(repeats.remove_repeats(d), *REPEATS) == Counter(brute.repeats(named))


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_repeats_with_small_items_and_hot_triggers(spark, monkeypatch, hot):
    """Small items, pieces and chunks: triggers cross items, and some, most or none are hot."""
    monkeypatch.setattr(repeats, "HOT_PHRASES", hot)
    monkeypatch.setattr(repeats, "ITEM_BYTES", 1 << 14)
    monkeypatch.setattr(repeats, "CHUNK", 64)
    d = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 2500").select("doc_id", "text")
    want = Counter(brute.repeats([(r["doc_id"], r["text"]) for r in d.collect()]))
    assert rows(repeats.remove_repeats(d.repartition(6)), *REPEATS) == want


def test_phrases_do_not_depend_on_pieces(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([0, 10, 1500, 1500, 3200, 5000])
    windows = {}
    for piece in (1 << 20, 997, 60):
        monkeypatch.setattr(repeats, "_PIECE", piece)
        p = repeats.parse(data, ends, np.arange(6))
        windows[piece] = sorted((w, t, g) for f, l, t, g in zip(p.first.tolist(), p.last.tolist(), p.trigger.tolist(), p.gram.tolist()) for w in range(f, l + 1))
    assert windows[997] == windows[60] == windows[1 << 20]
    inside = [i for a, b in zip([0, *ends], ends) for i in range(a, b - 49)]
    assert [w for w, _, _ in windows[60]] == inside


def test_windows_in_corpus_order_equal_all_pairs():
    """Bytes with zeros and few letters, so that phrases differ by little and in length."""
    import numpy as np

    rng = np.random.default_rng(5)
    texts = [bytes(rng.choice([0, 97], 400, p=[0.3, 0.7]).astype(np.uint8)) for _ in range(6)]
    texts += [t[:200] + b"x" + t[200:] for t in texts[:4]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    p = repeats.parse(data, np.cumsum([len(t) for t in texts]), np.arange(10))
    body = [data[f : e + 50].tobytes() for f, e in zip(p.first, p.last)]
    order = np.argsort(p.gram, kind="stable")
    offsets = np.concatenate(([0], np.cumsum([len(body[i]) for i in order])))
    bits = repeats.repeated_windows(np.frombuffer(b"".join(body[i] for i in order), np.uint8), offsets, p.gram[order], (p.trigger - p.first)[order], p.rank[order])
    low = {}
    for i in order:
        for j in range(len(body[i]) - 49):
            low[body[i][j : j + 50]] = min(low.get(body[i][j : j + 50], 99), p.rank[i])
    for k, i in enumerate(order):
        assert int(bits[k]) == sum(1 << j for j in range(len(body[i]) - 49) if low[body[i][j : j + 50]] < p.rank[i])


def test_repeats_of_very_many_equal_texts_and_a_very_long_one(spark):
    """100 000 equal texts in one file are cut into items by their bytes; a text of over 16 MB repeats a short one at its end."""
    d = spark.range(100_000).select("id", F.lit("one text that all of these many documents share, to its last byte").alias("text")).withColumnRenamed("id", "doc_id").coalesce(1)
    got = {(r["n_removed"], r["n_spans"]): r["count"] for r in repeats.remove_repeats(d).groupBy("n_removed", "n_spans").count().collect()}
    n = len("one text that all of these many documents share, to its last byte")
    assert got == {(0, 0): 1, (n, 1): 99_999}
    passage = "a passage of more than fifty bytes that only the short document and the end of the long one hold"
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(1_600_000)), lambda i: F.hex(F.xxhash64(i)).substr(1, 10)), F.lit(passage))
    d = spark.range(2).select("id", F.when(F.col("id") == 0, F.lit(passage)).otherwise(long).alias("text")).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(d).collect()}
    assert got[1][0] > 16 << 20 and got[1][1:] == (len(passage), 1) and got[0][1] == 0


def test_decontamination(spark, edge_docs, no_docs, pairs):
    items = [(1, pairs[6][1]), (2, None), (3, "--- "), (4, "alpha beta"), (5, " ".join(f"w{i}" for i in range(40))), (None, "no id"), (1, "wörter école"), (6, "Alpha Beta")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows(decontamination.decontaminate(edge_docs, bench), *cols) == Counter(brute.contamination(pairs, items))
    assert decontamination.decontaminate(no_docs, bench).count() == 0
    assert decontamination.decontaminate(edge_docs, bench.limit(0)).where("n_hit > 0").count() == 0
    clean = decontamination.clean_documents(edge_docs, bench)
    want = Counter(p[0] for p, c in zip(pairs, brute.contamination(pairs, items)) if not c[-1])
    assert Counter(r["doc_id"] for r in clean.collect()) == want and clean.columns == edge_docs.columns


def test_proximity_matches(spark, edge_docs, pairs):
    words = [f"term{i}" for i in range(13)]
    texts = [
        " ".join(reversed(words)), "term1 term2 elsewhere", " ".join(words), " ".join(words[:11]), " ".join(words[:10]), " ".join(w + " other" for w in words),
        " ".join(w + " other word" for w in words), " ".join(words[2:] + ["filler"] * 20 + words[:2]), "x " * 40 + " ".join(words[3:] + words[:1]) + " y" * 40, None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = [(1, " ".join(words)), (2, "term3 term4"), (3, "nowhere nothing never"), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_near"]) for r in decontamination.decontaminate(docs, bench).collect())
    assert got == Counter(brute.near(list(enumerate(texts)), items))
    items = [(1, pairs[6][1]), (2, pairs[13][1]), (5, "one near text of many")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_near"]) for r in decontamination.decontaminate(edge_docs, bench).collect())
    assert got == Counter(brute.near(pairs, items))


def test_proximity_in_random_texts(spark, monkeypatch):
    """Windows of a small vocabulary, so that many are nearly there; with no broadcast at all the rows are the same."""
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(45)]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate((13, 15, 4, 1, 2, 13))]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary + ["w"] * 5, k=rng.randrange(1, 150))
        window = rng.choice(items)[1].split()
        for w in rng.sample(window, len(window) * 5 // 6):
            words.insert(rng.randrange(len(words) // 2, len(words) // 2 + 9), w)
        texts.append(" ".join(words))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = Counter(brute.near(list(enumerate(texts)), items))
    assert len({n for _, n in want}) > 2
    for limit in (_shared.MAX_BROADCAST_BYTES, 0):
        monkeypatch.setattr(_shared, "MAX_BROADCAST_BYTES", limit)
        assert Counter((r["doc_id"], r["n_near"]) for r in decontamination.decontaminate(docs, bench).collect()) == want


def test_warc(spark):
    pages = [(1, "http://a/x y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "u", None), (4, "u\r\nInjected: 1", ""), (None, "n", "<p>same</p>"), (None, None, "only"), (2, None, "<p>same</p>"), (9, "é", "ß" * 200_000), (10, "r", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("n", F.lit(0))
    manifest = warc.write_archives(df)
    for split in (300, 1 << 20):  # splits far smaller than a record, and larger than a file
        got = warc.read_archives(manifest, split)
        assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == Counter(brute.warc(pages))
        assert Counter(bytes(r["payload"]) for r in got.where("record_type = 'response'").collect()) == Counter((p[2] or "").encode() for p, b in zip(pages, brute.warc(pages)) if b[3] == "response")
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_keeps_small_records_whole(spark):
    df = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(df, min_revisit_bytes=5), payloads=False).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_ignores_false_magic(tmp_path):
    import gzip

    members = [warc.record(k, None, f"page {k}".encode() * 50, "D" * 32, 99, True) for k in range(5)]
    junk = warc.MAGIC + b"not a member" + gzip.compress(b"no header")
    data = members[0] + junk + members[1] + junk + b"".join(members[2:])
    (tmp_path / "f.warc.gz").write_bytes(data)
    fs, path = warc.open_store(f"file://{tmp_path}/f.warc.gz")
    for step in (1, 7, 100, len(data)):
        got = [raw for at in range(0, len(data), step) for raw in warc.read_range(fs, path, at, min(at + step, len(data)))]
        assert [warc.parse(r)[0] for r in got] == list(range(5))


def test_secrets(edge_docs, no_docs, pairs):
    found = secrets.scan(edge_docs, secrets.BASE_RULES)
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).alias(f"n_{kind}")
    got = found.select("doc_id", *[count(r.kind) for r in secrets.BASE_RULES], F.sha2(secrets._joined(F.col("found")), 256).alias("base"))
    assert rows(got, *got.columns) == Counter(brute.secrets(pairs))
    assert secrets.scan(no_docs).count() == 0


def test_spans_of_further_kinds_and_of_very_many_matches(spark, edge_docs, pairs):
    """Against loops: the added kinds on the awkward sample, and a text with thousands of matches."""
    import re

    many = " ".join(f"token={i:08d}x" for i in range(3000))
    extra = [(900, "ghp_" + "a1" * 20 + " xoxb-1234567890-ab -----BEGIN RSA PRIVATE KEY----- é ghx_" + "b" * 40), (901, many), (902, "aghp_ghp_" + "Z" * 36)]
    d = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = rows(secrets.scan(d).select("doc_id", secrets._joined(F.col("found")).alias("s")), "doc_id", "s")
    want = Counter()
    for doc_id, text in [*pairs, *extra]:
        found = []
        for rank, r in enumerate(secrets.BASE_RULES + secrets.MORE_RULES):
            for m in re.finditer(r.pattern, text or "", re.I if r.any_case else 0):
                if len(m[r.group]) >= r.min_length:
                    found.append((m.start(), rank, r.kind, m.end()))
        want[doc_id, ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(found))] += 1
    assert got == want


def test_trigram_queries():
    q = secrets.trigram_query(secrets.BASE_RULES[0].pattern)
    assert len(q) == 1 and {frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"}), frozenset({"api", "pik", "ike", "key"})} <= set(q[0])
    assert secrets.trigram_query(r"AKIA[A-Z0-9]+") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query(r"(abc)?x*") == [] and secrets.trigram_query(r"ab|cde") == []
    assert secrets.trigram_query(r"(?:abcd)+x[0-9]+") == [[frozenset({"abc", "bcd"})]]
