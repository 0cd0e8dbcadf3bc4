"""The pipeline against its stages' own decisions, stage by stage."""

from collections import Counter

import brute
import corpus_pipeline
from test_near_copies import kept

from tideflow.llm import mixing, quality, sharding
from tideflow.llm._shared import materialize

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    docs = start = read("documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SF), f"test_{name}")
        if name != "sharding":
            assert docs.schema.names == start.schema.names
        seen[name] = (before, docs)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]

    before, after = seen["quality"]
    assert ids(after) == ids(quality.score_quality(before, read("labels")).where("predicted = 1"))
    before, after = seen["near_dedup"]
    assert ids(after) == Counter(i for i, _ in kept(pairs(before)))
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read("benchmark").collect()]
    assert ids(after) == Counter(c[0] for c in brute.contamination(pairs(before), items) if not c[-1])
    before, after = seen["mixing"]
    want = {r["doc_id"]: round(r["taken"] / max(r["size"], 1) + 1e-9) for r in mixing.assign(before).collect()}
    assert ids(after) == Counter({k: v for k, v in want.items() if v})
    before, after = seen["sharding"]
    assert ids(after) == ids(before)
    placed = after.collect()
    counts = Counter(r["shard"] for r in placed)
    assert max(counts.values()) - min(counts[s] for s in range(sharding.SHARDS)) <= 1
    # slots follow the training order, and every row is whole
    order = [r["doc_id"] for r in before.collect()]
    assert [r["doc_id"] for r in sorted(placed, key=lambda r: r["rank"])] == order
    for s in range(sharding.SHARDS):
        own = sorted((r["slot"], r["rank"]) for r in placed if r["shard"] == s)
        assert [k for k, _ in own] == list(range(len(own))) and [r for _, r in own] == sorted(r for _, r in own)
    assert Counter(pairs(after)) == Counter(pairs(before))


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_stages_on_awkward_rows(spark, edge_docs, no_docs):
    """Nulls, empty and long texts, repeated rows and clashing names, stage by stage; all but the last keep the columns."""
    docs = edge_docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, before, SF), f"edge_{name}")
        assert name == "sharding" or docs.columns == edge_docs.columns
        for row in stage(spark, no_docs, SF).collect():
            raise AssertionError(row)
        if name == "quality":
            docs = before  # whatever it thinks of them, the others get all rows
    assert {"shard", "slot", "rank"} <= set(docs.columns)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
