"""Held-out accuracy, calibration, awkward input, and that held-out labels are never read."""

from collections import Counter

import brute
import numpy as np
import pytest

from pyspark.sql import functions as F
from tideflow.llm import labelled, quality, toxicity, trees

SF = "/root/testdata/sf0.01"


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


CASES = [(quality.score_quality, "quality", 5, 0, 0.3, 0.97, 0.9), (toxicity.score_toxicity, "toxic", 3, 1, 0.7, 0.9, 0.9)]


@pytest.mark.parametrize("operator,label,folds,held,threshold,least_auc,least_acc", CASES)
def test_held_out_accuracy(spark, operator, label, folds, held, threshold, least_auc, least_acc):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = operator(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and (got.predicted == (got.score >= threshold)).all()
    assert (got.held_out == got.doc_id.map(lambda i: brute.remainder(i, folds) == held)).all()
    h = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert auc(h.score.to_numpy(), h[label].to_numpy()) > least_auc
    assert (h.predicted == h[label]).mean() > least_acc
    # labels of the held-out fold do not matter
    id_text = F.crc32(F.col("doc_id").cast("string"))
    turned = labels.withColumn(label, F.when(id_text % folds == held, 1 - F.col(label)).otherwise(F.col(label)))
    again = operator(docs, turned).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


@pytest.mark.parametrize("operator", [quality.score_quality, toxicity.score_toxicity])
def test_awkward_tables(spark, operator, edge_docs, no_docs, edge_rows):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 3, 7, 8, 10, 12, 14)] + [(None, 1, 1), (5, None, None), (1, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0), labels.where("quality = 1")):
        got = operator(edge_docs, lab)
        assert got.count() == len(edge_rows) and got.where("score IS NULL OR isnan(score)").count() == 0
    assert operator(no_docs, labels).count() == 0


def test_training_sample_is_bounded(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    assert labelled.training_texts(docs, labels, "quality", 5, 0, 50).count() == 50


def test_good_documents_keep_columns(spark, edge_docs, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    awkward = quality.good_documents(edge_docs, labels)
    want = Counter(r["doc_id"] for r in quality.score_quality(edge_docs, labels).where("predicted = 1").collect())
    assert awkward.columns == edge_docs.columns and Counter(r["doc_id"] for r in awkward.collect()) == want
    assert quality.good_documents(no_docs, labels).count() == 0
    kept = quality.good_documents(docs, labels)
    want = {r["doc_id"] for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want


def test_disguised_words_count():
    assert toxicity.plain("1d10t!") == "idioti" or toxicity.plain("1d10t") == "idiot"
    lex = {"=idiot": 5.0, "lowei": 4.0}
    clean = toxicity.features("a quiet day by the river", lex)
    for text in ("you are an IDIOT", "you 1d10t", "du loweischaft", "i.d.i.o.t here"):
        assert toxicity.features(text, lex)[0] > clean[0]


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    f = trees.fit(x[:2000], y[:2000])
    assert ((f.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    # flat traversal equals walking each tree
    for row in x[2000:2020]:
        m = f.base
        for feat, thr, leaf in zip(f.feature, f.threshold, f.leaf):
            k = 0
            while k < len(feat):
                k = 2 * k + 1 + int(row[feat[k]] > thr[k])
            m += leaf[k - len(feat)]
        assert abs(f.margin(row[None])[0] - m) < 1e-12


def test_lexicon_counts_equal_a_loop(spark):
    """Each document counts once for an entry, cut from its words as scoring cuts them, odd blanks and disguises included."""
    rng = np.random.default_rng(4)
    words = ["idiot", "1d10t!", "IDIOTIC", "fair\u00a0idiot", "lovely", "l0vely", "x", "...", "Straße", "you"]
    rows = [(i, " ".join(rng.choice(words, 6)) + ("  \u2003idiot" if i % 3 else ""), int(i % 2), int(i % 3)) for i in range(120)]
    rows += [(200 + i, "stupidest words " * 2, 1, i % 3) for i in range(9)]
    got = {e: (a, b) for e, a, b in toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, y int, fold int"))}
    counts = {}
    for _, text, y, fold in rows:
        found = set()
        for raw in text.lower().split():
            if len(w := toxicity.plain(raw)) > 1:
                found |= {"=" + w} | {w[:k] for k in toxicity.STEMS if len(w) >= k}
        for e in found:
            counts.setdefault(e, [[0] * 3, [0] * 3])[y][fold] += 1
    p, n = sum(r[2] for r in rows), sum(1 - r[2] for r in rows)
    for e, (other, toxic) in counts.items():
        a, b = sum(toxic), sum(other)
        odds = np.log((a + 0.5) / (p + 1)) - np.log((b + 0.5) / (n + 1))
        assert (e in got) == (a >= 3 and odds > 2)
        assert e not in got or got[e] == (toxic, other)
    assert "=stupidest" in got


def test_split_search_equals_a_loop():
    """The first split of a tree has the largest gain of all features and edges."""
    rng = np.random.default_rng(6)
    for _ in range(5):
        x = rng.integers(0, 12, (80, 3)).astype(float)
        y = (x[:, 1] + rng.normal(0, 3, 80) > 6).astype(float)
        f = trees.fit(x, y, trees=1, depth=1, rate=0.1, bins=16, ridge=1.0, least=5)
        p = np.full(80, 1 / (1 + np.exp(-f.base)))
        g, h = p - y, p * (1 - p)
        gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
        edges = [(j, e) for j in range(3) for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1]))]
        best = max(gain(x[:, j] <= e) + gain(x[:, j] > e) for j, e in edges if min((x[:, j] <= e).sum(), (x[:, j] > e).sum()) >= 5)
        j, t = f.feature[0, 0], f.threshold[0, 0]
        assert abs(gain(x[:, j] <= t) + gain(x[:, j] > t) - best) < 1e-9
        for side, leaf in ((x[:, j] <= t, f.leaf[0, 0]), (x[:, j] > t, f.leaf[0, 1])):
            assert abs(leaf + 0.1 * g[side].sum() / (h[side].sum() + 1)) < 1e-9


def test_isotonic():
    z = np.array([3.0, 1, 2, 4, 5, 0])
    at, level = trees.isotonic(z, np.array([0.0, 0, 1, 1, 1, 0]))
    assert (np.diff(level) > 0).all() and (np.diff(at) > 0).all() and level[0] == 0 and level[-1] == 1
