"""Near copies at 5-word Jaccard 0.8 against all pairs."""

import random
from collections import Counter

import brute
import corpus_pipeline

from tideflow.llm import _shared, components, near_copies


def kept(rows, shingle=5, similarity=0.8):
    """Counter of (doc_id, text) that stay, by comparing all pairs. Equal rows count once; rows must have ids."""
    sets = []
    for _, text in rows:
        w = brute.words((text or "").translate(brute.FOLD))
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))})
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= similarity:
                root[find(i)] = find(j)
    best = {}
    for i, r in enumerate(rows):
        best[find(i)] = min(best.get(find(i), r), r)
    return Counter(best.values())


def edited(words, n, rng):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"edit{rng.random()}"
    return out


def copies():
    """Pairs with few and many edits, and a crowd of edits of one text."""
    rng = random.Random(1)
    texts = []
    for length, edits in [(200, 1), (200, 4), (200, 6), (60, 1), (60, 3), (800, 15), (800, 20)] * 6:
        base = [f"w{rng.randrange(5000)}" for _ in range(length)]
        texts += [base, edited(base, edits, rng)]
    crowd = [f"c{rng.randrange(5000)}" for _ in range(150)]
    texts += [edited(crowd, rng.choice((1, 2, 4)), rng) for _ in range(80)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_stage_finds_all_copies_at_the_similarity(spark):
    rows = copies()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect())
    assert got == kept(rows)


def test_edge_documents(edge_docs, edge_rows, no_docs):
    got = near_copies.keep_one(edge_docs)
    assert got.columns == edge_docs.columns
    named = [(r[0], r[1] or "") for r in edge_rows if r[0] is not None]
    assert Counter((r["doc_id"], r["text"] or "") for r in got.where("doc_id IS NOT NULL").collect()).keys() == kept(named).keys()
    assert got.where("doc_id IS NULL").count() == sum(r[0] is None for r in edge_rows)
    assert near_copies.keep_one(no_docs).count() == 0


def test_no_link_is_lost_in_a_large_bucket(spark):
    """Texts at the threshold: pairs that share three edits of one original, among many others that are near to none."""
    rng = random.Random(11)
    base = [f"w{rng.randrange(9000)}" for _ in range(600)]
    places, texts = rng.sample(range(590), 590), []
    for _ in range(150):
        texts.append(edited(base, 11, rng))
    for k in range(40):
        common = list(base)
        for at in places[3 * k : 3 * k + 3]:
            common[at] = f"shared{k}x{at}"
        free = [i for i in range(600) if i not in places[3 * k : 3 * k + 3]]
        for _ in range(2):
            t = list(common)
            for at in rng.sample(free, 6):
                t[at] = f"own{rng.random()}"
            texts.append(t)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want = kept(rows)
    assert len(want) < len(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == want


def test_a_crowd_that_is_alike_makes_few_pairs(spark, monkeypatch):
    """Edits of one original, near to few of the others: links by common shingles alone are found, and most pairs never made."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(140)]
    rows = []
    for i in range(400):
        text = list(base)
        for at in rng.sample(range(2, 138, 4), rng.choice((2, 3, 3, 3))):
            text[at] = f"own{i}x{at}"
        rows.append((i, " ".join(text)))
    seen, alike = {}, near_copies._alike

    def spy(pairs, sets, similarity, name):
        found = alike(pairs, sets, similarity, name)
        seen[name] = (pairs.count(), found.count())
        return found

    monkeypatch.setattr(near_copies, "_alike", spy)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, d, "").collect()) == kept(rows)
    made, links = seen["rest"]
    assert links and made < 10_000


def test_components_stop_at_stars_and_shuffle_little(spark, monkeypatch):
    """What a round costs the driver: its plan's shuffles; and stars, or no links at all, need no round."""
    written = []

    def noted(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")))
        return _shared.materialize(df, name)

    monkeypatch.setattr(components, "materialize", noted)
    stars = spark.createDataFrame([(9, 1), (5, 1), (8, 2)], "u long, v long")
    assert {tuple(r) for r in components.components(stars).collect()} == {(9, 1), (5, 1), (1, 1), (8, 2), (2, 2)}
    assert components.components(stars.limit(0)).count() == 0
    assert [name for name, _ in written] == ["components0", "components0"]
    written.clear()
    chain = spark.createDataFrame([(k + 1, k) for k in range(40)], "u long, v long").repartition(3)
    assert {tuple(r) for r in components.components(chain).collect()} == {(k, 0) for k in range(41)}
    assert len(written) > 1 and all(n <= 5 for _, n in written[1:])


def test_roots_stay_as_they_are_without_further_links(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1)], "node long, root long")
    assert near_copies._merged(roots, spark.createDataFrame([], "u long, v long"), "roots") is roots
