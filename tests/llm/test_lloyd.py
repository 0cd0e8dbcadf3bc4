"""Delta Lloyd against plain Lloyd in Python integers, on awkward vectors, ties, copies and empty tables."""

import hashlib
import math
from collections import Counter

import numpy as np

from tideflow.llm import lloyd

KIND = "vec_id long, embedding array<float>, cluster string, distance string, v string, rid string, was string, label int"


def kept(rows, d):
    out = []
    for i, x in rows:
        if x is not None and len(x) == d and all(c is not None and math.isfinite(c) for c in x):
            out.append((i, tuple(max(-lloyd.LARGEST, min(lloyd.LARGEST, math.floor(64 * float(np.float32(c))))) for c in x)))
    return out


def brute(rows, d, clusters=16, rounds=3):
    vectors = kept(rows, d)
    order = sorted(vectors, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:clusters]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((dist(v, c), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in vectors]
        new = []
        for k, c in enumerate(centroids):
            mine = [v for (_, v), o in zip(vectors, owners) if o == k]
            new.append(tuple(sum(x) // len(mine) for x in zip(*mine)) if mine else c)
        centroids = new
    last = [(i, *nearest(v)) for i, v in vectors]
    inertia = Counter()
    for _, x, k in last:
        inertia[k] += x
    fit = lambda n: n if n < 1 << 63 else None
    return Counter((i, k, x, fit(inertia[k]), fit(sum(inertia.values())), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, x, k in last)


def table(spark, rows):
    return spark.createDataFrame([(i, x, "a", "b", "c", "d", "e", 0) for i, x in rows], KIND).repartition(5)


def got(df, **how):
    return Counter(tuple(r) for r in lloyd.cluster_table(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect())


def test_awkward_vectors_equal_plain_rounds(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 4).astype(np.float32)]) for i in range(300)]
    rows += [(1000 + i, [0.5, 0.5, -0.25, 0.0]) for i in range(150)]  # a third are copies
    rows += [(5, [0.1, 0.2, 0.3, 0.4]), (5, [0.1, 0.2, 0.3, 0.4]), (None, [0.0, 0.0, 0.0, 0.0]), (-7, [1e9, -1e9, 3e38, 0.0])]
    bad = [(2001, None), (2002, [0.1] * 3), (2003, [0.1] * 5), (2004, [0.1, None, 0.1, 0.1]), (2005, [float("nan")] * 4), (2006, [float("inf"), 0.0, 0.0, 0.0]), (2007, [])]
    assert got(table(spark, rows + bad), dimensions=4) == brute(rows + bad, 4)
    assert got(table(spark, rows), dimensions=4, rounds=6, clusters=5) == brute(rows, 4, 5, 6)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-0.4, 0.9])]
    assert got(table(spark, rows), dimensions=2) == brute(rows, 2)
    assert got(table(spark, []), dimensions=2) == got(table(spark, [(1, None)]), dimensions=2) == Counter()


def test_only_moved_centroids_are_compared():
    """A round from the kept distances gives what a comparison with all centroids gives, ties included."""
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, (400, 3))
    old = rng.integers(-3, 4, (8, 3))
    d = lloyd.distances(v, old)
    owner, distance = d.argmin(1), d.min(1)
    for moved in (np.zeros(8, bool), np.arange(8) % 3 == 0, np.ones(8, bool)):
        new = np.where(moved[:, None], rng.integers(-3, 4, (8, 3)), old)
        a, b = lloyd.reassign(v, owner, distance, new, moved)
        full = lloyd.distances(v, new)
        assert (a == full.argmin(1)).all() and (b == full.min(1)).all()


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 10, lloyd.LARGEST_FAST - 1, lloyd.LARGEST):
        v, c = rng.integers(-top, top + 1, (50, 64)), rng.integers(-top, top + 1, (4, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        assert lloyd.distances(v, c).tolist() == want
