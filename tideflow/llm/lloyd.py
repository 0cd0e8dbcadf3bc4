"""Centroid clustering by delta Lloyd.

Vectors are integers (floor(64 x)), so distances and sums are exact and the order of additions doesn't matter.
A vector's owner and its distance are kept from round to round. In a round, vectors whose owner stayed where it
was are compared with the centroids that moved only; vectors whose owner moved are compared with all. The sums of the
clusters are carried on: each vector that changes hands is taken from one and added to the other, as signed integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideflow.llm._shared import drop_scratch, materialize, table

DIMENSIONS, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components beyond this count as this: all squared distances of 64 components then fit in a long.
LARGEST = 1 << 27
#: Up to this a squared distance is exact in double arithmetic, too (64 * (2 * LARGEST_FAST)^2 < 2^53).
LARGEST_FAST = 1 << 22


def integer_vectors(vectors: DataFrame, embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, v) of the rows whose vector has ``dimensions`` finite components, as floor(scale * x)."""
    x = F.col(embedding).cast("array<double>")
    fine = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform(F.when(fine, x), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int"))
    return vectors.select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id"), F.coalesce(fine, F.lit(False)).alias("_fine"), whole.alias("v")).where("_fine").drop("_fine")


def seeds(vectors: DataFrame, clusters: int, salt: str = "1") -> np.ndarray:
    """The vectors with the smallest sha256 of ``salt:vec_id``, in its order; null ids come last, ties go by the components."""
    h = F.when(F.col("vec_id").isNotNull(), F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    rows = vectors.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()  # ``clusters`` rows
    return np.array([r["v"] for r in rows], np.int64)


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``v`` to all centroids."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < LARGEST_FAST:
        a, b = v.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)


def reassign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances: ``moved`` says which centroids are not where ``distance`` was taken."""
    owner, distance = owner.copy(), distance.copy()
    lost = np.flatnonzero((owner < 0) | moved[owner])
    if len(lost):
        d = distances(v[lost], centroids)
        owner[lost] = d.argmin(1)  # the first of equals
        distance[lost] = d[np.arange(len(lost)), owner[lost]]
    kept = np.setdiff1d(np.arange(len(v)), lost, assume_unique=True)
    changed = np.flatnonzero(moved)
    if len(kept) and len(changed):
        d = distances(v[kept], centroids[changed])
        best = d.argmin(1)
        near, who = d[np.arange(len(kept)), best], changed[best]
        nearer = (near < distance[kept]) | ((near == distance[kept]) & (who < owner[kept]))
        owner[kept[nearer]], distance[kept[nearer]] = who[nearer], near[nearer]
    return owner, distance


def _round(state: DataFrame, centroids: np.ndarray, moved: np.ndarray, name: str) -> DataFrame:
    """The state (rid, vec_id, v, cluster, distance, was) after one assignment; ``was`` is the owner before it."""
    names = [f for f in state.columns if f != "was"]

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
            v = flat.reshape(batch.num_rows, -1).astype(np.int64)
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            owner, distance = reassign(v, was.astype(np.int64), batch.column("distance").to_numpy(zero_copy_only=False), centroids, moved)
            new = {"cluster": pa.array(owner, pa.int32()), "distance": pa.array(distance, pa.int64()), "was": pa.array(was, pa.int32())}
            cols = [new.get(n, batch.column(n) if n in names else None) for n in [*names, "was"]]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "was"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.select(*names).schema)
    return materialize(state.select(*names).mapInArrow(assign, f"{kinds}, was int"), name)


def _signed_sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each cluster gains and loses in a batch, in longs: a batch's rows times LARGEST stay far below their end."""
    kind = pa.schema([("c", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    for batch in it:
        if not batch.num_rows:
            continue
        v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.int64)
        total: dict[int, tuple[int, np.ndarray]] = {}
        for column, sign in (("cluster", 1), ("was", -1)):
            who = batch.column(column).to_numpy(zero_copy_only=False)
            for c in np.unique(who[who >= 0]):
                mine = who == c
                n, sums = total.get(c, (0, 0))
                total[c] = n + sign * int(mine.sum()), sums + sign * v[mine].sum(0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([x.tolist() for _, x in total.values()], pa.list_(pa.int64()))], schema=kind)


def transfers(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """By cluster: how many vectors it gained in the last assignment (lost ones count negative), and the sum of their components so signed.

    Batches are summed first, then clusters, in decimals; one row a cluster and component comes to the driver.
    """
    part = state.where("cluster != was").select("v", "cluster", "was").mapInArrow(_signed_sums, "c int, n long, sums array<long>")
    # the count goes as a component of its own, at the end
    cells = part.select("c", F.posexplode(F.concat("sums", F.array("n"))).alias("i", "x")).groupBy("c", "i").agg(F.sum(F.col("x").cast("decimal(19,0)")).alias("x"))
    found: dict[int, dict[int, int]] = {}
    for r in cells.collect():
        found.setdefault(r["c"], {})[r["i"]] = int(r["x"])
    return {c: (x[len(x) - 1], [x[i] for i in range(len(x) - 1)]) for c, x in found.items()}


def delta_lloyd(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, embedding: str = "embedding", dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """(rid, vec_id, v, cluster, distance) after ``rounds`` rounds and a last assignment, and the final centroids.

    Every round is written to the shared folder, so a lost executor costs no more than its tasks of that round; sums
    and centroids are a few numbers on the driver. A cluster that owns no vector keeps its centroid.
    """
    start = integer_vectors(vectors, embedding, dimensions)
    state = materialize(start.withColumns({"cluster": F.lit(-1), "distance": F.lit(0).cast("long")}), "vectors")
    centroids = seeds(state, clusters)
    if not len(centroids):
        return state, centroids
    counts, sums = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    moved = np.ones(len(centroids), bool)
    for k in range(rounds + 1):
        after = _round(state, centroids, moved, f"round{k}")
        drop_scratch(state)
        state = after
        if k == rounds:
            break
        for c, (n, s) in transfers(state).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], s)]
        new = np.array([[x // n for x in s] if n else list(old) for n, s, old in zip(counts, sums, centroids)], np.int64)  # // is floor
        moved = (new != centroids).any(1)
        centroids = new
    return state, centroids


def cluster_table(vectors: DataFrame, **how: int) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept.

    Rows whose embedding is null, of another length, or holds a null or non-finite component are left out, as the contract says.
    Repeated rows each keep a row; a null vec_id is no seed while others are left. With fewer vectors than clusters, each is a
    centroid; an empty table gives no rows. Sums of distances beyond a long are null. Other columns are ignored.
    """
    state, centroids = delta_lloyd(vectors, **how)
    sums = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # a row a cluster
    fit = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    inertia, sha = F.lit(None).cast("long"), F.lit(None).cast("string")
    for r in sums:
        c = r["cluster"]
        inertia = F.when(F.col("cluster") == c, fit(int(r["s"]))).otherwise(inertia)
        sha = F.when(F.col("cluster") == c, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()).otherwise(sha)
    return state.select("vec_id", "cluster", "distance", inertia.alias("cluster_inertia"), fit(sum(int(r["s"]) for r in sums)).alias("inertia"), sha.alias("centroid_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_table(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(
            f"d{k} AS (SELECT vec_id, v, n, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{k}), "
            f"a{k} AS (SELECT vec_id, v, n AS cluster, d AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, n) AS place FROM d{k}) WHERE place = 1)"
        )
        if k < ROUNDS:
            steps.append(
                f"p{k} AS (SELECT cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{k}, range(1, {DIMENSIONS + 1}) AS r(i) GROUP BY ALL), "
                f"m{k} AS (SELECT cluster, list(x ORDER BY i) AS c FROM p{k} GROUP BY cluster), "
                f"c{k + 1} AS (SELECT n, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON m.cluster = o.n)"
            )
    k = ROUNDS
    return f"""
WITH k AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS n, v AS c FROM k QUALIFY n < {CLUSTERS}),
{", ".join(steps)},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{k} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{k}) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{k} JOIN i USING (cluster) JOIN c{k} ON n = cluster
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_centroids": op12_centroids}
SQL = {"op12_centroids": _sql()}
