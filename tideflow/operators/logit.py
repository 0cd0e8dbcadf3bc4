"""Logistic regressions of many series at once, by Newton steps that are aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite, ratio
from tideflow.functions.series import cut

#: A ridge far below any statistical effect, the least weight of an observation, and the bound of the linear predictor in weights.
RIDGE, LEAST_WEIGHT, CLIP = 1e-6, 1e-9, 30.0
#: Halvings of a step that are tried, all in one aggregation.
HALVINGS = 20
TOLERANCE = 1e-11


def _deviance(y: Column, eta: Column) -> Column:
    """-ln likelihood of one row, without overflow."""
    return F.log1p(F.exp(-F.abs(eta))) + F.greatest(eta, F.lit(0.0)) - y * eta


def _penalty(b: Sequence[Column]) -> Column:
    return 0.5 * RIDGE * sum((x * x for x in b[1:]), b[0] * b[0])


def _solved(a: list[list[Column]], g: list[Column]) -> list[Column]:
    """x of a x = g, a symmetric of up to 3 rows, by cofactors; NULL where a is singular."""
    k = len(g)
    if k == 1:
        return [ratio(g[0], a[0][0])]
    if k == 2:
        det = a[0][0] * a[1][1] - a[0][1] * a[0][1]
        return [ratio(a[1][1] * g[0] - a[0][1] * g[1], det), ratio(a[0][0] * g[1] - a[0][1] * g[0], det)]

    def minor(i: int, j: int) -> Column:
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        m = a[r[0]][c[0]] * a[r[1]][c[1]] - a[r[0]][c[1]] * a[r[1]][c[0]]
        return m if (i + j) % 2 == 0 else -m

    det = sum((a[0][j] * minor(0, j) for j in (1, 2)), a[0][0] * minor(0, 0))
    return [ratio(sum((minor(i, j) * g[i] for i in (1, 2)), minor(0, j) * g[0]), det) for j in range(3)]


def fit_logistic(df: DataFrame, y: str, features: Sequence[str], keys: Sequence[str] = ("series",), least: int = 1, rounds: int = 60) -> DataFrame:
    """keys, b (intercept, then one for each of up to two ``features``), n, rounds of the logistic regression of ``y`` (0 or 1) by key.

    All keys run through the same rounds. A round is one aggregation of the gradient and the weighted cross products, solved by key,
    and one of the deviance along the step, which is halved until it does not rise. Rows with a missing or non-finite value
    don't count. Keys of fewer than ``least`` rows or of one class have no row, nor have those without a finite fit; where the
    classes are apart the ridge keeps the fit finite. No row leaves the executors but a few numbers a key.
    """
    keys, features = list(keys), list(features)
    if len(features) > 2:
        raise ValueError("at most two features")
    k = len(features) + 1
    rows = df.select(*keys, finite(F.col(y).cast("double")).alias("_y"), *[finite(F.col(f).cast("double")).alias(f"_x{i}") for i, f in enumerate(features, 1)])
    rows = cut(rows.na.drop().withColumn("_x0", F.lit(1.0)))
    ok = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
    state = cut(ok.where((F.col("n") >= least) & (F.col("_lo") < F.col("_hi"))).select(*keys, "n", *[F.lit(0.0).alias(f"b{i}") for i in range(k)], (F.col("n") * F.ln(F.lit(2.0))).alias("now"), F.lit(0).alias("rounds"), F.lit(False).alias("done")))
    x, b = [F.col(f"_x{i}") for i in range(k)], [F.col(f"b{i}") for i in range(k)]
    dot = lambda c: sum((u * v for u, v in zip(c[1:], x[1:])), c[0] * x[0])
    for _ in range(rounds):
        going = state.where("NOT done")
        if going.isEmpty():
            break
        eta = F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), dot(b)))
        p = 1 / (1 + F.exp(-eta))
        w = F.greatest(p * (1 - p), F.lit(LEAST_WEIGHT))
        at = rows.join(going.select(*keys, *[f"b{i}" for i in range(k)]), keys)
        at = at.withColumns({"_w": w, "_g": w * eta + F.col("_y") - p})
        sums = [F.sum(F.col("_w") * x[i] * x[j]).alias(f"a{i}{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("_g") * x[i]).alias(f"g{i}") for i in range(k)]
        s = at.groupBy(*keys).agg(*sums)
        a = [[F.col(f"a{min(i, j)}{max(i, j)}") + (RIDGE if i == j else 0.0) for j in range(k)] for i in range(k)]
        aim = s.select(*keys, *[c.alias(f"t{i}") for i, c in enumerate(_solved(a, [F.col(f"g{i}") for i in range(k)]))])
        step = cut(going.join(aim, keys))
        # the deviance at the whole step and at its halves, quarters, ...
        parts = [0.5**h for h in range(HALVINGS + 1)]
        line = rows.join(step.select(*keys, *[f"b{i}" for i in range(k)], *[f"t{i}" for i in range(k)]), keys).select(*keys, "_y", dot(b).alias("_e"), dot([F.col(f"t{i}") for i in range(k)]).alias("_t"))
        dev = line.groupBy(*keys).agg(*[F.sum(_deviance(F.col("_y"), F.col("_e") + h * (F.col("_t") - F.col("_e")))).alias(f"d{i}") for i, h in enumerate(parts)])
        there = lambda h: [b[i] + h * (F.col(f"t{i}") - b[i]) for i in range(k)]
        tries = F.array(*[F.struct(F.lit(h).alias("h"), (F.col(f"d{i}") + _penalty(there(h))).alias("d")) for i, h in enumerate(parts)])
        best = F.try_element_at(F.filter(tries, lambda t: t["d"] <= F.col("now")), F.lit(1))
        moved = step.join(dev, keys, "left").withColumn("_best", best)
        h = F.coalesce(F.col("_best.h"), F.lit(0.0))
        new = [F.when(h > 0, there(h)[i]).otherwise(b[i]) for i in range(k)]
        size = F.greatest(*[F.abs(h * (F.col(f"t{i}") - b[i])) for i in range(k)], F.lit(0.0))
        done = F.coalesce(size <= TOLERANCE * (1 + F.greatest(*[F.abs(c) for c in new], F.lit(0.0))), F.lit(True))
        moved = moved.select(*keys, "n", *[c.alias(f"b{i}") for i, c in enumerate(new)], F.coalesce("_best.d", "now").alias("now"), (F.col("rounds") + 1).alias("rounds"), done.alias("done"))
        state = cut(moved.unionByName(state.where("done")))
    return state.select(*keys, F.array(*[f"b{i}" for i in range(k)]).alias("b"), "n", "rounds")
