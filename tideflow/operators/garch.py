"""Maximum likelihood of GARCH(1,1) for many series at once, by Newton steps that are aggregations.

The variance path and its derivatives by the parameters obey linear recursions, so that what a block of returns does to
them is a small record: a power of beta with its derivatives, and what the block adds. Blocks are composed by a scan, then
each is run once more from its true start, for its part of the likelihood, of the score and of the second derivatives. A pass
takes several trial points of each series, so a step needs one pass; no task holds more of a series than a batch of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideflow.functions.scalar import finite
from tideflow.functions.scan import SCAN_BLOCK, Record, scan
from tideflow.functions.series import BLOCK, cut, number

#: Persistence alpha + beta, and alpha's part of it, at which the search may start.
STARTS = [(s, w) for s in (0.5, 0.8, 0.9, 0.96, 0.99) for w in (0.03, 0.1, 0.25)]
#: Damping of the trial steps of a round, as parts of the largest curvature.
DAMPING = (0.0, 1e-3, 1e-2, 1e-1, 1.0, 10.0, 1e3)
#: Newton's step is also tried as many times as long: where a parameter goes to its bound, the score only falls by a factor a step.
STRETCH = (4.0, 16.0)
#: Longest step, and bounds of the search (logarithm of the stationary variance over the sample's; two logits).
LONGEST, BOUND = 8.0, 30.0
#: The largest derivative by a return at which a search ends.
SCORE = 1e-10
#: Salts of a series: its blocks meet its trial points in as many places.
SLOTS = 64
#: Blocks of which the derivatives are held at once.
BATCH = 128

#: A power of beta with its two derivatives, and what a block adds to v and to its derivatives (o: omega, a: alpha, b: beta).
NAMES = ["f0", "f1", "f2", "v", "vo", "va", "vb", "vob", "vab", "vbb"]
#: The same and the two derivatives that only the start has.
JET = ["v", "vo", "va", "vb", "vob", "vab", "vbb", "voa", "vaa"]


def _then(first: Record, last: Record) -> Record:
    """The record of one stretch of rows, then another: products of expansions in beta."""
    f0, f1, f2 = (last[c] for c in NAMES[:3])
    return {
        "f0": first["f0"] * f0, "f1": first["f1"] * f0 + first["f0"] * f1, "f2": first["f2"] * f0 + 2 * first["f1"] * f1 + first["f0"] * f2,
        "v": f0 * first["v"] + last["v"], "vo": f0 * first["vo"] + last["vo"], "va": f0 * first["va"] + last["va"],
        "vb": f0 * first["vb"] + f1 * first["v"] + last["vb"], "vob": f0 * first["vob"] + f1 * first["vo"] + last["vob"],
        "vab": f0 * first["vab"] + f1 * first["va"] + last["vab"], "vbb": f0 * first["vbb"] + 2 * f1 * first["vb"] + f2 * first["v"] + last["vbb"],
    }


def _parameters(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """omega, alpha, beta of points (..., 3), all of them admissible."""
    unit = lambda x: 0.5 * (1 + np.tanh(0.5 * x))
    s, w = np.minimum(unit(z[..., 1]), 1 - 1e-12), unit(z[..., 2])
    return np.exp(z[..., 0]) * (1 - s), s * w, s * (1 - w)


def _start(omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> list[np.ndarray]:
    """The stationary variance and its derivatives, in the order of JET."""
    rest = 1 - alpha - beta
    v, one, two = omega / rest, 1 / rest**2, 2 * omega / rest**3
    return [v, 1 / rest, omega * one, omega * one, one, two, two, one, two]


def _step(jet: list[np.ndarray], x: np.ndarray, omega: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> list[np.ndarray]:
    """Variance and derivatives after a squared return."""
    v, vo, va, vb, vob, vab, vbb, voa, vaa = jet
    return [
        omega + alpha * x + beta * v, 1 + beta * vo, x + beta * va, v + beta * vb,
        vo + beta * vob, va + beta * vab, 2 * vb + beta * vbb, beta * voa, beta * vaa,
    ]


def _batches(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of blocks of one number of trial points: rows, lengths, squared returns (block, place), points (block, trial, 3)."""
    for pdf in frames:
        trials = pdf["points"].map(len)
        for k in sorted(trials.unique()):
            same = pdf[trials == k]
            for at in range(0, len(same), BATCH):
                part = same.iloc[at : at + BATCH]
                n = part["r2"].map(len).to_numpy()
                x = np.zeros((len(part), n.max()))
                for i, r2 in enumerate(part["r2"]):
                    x[i, : n[i]] = r2
                yield part, n, x, np.array([[list(z) for z in p] for p in part["points"]], float)


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block does to the variance and its derivatives, for each trial point."""
    for part, n, x, z in _batches(frames):
        omega, alpha, beta = _parameters(z)
        jet = [np.zeros(omega.shape)] * len(JET)
        for t in range(x.shape[1]):
            live = (t < n)[:, None]
            jet = [np.where(live, new, old) for new, old in zip(_step(jet, x[:, t, None], omega, alpha, beta), jet)]
        m = n[:, None]
        powers = [beta**m, m * beta ** np.maximum(m - 1, 0), m * (m - 1) * beta ** np.maximum(m - 2, 0)]
        k = omega.shape[1]
        out = {"series": np.repeat(part["series"], k), "idx": np.repeat(part["block"], k), "trial": np.tile(np.arange(k), len(part))}
        yield pd.DataFrame({**out, **{c: v.ravel() for c, v in zip(NAMES, [*powers, *jet[:7]])}})


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each block's part of the likelihood, of its 3 first and of its 6 second derivatives by omega, alpha and beta."""
    for part, n, x, z in _batches(frames):
        omega, alpha, beta = _parameters(z)
        s = _start(omega, alpha, beta)
        f0, f1, f2, *add = np.moveaxis(np.array([[list(b) for b in before] for before in part["before"]], float), -1, 0)
        v, vo, va, vb, vob, vab, vbb, voa, vaa = s
        start = [f0 * v, f0 * vo, f0 * va, f0 * vb + f1 * v, f0 * vob + f1 * vo, f0 * vab + f1 * va, f0 * vbb + 2 * f1 * vb + f2 * v]
        jet = [*(a + b for a, b in zip(start, add)), f0 * voa, f0 * vaa]
        total = np.zeros((10, *omega.shape))
        with np.errstate(all="ignore"):  # a trial point may run off; it is then not taken
            for t in range(x.shape[1]):
                live, r2 = (t < n)[:, None], x[:, t, None]
                v, vo, va, vb, vob, vab, vbb, voa, vaa = jet
                one, two = (1 / v - r2 / v**2) / 2, (2 * r2 / v**3 - 1 / v**2) / 2
                terms = [
                    (np.log(2 * np.pi * v) + r2 / v) / 2, one * vo, one * va, one * vb,
                    two * vo * vo, two * vo * va + one * voa, two * vo * vb + one * vob, two * va * va + one * vaa, two * va * vb + one * vab, two * vb * vb + one * vbb,
                ]
                total += np.where(live, np.array(terms), 0.0)
                jet = _step(jet, r2, omega, alpha, beta)
        k = omega.shape[1]
        out = {"series": np.repeat(part["series"], k), "trial": np.tile(np.arange(k), len(part))}
        yield pd.DataFrame({**out, **{f"s{i}": c.ravel() for i, c in enumerate(total)}})


def _in_search(z: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and second derivatives by the coordinates of the search, from those by omega, alpha and beta."""
    g, (oo, oa, ob, aa, ab, bb) = sums[1:4], sums[4:]
    h = np.array([[oo, oa, ob], [oa, aa, ab], [ob, ab, bb]])
    s, w = 0.5 * (1 + np.tanh(0.5 * z[1:]))
    ds, dw = s * (1 - s), w * (1 - w)
    dds, ddw = ds * (1 - 2 * s), dw * (1 - 2 * w)
    e = np.exp(z[0])
    j = np.array([[e * (1 - s), -e * ds, 0], [0, ds * w, s * dw], [0, ds * (1 - w), -s * dw]])
    bent = [
        [[e * (1 - s), -e * ds, 0], [-e * ds, -e * dds, 0], [0, 0, 0]],
        [[0, 0, 0], [0, dds * w, ds * dw], [0, ds * dw, s * ddw]],
        [[0, 0, 0], [0, dds * (1 - w), -ds * dw], [0, -ds * dw, -s * ddw]],
    ]
    return j.T @ g, j.T @ h @ j + np.tensordot(g, np.array(bent), 1)


def _trials(z: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[list[float]]:
    """Newton's step, more and more damped ones, and longer ones; a direction that curves down is taken as if it curved up."""
    bends, axes = np.linalg.eigh(h)
    size = np.abs(bends)
    top = max(float(size.max()), 1e-300)
    out = []
    for damp, times in [*((d, 1.0) for d in DAMPING), *((0.0, s) for s in STRETCH)]:
        d = -times * axes @ ((axes.T @ g) / np.maximum(size + damp * top, 1e-12 * top))
        d *= min(1.0, LONGEST / max(float(np.linalg.norm(d)), 1e-300))
        out.append(np.clip(z + d, -BOUND, BOUND).tolist())
    return out


def _moved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a series: the best trial point is taken if it is better, and the next ones are laid out."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            points, sums = np.array([list(p) for p in r.points], float), np.array([list(s) for s in r.sums], float)
            z, now, score, points_next, done = list(r.z), r.now, r.score, list(map(list, r.points)), True
            if len(sums):
                nll = np.where(np.isfinite(sums).all(axis=1), sums[:, 0], np.inf)
                slack = 1e-12 * (r.n + abs(nll.min())) if np.isfinite(nll.min()) else 0.0
                made = {i: _in_search(points[i], sums[i]) for i in np.flatnonzero(nll <= min(nll.min(), now) + slack)}
                slope = {i: float(np.abs(g).max()) / r.n for i, (g, _) in made.items()}
                # below what the sum can tell apart, the score decides
                best = min(made, key=lambda i: (nll[i] >= now - slack, slope[i] if nll[i] >= now - slack else nll[i]), default=None)
                if best is not None and (nll[best] < now - slack or slope[best] < 0.5 * score):
                    z, now, score = points[best].tolist(), min(float(nll[best]), now), slope[best]
                    done = score <= SCORE
                    points_next = _trials(points[best], *made[best])
            rows.append((r.series, r.n, r.scale, z, now, score, r.rounds + 1, done, points_next))
        yield pd.DataFrame(rows, columns=["series", "n", "scale", "z", "now", "score", "rounds", "done", "points"])


_STATE = "series string, n long, scale double, z array<double>, now double, score double, rounds int, done boolean, points array<array<double>>"


def _record_array(names: list[str]) -> Column:
    return F.array(*[F.col(c) for c in names])


def fit_garch(returns: DataFrame, least: int = 100, rounds: int = 60, block: int = SCAN_BLOCK) -> DataFrame:
    """series, omega, alpha, beta, nll, persistence by maximum likelihood, and score, rounds.

    Missing and non-finite returns are left out; series with fewer than ``least`` others, or whose returns are all 0, have no row.
    The search runs over the logarithm of the stationary variance and the logits of the persistence and of alpha's part of
    it, where every point is admissible, from the best of a grid with the sample's variance. ``nll`` is that of returns in percent.
    ``score`` is the largest derivative of the likelihood in those coordinates, divided by the number of returns.
    """
    r = returns.select("series", "idx", finite(F.col("r")).alias("r")).where("r IS NOT NULL")
    r = number(r, ["series"], F.floor(F.col("idx") / BLOCK), [F.col("idx")], "at")
    size = r.groupBy("series").agg(F.count("*").alias("n"), F.var_pop("r").alias("scale"), F.max(F.abs("r")).alias("_top")).where((F.col("n") >= least) & (F.col("_top") > 0))
    size = size.select("series", "n", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0).alias("scale"))
    r2 = r.join(size, "series").select("series", "at", (F.col("r") * F.col("r") / F.col("scale")).alias("x"))
    held = r2.groupBy("series", F.floor(F.col("at") / block).alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("rows"))
    held = cut(held.select("series", "block", (F.col("block") % SLOTS).alias("_slot"), F.col("rows.x").alias("r2")))

    logit = lambda p: float(np.log(p / (1 - p)))
    grid = F.array(*[F.array(F.lit(0.0), F.lit(logit(s)), F.lit(logit(w))) for s, w in STARTS])
    first = size.select("series", "n", "scale", F.array().cast("array<double>").alias("z"), F.lit(float("inf")).alias("now"), F.lit(float("inf")).alias("score"), F.lit(0).alias("rounds"), F.lit(False).alias("done"), grid.alias("points"))
    state = cut(first)
    longest = state.agg(F.max("n")).first()[0] or 0
    levels = 0 if longest <= block * SCAN_BLOCK else 1
    one = {c: F.lit(1.0 if c == "f0" else 0.0) for c in NAMES}
    reals = ", ".join(f"{c} double" for c in NAMES)
    for _ in range(rounds):
        going = state.where("NOT done")
        if going.isEmpty():
            break
        spread = going.select("series", "points", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("_slot"))
        at = held.join(spread, ["series", "_slot"]).drop("_slot")
        heads = at.mapInPandas(_heads, f"series string, idx long, trial int, {reals}")
        before = scan(heads.select(F.struct("series", "trial").alias("series"), "idx", *NAMES), NAMES, _then, one, levels=levels)
        before = before.groupBy(F.col("series.series").alias("series"), F.col("idx").alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("series.trial").alias("trial"), _record_array(NAMES).alias("b")))).alias("_b"))
        parts = at.join(before.select("series", "block", F.col("_b.b").alias("before")), ["series", "block"])
        s = parts.mapInPandas(_sums, "series string, trial int, " + ", ".join(f"s{i} double" for i in range(10)))
        s = s.groupBy("series", "trial").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(10)])
        s = s.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("trial", _record_array([f"s{i}" for i in range(10)]).alias("s")))).alias("_s"))  # as many as trial points
        state = cut(going.join(s.select("series", F.col("_s.s").alias("sums")), "series").mapInPandas(_moved, _STATE).unionByName(state.where("done")))
    unit = lambda x: (F.tanh(x / 2) + 1) / 2
    s, w = F.least(unit(F.col("z")[1]), F.lit(1 - 1e-12)), unit(F.col("z")[2])
    found = state.where(F.size("z") == 3)
    return found.select(
        "series", (F.exp(F.col("z")[0]) * (1 - s) * F.col("scale")).alias("omega"), (s * w).alias("alpha"), (s * (1 - w)).alias("beta"),
        (F.col("now") + 0.5 * F.col("n") * F.ln(F.col("scale") * 1e4)).alias("nll"), s.alias("persistence"), "score", "rounds",
    )
