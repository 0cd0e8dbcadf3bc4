"""Histogram gradient-boosted trees for two classes, in numpy, with flat arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Perfect trees of one depth in heap order: node k has children 2k+1 and 2k+2."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray  # go right above it; +inf where a node was not split
    leaf: np.ndarray  # (trees, 2**depth)
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows go down one level of one tree at a time."""
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            out += leaf[at - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x)) if len(x) else np.zeros(0)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 48, ridge: float = 1.0, least: int = 5) -> Forest:
    """Fit on rows ``x`` and labels ``y`` (0/1). One class, or no rows, gives a constant."""
    n, d = x.shape
    inner = 2**depth - 1
    rate_1 = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(rate_1 / (1 - rate_1)))
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edge: left of it
    margin, features, thresholds, leaves = np.full(n, base), [], [], []
    for _ in range(trees):
        p = sigmoid(margin)
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins, np.int64)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            slot = (at - first) * bins
            gs, hs = np.bincount(at - first, g, width), np.bincount(at - first, h, width)
            alone = gs**2 / (hs + ridge)
            for j in range(d):
                if not len(edges[j]):
                    continue
                key = slot + code[:, j]
                gl = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                hl = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)[:, :-1]
                nl = np.bincount(key, minlength=width * bins).reshape(width, bins).cumsum(1)
                few = (nl[:, :-1] < least) | (nl[:, -1:] - nl[:, :-1] < least)
                gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - alone[:, None]
                gain = np.where(few, -1.0, gain)[:, : len(edges[j])]
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                won = top > best
                best = np.where(won, top, best)
                nodes = first + np.flatnonzero(won)
                feature[nodes], cut[nodes], threshold[nodes] = j, k[won], edges[j][k[won]]
            at = 2 * at + 1 + (code[np.arange(n), feature[at]] > cut[at])
        gs, hs = np.bincount(at - inner, g, inner + 1), np.bincount(at - inner, h, inner + 1)
        leaf = -rate * gs / (hs + ridge)
        margin += leaf[at - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(leaf)
    return Forest(np.stack(features), np.stack(thresholds), np.stack(leaves), base)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability) of a rising step function, to be interpolated."""
    order = np.argsort(z, kind="stable")
    means, weights, centres = [], [], []
    for v, c in zip(y[order].astype(float), z[order]):
        means.append(v), weights.append(1.0), centres.append(c)
        while len(means) > 1 and means[-2] >= means[-1]:
            w = weights[-2] + weights[-1]
            means[-2:] = [(means[-2] * weights[-2] + means[-1] * weights[-1]) / w]
            centres[-2:] = [(centres[-2] * weights[-2] + centres[-1] * weights[-1]) / w]
            weights[-2:] = [w]
    return np.array(centres), np.array(means)
