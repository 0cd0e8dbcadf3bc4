"""Fits in numpy on one series, against which the aggregated ones are tested."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A ridge far below any statistical effect, and the least weight of an observation.
RIDGE, LEAST_WEIGHT = 1e-6, 1e-9


def logistic_fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray | None:
    """Logistic regression; x carries its own constant column. None where no finite fit is found.

    Each round is a weighted linear fit of the working response, solved by QR with the ridge as further
    rows; a round that does not lower the deviance is halved until it does.
    """
    k = x.shape[1]
    pull = np.sqrt(RIDGE) * np.eye(k)
    b = np.zeros(k)

    def deviance(b: np.ndarray) -> float:
        eta = x @ b
        return float((np.logaddexp(0, eta) - y * eta).sum() + 0.5 * RIDGE * b @ b)

    now = deviance(b)
    for _ in range(rounds):
        eta = np.clip(x @ b, -30, 30)
        p = 1 / (1 + np.exp(-eta))
        w = np.maximum(p * (1 - p), LEAST_WEIGHT)
        q, r = np.linalg.qr(np.concatenate((np.sqrt(w)[:, None] * x, pull)))
        if not np.isfinite(r).all() or np.abs(np.diag(r)).min() < 1e-12:
            return None
        aim = np.linalg.solve(r, q.T @ np.concatenate((np.sqrt(w) * (eta + (y - p) / w), np.zeros(k))))
        part = 1.0
        while not (then := deviance(b + part * (aim - b))) <= now and part > 1e-6:
            part /= 2
        step = part * (aim - b) if then <= now else np.zeros(k)
        b, now = b + step, min(now, then)
        if np.abs(step).max() <= 1e-11 * (1 + np.abs(b).max()):
            break
    return b if np.isfinite(b).all() else None


def nelder_mead(f: Callable[[np.ndarray], float], x0: np.ndarray, rounds: int = 3000, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    n = len(x0)
    simplex = [x0] + [np.where(np.arange(n) == i, np.where(x0 != 0, x0 * 1.05, 0.00025), x0) for i in range(n)]
    vals = [f(x) for x in simplex]
    for _ in range(rounds):
        order = np.argsort(vals, kind="stable")
        simplex, vals = [simplex[i] for i in order], [vals[i] for i in order]
        if max(np.abs(x - simplex[0]).max() for x in simplex[1:]) <= tol and max(abs(v - vals[0]) for v in vals[1:]) <= tol:
            break
        centre = np.mean(simplex[:-1], axis=0)
        along = lambda t: centre + t * (centre - simplex[-1])  # noqa: B023, E731
        xr = along(1.0)
        fr = f(xr)
        if fr < vals[0]:
            xe = along(2.0)
            fe = f(xe)
            simplex[-1], vals[-1] = (xe, fe) if fe < fr else (xr, fr)
        elif fr < vals[-2]:
            simplex[-1], vals[-1] = xr, fr
        else:
            xc = along(0.5 if fr < vals[-1] else -0.5)
            fc = f(xc)
            if fc < min(fr, vals[-1]):
                simplex[-1], vals[-1] = xc, fc
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (x - simplex[0]) for x in simplex[1:]]
                vals = [vals[0]] + [f(x) for x in simplex[1:]]
    k = int(np.argmin(vals))
    return simplex[k], vals[k]


def linear_recursion(a: float, drive: np.ndarray, start: float) -> np.ndarray:
    """v[0] = start, v[t] = a * v[t-1] + drive[t-1]."""
    out = np.empty(len(drive) + 1)
    out[0] = v = start
    for t, d in enumerate(drive.tolist(), 1):
        v = a * v + d
        out[t] = v
    return out


def _unit(z: float) -> float:
    """The logistic map of the line onto (0, 1), without overflow."""
    return 0.5 * (1 + np.tanh(0.5 * z))


def garch_deviance(r2: np.ndarray, omega: float, alpha: float, beta: float) -> float:
    """Negative log-likelihood of squared returns under GARCH(1,1) with normal innovations, started at the stationary variance."""
    var = linear_recursion(beta, omega + alpha * r2[:-1], omega / (1 - alpha - beta))
    return 0.5 * float((np.log(2 * np.pi * var) + r2 / var).sum())


#: Persistence alpha + beta, and alpha's part of it, at which the search may start.
GARCH_STARTS = [(s, w) for s in (0.5, 0.8, 0.9, 0.96, 0.99) for w in (0.03, 0.1, 0.25)]


def fit_garch11(returns: np.ndarray) -> dict[str, float]:
    """GARCH(1,1) by maximum likelihood.

    The search runs over the logarithm of the stationary variance and the logits of the persistence and of
    alpha's part of it, where every point is admissible. It starts at the best point of a grid, with the
    sample's variance.
    """
    r = np.asarray(returns, float)
    scale = float(r.var()) or 1.0
    r2 = r * r / scale

    def parameters(z: np.ndarray) -> tuple[float, float, float]:
        s, w = min(_unit(z[1]), 1 - 1e-12), _unit(z[2])
        return float(np.exp(np.clip(z[0], -50, 50)) * (1 - s)), s * w, s * (1 - w)

    logit = lambda p: float(np.log(p / (1 - p)))
    grid = [np.array([0.0, logit(s), logit(w)]) for s, w in GARCH_STARTS]
    value = lambda z: garch_deviance(r2, *parameters(z))
    z, best = nelder_mead(value, min(grid, key=value), 600, 1e-9)
    z, best = nelder_mead(value, z, 600, 1e-9)  # once more, from a fresh simplex
    omega, alpha, beta = parameters(z)
    # the deviance is that of returns in percent, as is usual
    return {"omega": omega * scale, "alpha": alpha, "beta": beta, "nll": best + 0.5 * len(r) * float(np.log(scale * 1e4)), "persistence": alpha + beta}
