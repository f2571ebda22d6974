"""Portfolio optimisers over a mean vector and a covariance matrix (as many rows as assets, so they run on the driver)."""

from __future__ import annotations

import numpy as np


def project(v: np.ndarray) -> np.ndarray:
    """Nearest long-only weights that sum to 1."""
    u = np.sort(v)[::-1]
    c = np.cumsum(u) - 1
    k = np.flatnonzero(u - c / np.arange(1, len(v) + 1) > 0)[-1]
    return np.maximum(v - c[k] / (k + 1), 0)


def min_variance(cov: np.ndarray, steps: int = 5000) -> np.ndarray:
    """Long-only weights of least variance, by accelerated projected gradients."""
    w = y = np.full(len(cov), 1 / len(cov))
    rate, t = 1 / max(np.linalg.eigvalsh(cov)[-1] * 2, 1e-12), 1.0
    for _ in range(steps):
        new = project(y - rate * 2 * cov @ y)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + (t - 1) / nxt * (new - w), new, nxt
    return w


def tangency(mu: np.ndarray, cov: np.ndarray, rf: float = 0.06) -> np.ndarray:
    """Long-only weights of the greatest Sharpe ratio: the best of the risk-aversion path."""
    best, out = -np.inf, np.full(len(mu), 1 / len(mu))
    top = np.linalg.eigvalsh(cov)[-1]
    for aversion in np.geomspace(0.05, 500, 60):
        w = np.full(len(mu), 1 / len(mu))
        rate = 1 / max(aversion * top, 1e-9)
        for _ in range(400):
            w = project(w + rate * (mu - aversion * cov @ w))
        sharpe = (w @ mu - rf) / max(np.sqrt(w @ cov @ w), 1e-12)
        if sharpe > best:
            best, out = sharpe, w
    return out


def black_litterman(cov: np.ndarray, prior: np.ndarray, views: dict[int, tuple[float, float]], tau: float = 0.05) -> np.ndarray:
    """Posterior means for absolute views {asset: (return, confidence)}; the prior where the system is singular."""
    if not views:
        return prior
    p = np.zeros((len(views), len(prior)))
    q, omega = np.zeros(len(views)), np.zeros(len(views))
    for k, (asset, (value, confidence)) in enumerate(sorted(views.items())):
        p[k, asset], q[k] = 1, value
        omega[k] = cov[asset, asset] * tau * (1 - confidence) / (confidence + 1e-6) + 1e-12
    try:
        a = np.linalg.inv(tau * cov)
        return np.linalg.solve(a + p.T @ np.diag(1 / omega) @ p, a @ prior + p.T @ (q / omega))
    except np.linalg.LinAlgError:
        return prior


def effective_factors(values: np.ndarray) -> float:
    return float(values.sum() ** 2 / (values**2).sum())
