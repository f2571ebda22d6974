"""Per-symbol models: regimes, volatility, stationarity, walk-forward signals. Each is a grouped map over a symbol's bars."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def two_gaussians(x: np.ndarray, steps: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a two-component mixture in one dimension, started from the outer quartiles."""
    m, s, w = np.quantile(x, [0.25, 0.75]), np.full(2, x.std() + 1e-9), np.full(2, 0.5)
    for _ in range(steps):
        d = w * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2) / s
        r = d / np.maximum(d.sum(1, keepdims=True), 1e-300)
        n = np.maximum(r.sum(0), 1e-9)
        m_new = (r * x[:, None]).sum(0) / n
        s = np.sqrt((r * (x[:, None] - m_new) ** 2).sum(0) / n) + 1e-6
        w, done, m = n / len(x), np.abs(m_new - m).max() < 1e-10, m_new
        if done:
            break
    return w, m, s


def regime(vol: np.ndarray) -> tuple[str, float]:
    """Stressed or Calm where the last volatility belongs to a component with more than 0.6, else Neutral."""
    vol = vol[np.isfinite(vol)]
    if len(vol) < 100:
        return "Neutral", 0.0
    w, m, s = two_gaussians(vol)
    d = w * np.exp(-0.5 * ((vol[-1] - m) / s) ** 2) / s
    high = float(d[m.argmax()] / max(d.sum(), 1e-300))
    return ("Stressed", high) if high > 0.6 else ("Calm", 1 - high) if 1 - high > 0.6 else ("Neutral", max(high, 1 - high))


def garch(r: np.ndarray) -> tuple[float, float, float, float, float]:
    """(mean, omega, alpha, beta, next deviation) of a GARCH(1,1) with a constant mean, of percent returns.

    The likelihood is climbed along the axes (mean; omega as a multiple of what the sample variance implies; alpha; beta) and
    along alpha against beta, with steps that shrink. The first variance is a weighted mean of the first 75 squares.
    """
    r = 100 * r
    var = max(float(r.var()), 1e-12)
    first = 0.94 ** np.arange(min(75, len(r)))
    first /= first.sum()

    def parts(at):
        mean, factor, alpha, beta = at
        return r - mean, var * max(1 - alpha - beta, 1e-4) * math.exp(factor), alpha, beta

    def path(at):
        e, omega, alpha, beta = parts(at)
        back = float((e[: len(first)] ** 2 * first).sum())
        h, out = omega + (alpha + beta) * back, np.empty(len(e))
        for k, x in enumerate((alpha * e * e + omega).tolist()):
            out[k] = h
            h = x + beta * h
        return e, out, h

    def cost(at):
        if at[2] < 0 or at[3] < 0 or at[2] + at[3] >= 0.9999:
            return math.inf
        e, h, _ = path(at)
        return float((np.log(h) + e * e / h).sum())

    best = np.array([r.mean(), 0.0, 0.05, 0.90])
    scale = np.array([math.sqrt(var), 2.0, 0.1, 0.1])
    axes = np.vstack([np.eye(4), [0, 0, 1, -1]]) * scale
    score, width = cost(best), 1.0
    while width > 1e-3:
        moved = False
        for step in [*(axes * width), *(-axes * width)]:
            if (c := cost(best + step)) < score - 1e-9:
                best, score, moved = best + step, c, True
        if not moved:
            width /= 2
    mean, omega, alpha, beta = best[0], parts(best)[1], best[2], best[3]
    return float(mean / 100), float(omega), float(alpha), float(beta), math.sqrt(path(best)[2]) / 100


def adf(x: np.ndarray, lags: int) -> float:
    """t statistic of the Dickey-Fuller regression with a constant and `lags` lagged differences."""
    a, y = _lagged(x, lags)
    b, *_ = np.linalg.lstsq(a, y, rcond=None)
    e = y - a @ b
    cov = np.linalg.pinv(a.T @ a) * (e @ e) / max(len(y) - a.shape[1], 1)
    return float(b[1] / np.sqrt(max(cov[1, 1], 1e-300)))


def _lagged(x: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Constant, level and `lags` lagged differences, and the differences that they explain."""
    d = np.diff(x)
    y = d[lags:]
    return np.column_stack([np.ones(len(y)), x[lags:-1], *[d[lags - k : len(d) - k] for k in range(1, lags + 1)]]), y


def best_lags(x: np.ndarray) -> int:
    """Lags with the least information criterion (AIC), up to 12 (n / 100) ** 0.25, over rows that all lags have.

    The columns are nested, so one orthogonal basis has the residual sums of all choices.
    """
    n = len(x) - 1
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most <= 0:
        return 0
    a, y = _lagged(x, most)
    q, _ = np.linalg.qr(a)
    rest = np.maximum(y @ y - np.cumsum((q.T @ y) ** 2), 1e-300)[1:]
    return int((len(y) * np.log(rest / len(y)) + 2 * (2 + np.arange(most + 1))).argmin())


def ffd(x: np.ndarray, order: float, least: float = 1e-4) -> np.ndarray:
    """Fractional differences of fixed width: weights down to `least`; empty where the series is no longer than they reach."""
    w = [1.0]
    while len(w) <= len(x) and abs(nxt := -w[-1] * (order - len(w) + 1) / len(w)) >= least:
        w.append(nxt)
    return np.convolve(x, w, "valid") if len(w) <= len(x) else x[:0]


def least_order(p: np.ndarray, critical: float = -2.8615) -> float:
    """Smallest order of 0.05 .. 1 whose fractional difference of log prices is stationary at 5 %; 1 where none is.

    Lags by AIC; the 5 % point is that of long series, as in p-values from response surfaces.
    """
    x = np.log(p)
    if len(x) < 20:
        return 1.0
    for d in np.arange(0.05, 1.0001, 0.05):
        y = ffd(x, d)
        if len(y) >= 10 and y.std() > 0 and adf(y, best_lags(y)) < critical:
            return float(round(d, 2))
    return 1.0


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0) -> np.ndarray:
    """Weights (constant last) of a ridge logistic regression by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w, b, r = np.ones(len(y)) if w is None else w, np.zeros(a.shape[1]), np.eye(a.shape[1]) * ridge
    r[-1, -1] = 1e-8
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        b = b - np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + r, a.T @ (w * (p - y)) + r @ b)
    return b


def by_symbol(bars: DataFrame, f, schema: str) -> DataFrame:
    """f(date-ordered rows) -> dict, for each symbol."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"symbol": key[0]} | f(rows.sort_values("date"))])

    return bars.groupBy("symbol").applyInPandas(run, f"symbol string, {schema}")


def era_weight(date="date"):
    """0.6 before 2018, else 1."""
    return F.when(F.col(date) < F.lit("2018-01-01").cast("date"), 0.6).otherwise(1.0)
