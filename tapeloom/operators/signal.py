"""The walk-forward signal model: every fold of every symbol is a fit of its own, then each symbol's folds are combined.

Nothing that a fold is fitted on lies after its training rows: scaling, the first component and the trees see those alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tapeloom.operators.models import logistic

# Boosting, folds and gates of the original model.
ROUNDS, RATE, DEPTH, LEAF, L2 = 600, 0.03, 3, 40, 1.0
FOLDS, LOOK_BACK, LEAST_TRAIN, LEAST_TEST, CLASS_FLOOR = 5, 63, 50, 10, 0.10
NEUTRAL, RECENT, HIT, CALIBRATION_ROWS = 0.55, 720, 0.60, 200
#: Words in a feature's name that ask for a rising or falling response.
RISING, FALLING = ("sharpe", "momentum", "trend", "strength"), ("vol", "drawdown", "atr", "skew", "kurt")


def direction(name: str) -> int:
    low = name.lower()
    return 1 if any(k in low for k in RISING) else -1 if any(k in low for k in FALLING) else 0


class Boosted:
    """Histogram gradient boosting of log-loss with monotone constraints: depth-wise trees over quantile bins.

    Values are binned once. The histograms of all features of a node are counted together; a sibling's are the difference.
    """

    BINS = 32

    def __init__(self, rounds: int = ROUNDS, rate: float = RATE, depth: int = DEPTH, leaf: int = LEAF, l2: float = L2, monotone: dict[int, int] | None = None):
        self.rounds, self.rate, self.depth, self.leaf, self.l2, self.monotone = rounds, rate, depth, leaf, l2, monotone or {}

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)])

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.BINS)[1:-1])) for c in x.T]
        bins, m = self._binned(x), x.shape[1]
        self.flat, self.sign = bins + np.arange(m) * self.BINS, np.array([self.monotone.get(j, 0) for j in range(m)])[:, None]
        p = np.clip((w * y).sum() / w.sum(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(p / (1 - p))), []
        f, rows = np.full(len(y), self.base), np.arange(len(y))
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            self.g, self.h = w * (y - q), w * q * (1 - q)
            tree = self._grow(bins, rows, self._counted(rows), self.depth, -np.inf, np.inf)
            self.trees.append(tree)
            f = f + self.rate * self._value(tree, bins)
        del self.flat, self.g, self.h
        return self

    def _counted(self, rows) -> np.ndarray:
        """Sums of gradients and curvatures, and counts: 3 x feature x bin."""
        at, m = self.flat[rows].ravel(), self.flat.shape[1]
        parts = (np.bincount(at, None if v is None else np.repeat(v[rows], m), m * self.BINS) for v in (self.g, self.h, None))
        return np.stack([v.reshape(m, self.BINS) for v in parts])

    def _grow(self, bins, rows, sums, depth, low, high):
        g, h, n = sums[:, 0].sum(1)
        value = float(np.clip(g / (h + self.l2), low, high))
        if not depth or n < 2 * self.leaf:
            return value
        cg, ch, cn = np.cumsum(sums, 2)[:, :, :-1]
        left, right = cg / (ch + self.l2), (g - cg) / (h - ch + self.l2)
        gain = cg * left + (g - cg) * right - g * g / (h + self.l2)
        ok = (cn >= self.leaf) & (n - cn >= self.leaf) & (self.sign * (right - left) >= 0)
        gain = np.where(ok, gain, -1.0)
        j, k = divmod(int(gain.argmax()), gain.shape[1])
        if gain[j, k] <= 1e-9:
            return value
        sign, to_left = int(self.sign[j, 0]), bins[rows, j] <= k
        mid = float((np.clip(left[j, k], low, high) + np.clip(right[j, k], low, high)) / 2)
        a, b = rows[to_left], rows[~to_left]
        if depth > 1:
            less = self._counted(a if len(a) <= len(b) else b)
            sa, sb = (less, sums - less) if len(a) <= len(b) else (sums - less, less)
        else:  # leaves need the sums of one feature alone
            sa, sb = (np.array([[[v[r].sum()]] for v in (self.g, self.h, np.ones(len(self.g)))]) for r in (a, b))
        low_a, high_a = (mid if sign < 0 else low), (mid if sign > 0 else high)
        low_b, high_b = (mid if sign > 0 else low), (mid if sign < 0 else high)
        return j, k, self._grow(bins, a, sa, depth - 1, low_a, high_a), self._grow(bins, b, sb, depth - 1, low_b, high_b)

    def _value(self, tree, bins):
        if isinstance(tree, float):
            return np.full(len(bins), tree)
        j, k, a, b = tree
        return np.where(bins[:, j] <= k, self._value(a, bins), self._value(b, bins))

    def predict(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        return 1 / (1 + np.exp(-self.base - self.rate * sum(self._value(t, bins) for t in self.trees)))


class Prepared:
    """Features scaled by quartiles, less a share of their first principal component; fitted on the rows it is made with."""

    def __init__(self, x: np.ndarray):
        q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
        self.middle, self.width = q[1], np.where(q[2] - q[0] > 1e-9, q[2] - q[0], 1)
        z = (x - self.middle) / self.width
        self.mean = z.mean(0)
        self.axis = np.linalg.svd(z - self.mean, full_matrices=False)[2][:1]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.middle) / self.width
        return z - NEUTRAL * ((z - self.mean) @ self.axis.T @ self.axis + self.mean)


def splits(n: int, folds: int, horizon: int) -> list[tuple[int, int, int]]:
    """(training rows, first and last test row + 1) of each forward-chained fold, after its gap and embargo."""
    folds = max(3, min(folds, n // 50))
    size, gap, out = n // (folds + 1), 5 if n < 300 else 20, []
    for k in range(folds):
        start = n - (folds - k) * size
        train = max(0, start - gap)
        train -= min(max(LOOK_BACK, horizon), max(0, train - LEAST_TRAIN))
        out.append((train, start, start + size))
    return out


def balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, len(y) / 2 / max(y.sum(), 1), len(y) / 2 / max((1 - y).sum(), 1))


def eras(dates: pd.Series) -> np.ndarray:
    return np.where(pd.to_datetime(dates) < pd.Timestamp("2018-01-01"), 0.6, 1.0)


_FITTED = "symbol string, fold int, kind string, prob double, target double, note string"


def fit_fold(rows: pd.DataFrame, fold: int, features: list[str], horizon: int, folds: int, rounds: int) -> list[tuple]:
    """(kind, prob, target, note) of one fold: out-of-sample rows of a fold from 1 on; of fold 0, the last row's probability."""
    rows = rows.sort_values("date")
    known = rows[rows["target"].notna()]
    n, monotone = len(known), {j: d for j, c in enumerate(features) if (d := direction(c))}
    if n < max(150, 2 * horizon):
        return [("short history", 0.5, None, "")] if fold == 0 else []
    x, y = known[features].fillna(0).to_numpy(float), known["target"].to_numpy(float)
    if len(set(y)) < 2:
        return [("one class", 0.0, None, "")] if fold == 0 else []
    if fold:
        plan = splits(n, folds, horizon)
        if fold > len(plan):
            return []
        train, start, stop = plan[fold - 1]
        a, b = slice(0, train), slice(start, stop)
        inside = lambda v: CLASS_FLOOR <= v.mean() <= 1 - CLASS_FLOOR
        if train < LEAST_TRAIN or stop - start < LEAST_TEST or not inside(y[a]) or not inside(y[b]):
            return []
        recent = np.linspace(0.7, 1.3, train)
        w = recent / recent.sum() * balanced(y[a]) * np.linspace(0.8, 1.2, train) * eras(known["date"][:train])
        prepare = Prepared(x[a])
        p = Boosted(rounds, monotone=monotone).fit(prepare(x[a]), y[a], w).predict(prepare(x[b]))
        return [("oos", float(q), float(t), "") for q, t in zip(p, y[b])]
    last = rows[features].fillna(0).to_numpy(float)[-1:]
    prepare = Prepared(x)
    w = balanced(y) / max(1, horizon) * np.linspace(0.8, 1.2, n) * eras(known["date"])
    p = float(Boosted(rounds, monotone=monotone).fit(prepare(x), y, w).predict(prepare(last))[0])
    with np.errstate(invalid="ignore", divide="ignore"):
        drive = {c: abs(np.corrcoef(x[:, j], y)[0, 1]) for j, c in enumerate(features)}
    top = sorted(drive, key=lambda c: (-np.nan_to_num(drive[c]), c))[:8]
    out = [("trees", p, None, ",".join(top))]
    xr, yr = x[-RECENT:], y[-RECENT:]
    cut = max(len(yr) * 4 // 5, len(yr) - 40)
    if len(yr) >= 200 and len(set(yr)) > 1 and len(set(yr[:cut])) > 1:
        prepare = Prepared(xr[:cut])
        b = logistic(prepare(xr[:cut]), yr[:cut], balanced(yr[:cut]), ridge=1 / 0.35)
        score = lambda v: 1 / (1 + np.exp(-np.clip(np.column_stack([prepare(v), np.ones(len(v))]) @ b, -30, 30)))
        hits = float(((score(xr[cut:]) > 0.5) == (yr[cut:] > 0)).mean()) if len(set(yr[cut:])) > 1 else None
        out.append(("logistic", float(score(last)[0]), hits, ""))
    return out


def fold_score(p: np.ndarray, y: np.ndarray) -> dict:
    """Accuracy at HIT, balanced accuracy, AUC, Brier score, log-loss and the combined score of one fold."""
    hat, q = p > HIT, np.clip(p, 1e-4, 1 - 1e-4)
    pos, rank = y.sum(), pd.Series(p).rank().to_numpy()
    auc = (rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))
    loss = float(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean())
    return {
        "accuracy": float((hat == (y > 0)).mean()),
        "balanced_accuracy": float((hat[y == 1].mean() + (~hat[y == 0]).mean()) / 2),
        "auc": float(auc),
        "brier": float(((p - y) ** 2).mean()),
        "log_loss": loss,
        "score": 0.6 * float(auc) + 0.4 * max(0.0, (math.log(2) - loss) / math.log(2)),
    }


def conviction(score: float, std: float, edge: float | None) -> float:
    """How much of the distance from one half stays: from the score, its spread over folds, and the edge."""
    hold = lambda v: max(0.0, min(1.0, v))
    s = 0.55 * hold((score - 0.5) / 0.06) + 0.45 * (hold(edge / 0.03) if edge is not None else 0.0)
    if score > 0.58 and std < 0.10:
        s = max(s, 0.95)
    elif score > 0.62:
        s = max(s, 0.90 if score > 0.68 else 0.75)
    if std > 0:
        s *= max(0.2, 1 - min(0.7, 3 * std))
    return hold(s)


_COMBINED = [
    "probability", "raw_probability", "cv_score", "cv_std", "folds", "accuracy", "balanced_accuracy", "auc", "brier", "log_loss", "scaler",
    "calibrated", "capped", "confidence", "top", "note",
]
_COMBINED_SCHEMA = "symbol string, probability double, raw_probability double, cv_score double, cv_std double, folds int, accuracy double, balanced_accuracy double, auc double, brier double, log_loss double, scaler double, calibrated boolean, capped boolean, confidence double, top string, note string"


def combine(rows: pd.DataFrame) -> dict:
    """One symbol's folds to its probability: blend by confidence, Platt curve or damper, conviction, cap."""
    final = rows[rows["fold"] == 0].set_index("kind")
    out = dict.fromkeys(_COMBINED) | {"folds": 0, "calibrated": False, "capped": False, "top": "", "note": ""}
    if "trees" not in final.index:
        return out | {"probability": float(final["prob"].iloc[0]), "raw_probability": float(final["prob"].iloc[0]), "note": final.index[0]}
    oos = rows[rows["fold"] > 0]
    marks = [fold_score(g["prob"].to_numpy(), g["target"].to_numpy()) for _, g in oos.groupby("fold")]
    scores = [m["score"] for m in marks]
    score, std = (float(np.mean(scores)), float(np.std(scores, ddof=1)) if len(scores) > 1 else 0.0) if scores else (0.5, 0.0)
    mean = {k: float(np.mean([m[k] for m in marks])) if marks else None for k in ("accuracy", "balanced_accuracy", "auc", "brier", "log_loss")}
    edge = max(0.0, (math.log(2) - mean["log_loss"]) / math.log(2)) if marks else None
    legs = [(float(final.loc["trees", "prob"]), score if score > 0 else 0.06)]
    hits = None
    if "logistic" in final.index:
        hits = float(final.loc["logistic", "target"]) if pd.notna(final.loc["logistic", "target"]) else None
        legs.append((float(final.loc["logistic", "prob"]), hits if hits else 0.03))
    raw = float(np.clip(sum(p * w for p, w in legs) / sum(w for _, w in legs), 0, 1))
    calibrated = len(oos) >= CALIBRATION_ROWS and oos["target"].nunique() == 2
    if calibrated:
        b = logistic(oos[["prob"]].to_numpy(), oos["target"].to_numpy(), ridge=0.5)
        p = float(1 / (1 + np.exp(-(b[0] * np.clip(raw, 1e-4, 1 - 1e-4) + b[1]))))
    else:
        p = 0.5 + (raw - 0.5) / 2
    scaler = conviction(score, std, edge)
    p = 0.5 + (p - 0.5) * scaler
    capped = std > 0.07 or edge is None or edge < 0.01
    if capped:
        p = 0.5 + float(np.clip(p - 0.5, -0.02, 0.02))
    note = "" if len(scores) >= 3 else "fewer than three valid folds"
    made = {"probability": p, "raw_probability": raw, "cv_score": score, "cv_std": std, "folds": len(scores), "scaler": scaler, "calibrated": bool(calibrated)}
    return out | mean | made | {"capped": bool(capped), "confidence": hits, "top": final.loc["trees", "note"], "note": note}


def signal(frame: DataFrame, features: list[str], horizon: int = 21, folds: int = FOLDS, rounds: int = ROUNDS) -> DataFrame:
    """The model of every symbol of a factor frame (symbol, date, features, target): a task a fold, then one row a symbol."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        made = fit_fold(rows, int(key[1]), features, horizon, folds, rounds)
        return pd.DataFrame([(key[0], int(key[1]), *m) for m in made], columns=["symbol", "fold", "kind", "prob", "target", "note"])

    def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"symbol": key[0]} | combine(rows)])[["symbol", *_COMBINED]]

    n = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = frame.select("symbol", "date", "target", *features, F.explode(F.sequence(F.lit(0), F.lit(folds))).alias("fold"))
    fitted = dealt.repartition(8 * n, "symbol", "fold").groupBy("symbol", "fold").applyInPandas(fit, _FITTED)
    return fitted.groupBy("symbol").applyInPandas(joined, _COMBINED_SCHEMA)
