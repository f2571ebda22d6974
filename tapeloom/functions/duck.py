"""The same row-frame expressions as SQL text, for the queries that check them."""

from __future__ import annotations

import math

OVER = "PARTITION BY symbol ORDER BY date"


def w(n: int | None = None) -> str:
    return f"({OVER} ROWS BETWEEN {'UNBOUNDED' if n is None else n - 1} PRECEDING AND CURRENT ROW)"


def roll(f: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} >= {least or n} THEN {f}({x}) OVER {w(n)} END"


def mean(x, n, least=None):
    return roll("avg", x, n, least)


def std(x, n, least=None):
    return roll("stddev_samp", x, n, max(2, least or n))


def clamp(x: str, low, high) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN least(greatest({x}, {low}), {high}) END"


def zscore(x: str, n: int = 60) -> str:
    least = max(10, n // 2)
    s = f"({std(x, n, least)})"
    z = f"({x} - ({mean(x, n, least)})) / (CASE WHEN {s} = 0 THEN 1.0 ELSE {s} END)"
    return f"coalesce({clamp(z, -4.0, 4.0)}, 0.0)"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({OVER})"


def log_return(p="close") -> str:
    return f"ln({p} / {lag(p)})"


def change(x: str, k: int = 1) -> str:
    return f"{x} / nullif({lag(x, k)}, 0) - 1"


def ffill(x: str) -> str:
    return f"last_value({x} IGNORE NULLS) OVER {w()}"


def bfill(x: str) -> str:
    return f"first_value({x} IGNORE NULLS) OVER ({OVER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def ewm(x: str, alpha: float) -> str:
    depth = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    fold = f"list_reduce(list_filter(list({x}) OVER {w(depth)}, lambda v: v IS NOT NULL), lambda acc, v: acc * {1 - alpha!r} + v * {alpha!r})"
    return f"CASE WHEN count({x}) OVER {w(depth)} > 0 THEN {fold} END"


def pair(f: str, x: str, y: str, n: int) -> str:
    return f"CASE WHEN count(CASE WHEN {y} IS NOT NULL THEN {x} END) OVER {w(n)} >= {n} THEN {f}({x}, {y}) OVER {w(n)} END"


def beta(x: str, y: str, n: int) -> str:
    y2 = f"CASE WHEN {x} IS NOT NULL THEN {y} END"
    return f"({pair('covar_samp', x, y, n)}) / nullif({roll('var_samp', y2, n)}, 0)"
