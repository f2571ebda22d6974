"""Row-frame expressions over bars: min-period guards, z-scores, exponential means, fills and ranks.

NULL is missing. Every frame is a row frame over one window spec, (symbol; date), so that one shuffle and one sort by
symbol serve all of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, Window, functions as F


def __getattr__(name: str):
    """BY (symbol), W (symbol; date) and PAST (all rows up to this one), made when asked for: they need a session."""
    if name == "BY":
        return Window.partitionBy("symbol")
    if name == "W":
        return Window.partitionBy("symbol").orderBy("date")
    if name == "PAST":
        return Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    raise AttributeError(name)


def ordered():
    return Window.partitionBy("symbol").orderBy("date")


def frame(n: int):
    return ordered().rowsBetween(-(n - 1), 0)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def roll(f, x, n: int, least: int | None = None) -> Column:
    """f over the last n rows, NULL until `least` (n) of them have a value."""
    x = _c(x)
    return F.when(F.count(x).over(frame(n)) >= (least or n), f(x).over(frame(n)))


def mean(x, n: int, least: int | None = None) -> Column:
    return roll(F.avg, x, n, least)


def std(x, n: int, least: int | None = None) -> Column:
    return roll(F.stddev_samp, x, n, max(2, least or n))


def clamp(x: Column, low: float, high: float) -> Column:
    """x between low and high; NULL stays NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def zscore(x, n: int = 60) -> Column:
    """Distance from the rolling mean in rolling deviations, within 4; deviation 0 counts as 1, missing as 0."""
    x = _c(x)
    least = max(10, n // 2)
    s = std(x, n, least)
    z = (x - mean(x, n, least)) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return F.coalesce(clamp(z, -4.0, 4.0), F.lit(0.0))


def log_return(p="close") -> Column:
    return F.ln(_c(p) / F.lag(_c(p)).over(ordered()))


def change(x, k: int = 1) -> Column:
    """x over its value k rows ago, less 1."""
    return ratio(_c(x), F.lag(_c(x), k).over(ordered())) - 1


def ffill(x) -> Column:
    return F.last(_c(x), ignorenulls=True).over(ordered().rowsBetween(Window.unboundedPreceding, 0))


def bfill(x) -> Column:
    return F.first(_c(x), ignorenulls=True).over(ordered().rowsBetween(0, Window.unboundedFollowing))


def ewm(x, alpha: float) -> Column:
    """Recursive exponential mean (first value as start), folded over the rows whose weight is above 1e-17."""
    depth = math.ceil(math.log(1e-17) / math.log(1 - alpha))
    return F.aggregate(
        F.filter(F.collect_list(_c(x)).over(frame(depth)), lambda v: v.isNotNull()),
        F.lit(None).cast("double"),
        lambda acc, v: F.when(acc.isNull(), v).otherwise(acc * (1 - alpha) + v * alpha),
    )


def skewness(x, n: int) -> Column:
    """Bias-corrected skewness of the last n rows."""
    g = roll(F.skewness, x, n)
    return g * math.sqrt(n * (n - 1)) / (n - 2)


def kurtosis(x, n: int) -> Column:
    """Bias-corrected excess kurtosis of the last n rows."""
    g = roll(F.kurtosis, x, n)
    return (g * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3)))


def pair(f, x, y, n: int) -> Column:
    """Two-argument aggregate (covariance, correlation) of the last n rows, NULL until all have both values."""
    x, y = _c(x), _c(y)
    return F.when(F.count(F.when(y.isNotNull(), x)).over(frame(n)) >= n, f(x, y).over(frame(n)))


def beta(x, y, n: int) -> Column:
    y2 = F.when(_c(x).isNotNull(), _c(y))
    return ratio(pair(F.covar_samp, x, y, n), roll(F.var_samp, y2, n))
