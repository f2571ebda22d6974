"""Window work whose cost a row does not grow with the frame: sliding moments, decayed sums, keyed fills, and chunks with a halo.

All take bars of many symbols (or any other key), ordered by date within a symbol. What is added goes by the names given; helper
columns begin and mostly end with an underscore (`_block_`, `_head_...`) and are dropped, so no column should be named like that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.functions.windows import clamp
from tapeloom.sources.shared import cut

START = Window.unboundedPreceding


def _numbered(df: DataFrame, by: str, at: str) -> DataFrame:
    return df.withColumn("_row_", F.row_number().over(Window.partitionBy(by).orderBy(at)) - 1)


def _merge(a: Column, b: Column, names: list[str]) -> Column:
    """Two sets of moments as one: n, and for each value mean m_ and sum of squares s_, for each pair of values co-moment c_."""
    n = a["n"] + b["n"]
    part, both = b["n"] / n, a["n"] * b["n"] / n
    out = {"n": n}
    step = {v[2:]: b[v] - a[v] for v in names if v.startswith("m_")}
    for v in names:
        kind, rest = v[0], v[2:]
        if kind == "m":
            out[v] = a[v] + step[rest] * part
        elif kind == "s":
            out[v] = a[v] + b[v] + step[rest] * step[rest] * both
        elif kind == "c":
            out[v] = a[v] + b[v] + step["x"] * step["y"] * both
        else:
            out[v] = (F.least if kind == "l" else F.greatest)(a[v], b[v])
    merged = F.struct(*[out[v].alias(v) for v in ["n", *names]])
    return F.when(b.isNull() | (F.coalesce(b["n"], F.lit(0)) == 0), a).when(F.coalesce(a["n"], F.lit(0)) == 0, b).otherwise(merged)


def _moments(w, x, y=None, extremes: bool = False) -> dict[str, Column]:
    """n, mean and sum of squares of x over a window; with y, of both and their co-moment; with extremes, least and greatest x.

    The mean of equal values is that value, not a rounded sum over a count, so that equal values have no deviation at all."""
    k = F.count(x).over(w)
    out = {"n": k}
    for name, v in (("x", x), ("y", y)) if y is not None else (("x", x),):
        var = F.var_pop(v).over(w)
        out |= {f"m_{name}": F.when(var == 0, F.first(v, ignorenulls=True).over(w)).otherwise(F.avg(v).over(w)), f"s_{name}": var * k}
    if extremes:
        out |= {"l_x": F.min(x).over(w), "g_x": F.max(x).over(w)}
    return out if y is None else out | {"c_x": F.covar_pop(x, y).over(w) * k}


def slide(df: DataFrame, n: int, values: tuple[str, ...] = (), pairs: tuple[tuple[str, str], ...] = (), extremes: bool = False, by: str = "symbol", at: str = "date") -> DataFrame:
    """df with moments of the last n (at least 2) rows: structs `<value>_<n>` (n, m_x, s_x; with extremes l_x and g_x too), and
    `<x>_<y>_<n>` (m_y, s_y and c_x besides) over rows with both values.

    Rows are cut into blocks of n. A frame is the end of one block and the beginning of the next, so two passes over each block,
    one from either side, and one merge a row give it. Nothing is subtracted, so no digits are lost in long sums. Missing values
    are left out.
    """
    x = _numbered(df, by, at).withColumn("_block_", F.floor(F.col("_row_") / n))
    block = Window.partitionBy(by, "_block_")
    ends, names = {}, {}
    for end, order in (("head", "_row_"), ("tail", F.desc("_row_"))):
        w = block.orderBy(order).rowsBetween(START, 0)
        own = {f"{v}_{n}": _moments(w, F.col(v), extremes=extremes) for v in values}
        own |= {f"{a}_{b}_{n}": _moments(w, F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))) for a, b in pairs}
        names = {k: [m for m in moments if m != "n"] for k, moments in own.items()}
        ends[end] = {f"_{end}_{k}": F.struct(*[c.alias(m) for m, c in moments.items()]) for k, moments in own.items()}
    x = x.withColumns(ends["head"]).withColumns(ends["tail"])
    order = Window.partitionBy(by).orderBy(at)
    x = x.withColumns({f"_tail_{k}": F.lag(f"_tail_{k}", n - 1).over(order) for k in names})
    partial = F.col("_row_") % n < n - 1  # the last row of a block has all of it and nothing of the one before
    x = x.withColumns({k: _merge(F.col(f"_head_{k}"), F.when(partial, F.col(f"_tail_{k}")), own) for k, own in names.items()})
    return x.drop("_row_", "_block_", *ends["head"], *ends["tail"])


def mean_of(m: str, least: int) -> Column:
    return F.when(F.col(m)["n"] >= least, F.col(m)["m_x"])


def std_of(m: str, least: int) -> Column:
    return F.when(F.col(m)["n"] >= max(2, least), F.sqrt(F.col(m)["s_x"] / (F.col(m)["n"] - 1)))


def beta_of(m: str, least: int) -> Column:
    """Slope of the first value on the second; missing where that does not vary."""
    return F.when(F.col(m)["n"] >= least, F.col(m)["c_x"] / F.nullif(F.col(m)["s_y"], F.lit(0.0)))


def corr_of(m: str, least: int) -> Column:
    """Correlation; missing where a value does not vary."""
    spread = F.sqrt(F.col(m)["s_x"]) * F.sqrt(F.col(m)["s_y"])
    return F.when(F.col(m)["n"] >= least, F.col(m)["c_x"] / F.nullif(spread, F.lit(0.0)))


def zscore_of(value: str, n: int) -> Column:
    """As windows.zscore, from the moments `<value>_<n>`."""
    m, least = f"{value}_{n}", max(10, n // 2)
    s = std_of(m, least)
    z = (F.col(value) - mean_of(m, least)) / F.when(s == 0, F.lit(1.0)).otherwise(s)
    return F.coalesce(clamp(z, -4.0, 4.0), F.lit(0.0))


def zscores(df: DataFrame, made: dict[str, tuple[str, int]], by: str = "symbol", at: str = "date") -> DataFrame:
    """df with z-scores: {name: (value, rows)}."""
    for n in sorted({n for _, n in made.values()}):
        own = tuple(dict.fromkeys(v for v, k in made.values() if k == n))
        df = slide(df, n, own, by=by, at=at)
        df = df.withColumns({name: zscore_of(v, n) for name, (v, k) in made.items() if k == n}).drop(*[f"{v}_{n}" for v in own])
    return df


#: What is left of a value after a block of a decayed sum.
FORGOTTEN = 1e-17


def decayed(df: DataFrame, made: dict[str, str], decay: float, first: float = 1.0, start: str | None = None, by: str = "symbol", at: str = "date") -> DataFrame:
    """df with decayed sums {name: value}: s = decay x s + value along each symbol, missing values skipped.

    A symbol's first value counts `first` times; `start` names a column (the same in all rows of a symbol) from which sums begin.
    Values are dealt in blocks so long that FORGOTTEN is left of what stood a block before. Inside a block the sum is a running
    sum of values scaled by decay ** -place; the block before adds its last sum, decayed. Blocks before that are forgotten.
    The values of one call must be missing in the same rows.
    """
    size = math.ceil(math.log(FORGOTTEN) / math.log(decay))
    lead = next(iter(made.values()))
    order = Window.partitionBy(by).orderBy(at)
    past = order.rowsBetween(START, 0)
    x = df.withColumn("_count_", F.count(lead).over(past) - 1)
    x = x.withColumns({"_block_": F.floor(F.col("_count_") / size), "_place_": F.col("_count_") % size})
    inside = Window.partitionBy(by, "_block_").orderBy(at).rowsBetween(START, 0)
    known = F.col(lead).isNotNull()
    scaled = {f"_s_{name}": F.sum(F.when(F.col("_count_") == 0, F.col(v) * first).otherwise(F.col(v)) * F.pow(F.lit(decay), -F.col("_place_").cast("double"))).over(inside) for name, v in made.items()}
    x = x.withColumns(scaled).withColumns({f"_s_{name}": F.when(known, F.col(f"_s_{name}") * F.pow(F.lit(decay), F.col("_place_").cast("double"))) for name in made})
    before = order.rowsBetween(START, -1)
    x = x.withColumns({f"_c_{name}": F.last(F.when(F.col("_place_") == size - 1, F.col(f"_s_{name}")), ignorenulls=True).over(before) for name in made})
    total = {name: F.col(f"_s_{name}") + F.coalesce(F.col(f"_c_{name}") * F.pow(F.lit(decay), F.col("_place_") + 1.0), F.lit(0.0)) for name in made}
    if start:
        total = {name: t + F.col(start) * F.pow(F.lit(decay), F.col("_count_") + 1.0) for name, t in total.items()}
    x = x.withColumns({name: F.when(known, t) for name, t in total.items()})
    x = x.withColumns({name: F.last(name, ignorenulls=True).over(past) for name in made})
    return x.drop("_count_", "_block_", "_place_", *[f"_{e}_{name}" for name in made for e in "sc"])


def ewm(df: DataFrame, made: dict[str, str], alpha: float, by: str = "symbol", at: str = "date") -> DataFrame:
    """df with recursive exponential means {name: value}; the first value is the start."""
    x = decayed(df, made, 1 - alpha, 1 / alpha, by=by, at=at)
    return x.withColumns({name: F.col(name) * alpha for name in made})


def fill_forward(df: DataFrame, by: list[str], order: list[str], columns: list[str], partitions: int | None = None) -> DataFrame:
    """df with missing values of `columns` replaced by the last ones before them in the order, for each key.

    Rows are dealt in ranges of (key, order), so a key with very many rows is spread over tasks. Each range is filled by itself;
    then the last values of the ranges before, a row for each key and range, are carried into it.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = by or ["_all"]
    x = df if by else df.withColumn("_all", F.lit(0))
    x = cut(x.repartitionByRange(n, *keys, *order).withColumn("_part_", F.spark_partition_id()), "ranges")
    own = Window.partitionBy(*keys, "_part_").orderBy(*order)
    place = F.struct(*order)
    ends = x.groupBy(*keys, "_part_").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"_end_{c}") for c in columns])
    before = Window.partitionBy(*keys).orderBy("_part_").rowsBetween(START, -1)
    carry = ends.select(*keys, "_part_", *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_end_{c}") for c in columns])
    x = x.withColumns({c: F.last(c, ignorenulls=True).over(own.rowsBetween(START, 0)) for c in columns})
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "_part_")]
    joined = x.alias("x").join(carry.alias("c"), same, "left")
    return joined.select(*[F.coalesce(F.col(f"x.{c}"), F.col(f"c._end_{c}")).alias(c) if c in columns else F.col(f"x.{c}") for c in df.columns])


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str], tolerance: int | None = None, partitions: int | None = None) -> DataFrame:
    """left with the values of the last row of right with the same key at or before its time, at most `tolerance` days older.

    Of right rows with one key and time the one with the greatest values counts; a row of right counts even where its values are
    missing. Left rows whose key or time is missing get nothing. Left columns may have any names but those of the values.
    """
    kept = [c for c in left.columns]
    found = F.struct(F.col(at).alias("_at"), *values)
    r = right.where(F.col(at).isNotNull()).select(*by, at, F.lit(0).alias("_side"), found.alias("_found"), F.lit(None).cast(left.select(F.struct(*kept)).schema[0].dataType).alias("_row"))
    none = F.lit(None).cast(r.schema["_found"].dataType)
    x = left.select(*by, at, F.lit(1).alias("_side"), none.alias("_found"), F.struct(*kept).alias("_row"))
    x = fill_forward(r.unionByName(x).withColumn("_tie", F.col("_found")), by, [at, "_side", "_tie"], ["_found"], partitions).where("_side = 1")
    known = F.lit(True)
    for c in (*by, at):
        known = known & F.col(c).isNotNull()
    if tolerance is not None:
        known = known & (F.datediff(F.col(at), F.col("_found._at")) <= tolerance)
    return x.select("_row.*", *[F.when(known, F.col(f"_found.{v}")).alias(v) for v in values])


def by_chunks(df: DataFrame, run: Callable[[pd.DataFrame, int, int], pd.DataFrame], schema: str, before: int = 0, after: int = 0, rows: int = 4096, by: str = "symbol", at: str = "date") -> DataFrame:
    """run over chunks of a symbol's rows in order, each with up to `before` and `after` rows of its neighbours.

    run gets the rows, and from which to which of them the chunk itself goes; its answer is for those. A long symbol is many
    tasks, and a task holds one chunk.
    """
    x = _numbered(df, by, at)
    chunk, last = F.floor(F.col("_row_") / rows), F.floor((F.count("*").over(Window.partitionBy(by)) - 1) / rows)
    low, high = F.floor((F.col("_row_") - after) / rows), F.floor((F.col("_row_") + before) / rows)  # chunks of which the row is a neighbour
    x = x.withColumns({"_home_": chunk, "_low_": F.greatest(low, F.lit(0)), "_high_": F.least(high, last)})
    x = x.withColumn("_chunk_", F.explode(F.sequence("_low_", "_high_"))).drop("_low_", "_high_")

    def each(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_row_", kind="stable", ignore_index=True)
        own = np.flatnonzero((part["_home_"] == part["_chunk_"]).to_numpy())
        return run(part.drop(columns=["_row_", "_home_", "_chunk_"]), int(own[0]), int(own[-1]) + 1)

    return x.groupBy(by, "_chunk_").applyInPandas(each, schema)


class RankTree:
    """A Fenwick tree that counts values by rank: how many lie at or below one, and which is the k-th."""

    def __init__(self, n: int):
        self.count, self.top = [0] * (n + 1), 1 << max(n, 1).bit_length() - 1

    def add(self, rank: int, k: int) -> None:
        at = rank + 1
        while at < len(self.count):
            self.count[at] += k
            at += at & -at

    def upto(self, rank: int) -> int:
        at, out = rank + 1, 0
        while at:
            out += self.count[at]
            at -= at & -at
        return out

    def nth(self, k: int) -> int:
        """Rank of the k-th smallest value, from 0."""
        at, step = 0, self.top
        while step:
            if at + step < len(self.count) and self.count[at + step] <= k:
                at += step
                k -= self.count[at]
            step >>= 1
        return at


def _ranked(n: int, least: int, value: str, name: str, of: Callable, keep: list[str]):
    def run(part: pd.DataFrame, start: int, stop: int) -> pd.DataFrame:
        x = part[value].to_numpy(float)
        known = ~np.isnan(x)
        order, rank = np.unique(x[known], return_inverse=True)
        ranks = np.full(len(x), -1)
        ranks[known] = rank
        tree, held, out = RankTree(len(order)), 0, np.full(len(x), np.nan)
        for i, r in enumerate(ranks.tolist()):
            if r >= 0:
                tree.add(r, 1)
                held += 1
            gone = int(ranks[i - n]) if i >= n else -1
            if gone >= 0:
                tree.add(gone, -1)
                held -= 1
            if i >= start and held >= least:
                out[i] = of(tree, order, r, held)
        return part[keep].assign(**{name: out}).iloc[start:stop]

    return run


def rolling_rank(df: DataFrame, value: str, n: int, least: int, name: str, keep: list[str], rows: int = 4096) -> DataFrame:
    """(keep, name): share of the last n rows' values at or below the present one, missing until `least` are there or without one."""

    def share(tree, order, r, held):
        return tree.upto(r) / held if r >= 0 else np.nan

    return _by_rank(df, value, n, least, name, keep, share, rows)


def rolling_quantile(df: DataFrame, value: str, n: int, p: float, name: str, keep: list[str], least: int | None = None, rows: int = 4096) -> DataFrame:
    """(keep, name): the interpolated quantile of the last n rows' values."""

    def quantile(tree, order, r, held):
        at = p * (held - 1)
        low = int(at)
        a = order[tree.nth(low)]
        return a if at == low else a + (order[tree.nth(low + 1)] - a) * (at - low)

    return _by_rank(df, value, n, least or n, name, keep, quantile, rows)


def _by_rank(df, value, n, least, name, keep, of, rows):
    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + f", {name} double"
    cols = list(dict.fromkeys(["symbol", "date", value, *keep]))
    out = by_chunks(df.select(*cols), _ranked(n, least, value, name, of, keep), schema, before=n, rows=rows)
    return out.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def first_touch(df: DataFrame, value: str, high: str, low: str, horizon: int, name: str, keep: list[str], rows: int = 4096) -> DataFrame:
    """(keep, name): 1 where the value reaches `high` first within the next rows, 0 where it reaches `low` first, else missing.

    Each chunk has greatest and least values of the next 1, 2, 4 ... rows (doubling), and goes down them to the first touch of
    every row at once; so a row costs the logarithm of the horizon.
    """

    def touch(x: np.ndarray, level: np.ndarray, worst: float, best) -> np.ndarray:
        """Rows until x meets the level (over the horizon if it does not): best is np.maximum for highs, np.minimum for lows."""
        tables = [np.append(x, worst)]
        while 2 ** len(tables) <= horizon:
            t, k = tables[-1], 2 ** (len(tables) - 1)
            tables.append(best(t, np.append(t[k:], np.full(min(k, len(t)), worst))))
        sign = 1 if best is np.maximum else -1
        at = np.arange(len(x)) + 1
        end = at + horizon
        for j in range(len(tables) - 1, -1, -1):
            seen = tables[j][np.minimum(at, len(x))]
            at = np.where((at + 2**j <= end) & ~(sign * seen >= sign * level), at + 2**j, at)
        hit = (at < end) & (at < len(x))
        hit[hit] = (sign * x[at[hit]] >= sign * level[hit])
        return np.where(hit, at - np.arange(len(x)), horizon + 1)

    def run(part: pd.DataFrame, start: int, stop: int) -> pd.DataFrame:
        x, hi, lo = (part[c].to_numpy(float) for c in (value, high, low))
        up = touch(np.where(np.isnan(x), -np.inf, x), np.where(np.isnan(hi), np.inf, hi), -np.inf, np.maximum)
        down = touch(np.where(np.isnan(x), np.inf, x), np.where(np.isnan(lo), -np.inf, lo), np.inf, np.minimum)
        out = np.where((up <= horizon) & (up < down), 1.0, np.where(down <= horizon, 0.0, np.nan))
        return part[keep].assign(**{name: out}).iloc[start:stop]

    types = dict(df.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + f", {name} double"
    cols = list(dict.fromkeys(["symbol", "date", value, high, low, *keep]))
    out = by_chunks(df.select(*cols), run, schema, after=horizon, rows=rows)
    return out.withColumn(name, F.nanvl(name, F.lit(None).cast("double")))
