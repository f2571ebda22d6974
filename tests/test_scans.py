"""Windows of constant cost, keyed fills and chunks with a halo against pandas and plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scans
from tapeloom.plans import features, sectors
from tapeloom.sources.bars import bars_orders, macro_yearly

DATES = pd.date_range("2000-01-01", periods=2000)


@pytest.fixture(scope="module")
def walk():
    """Symbols of 1 to 700 rows: gaps, a constant stretch, large levels, ties."""
    rng = np.random.default_rng(8)
    parts = []
    for k, n in enumerate((700, 333, 40, 7, 1)):
        x = np.round(1e6 + np.cumsum(rng.normal(0, 3, n)), 1)
        x[n // 3 : n // 2] = x[n // 3]
        x[rng.random(n) < 0.1] = np.nan
        y = rng.normal(size=n)
        y[rng.random(n) < 0.05] = np.nan
        parts.append(pd.DataFrame({"symbol": f"s{k}", "date": DATES[:n].date, "x": x, "y": y}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def rows(spark, walk):
    x = spark.createDataFrame(walk)
    return x.select("symbol", "date", *[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in "xy"])


def ordered(df):
    return df.toPandas().sort_values(["symbol", "date"], ignore_index=True)


def by_symbol(walk, f):
    return pd.concat([f(g) for _, g in walk.groupby("symbol")])


@pytest.mark.parametrize("n", [2, 7, 60, 1000])
def test_sliding_moments(rows, walk, n):
    x = scans.slide(rows, n, ("x",), (("x", "y"),), extremes=True)
    x = x.select("symbol", "date", scans.mean_of(f"x_{n}", 2).alias("m"), scans.std_of(f"x_{n}", 2).alias("s"), scans.corr_of(f"x_y_{n}", 3).alias("c"), scans.beta_of(f"x_y_{n}", 3).alias("b"), F.col(f"x_{n}.l_x").alias("lo"), F.col(f"x_{n}.g_x").alias("hi"))
    got = ordered(x)

    def exact(g):
        out = []
        for i in range(len(g)):
            f = g.iloc[max(0, i - n + 1) : i + 1]
            v, p = f["x"].dropna().to_numpy(), f.dropna()
            cov = np.cov(p["x"], p["y"]) if len(p) >= 3 else np.full((2, 2), np.nan)
            with np.errstate(all="ignore"):
                out.append((v.mean() if len(v) > 1 else np.nan, v.std(ddof=1) if len(v) > 1 else np.nan, cov[0, 1] / math.sqrt(cov[0, 0] * cov[1, 1]) if p["x"].nunique() > 1 else np.nan, cov[0, 1] / cov[1, 1], v.min() if len(v) else np.nan, v.max() if len(v) else np.nan))
        return pd.DataFrame(out, columns=["m", "s", "c", "b", "lo", "hi"])

    want = by_symbol(walk, exact)
    for c in want:
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
    flat = ((want["lo"] == want["hi"]) & want["s"].notna()).to_numpy()
    assert (got["s"].to_numpy()[flat] == 0).all()  # no rest is left in a constant frame
    assert flat.any() == (n <= 60)


@pytest.mark.parametrize("alpha", [0.5, 0.07, 2 / 15])
def test_recursive_means(rows, walk, alpha):
    got = ordered(scans.ewm(rows, {"e": "x"}, alpha))["e"]
    want = by_symbol(walk, lambda g: g["x"].ewm(alpha=alpha, adjust=False, ignore_na=True).mean())
    assert np.allclose(got, want, rtol=1e-12, equal_nan=True)


def test_decayed_sums_from_a_start(rows, walk):
    got = ordered(scans.decayed(rows.withColumn("seed", F.lit(5.0)), {"v": "y"}, 0.9, start="seed"))["v"]

    def fold(g):
        s, out = 5.0, []
        for v in g["y"]:
            s = s if math.isnan(v) else 0.9 * s + v
            out.append(s)
        return pd.Series(out)

    want = by_symbol(walk, fold).to_numpy()
    known = by_symbol(walk, lambda g: g["y"].notna().cumsum() > 0).to_numpy()
    assert np.allclose(got[known], want[known]) and got[~known].isna().all()


@pytest.mark.parametrize("chunk", [4096, 33])
def test_rolling_ranks_and_quantiles(rows, walk, chunk):
    got = ordered(scans.rolling_rank(rows, "x", 20, 5, "r", ["symbol", "date"], rows=chunk))["r"]
    quant = ordered(scans.rolling_quantile(rows, "x", 20, 0.7, "q", ["symbol", "date"], least=10, rows=chunk))["q"]

    def exact(g):
        out = []
        for i in range(len(g)):
            f = g["x"].iloc[max(0, i - 19) : i + 1]
            v, now = f.dropna().to_numpy(), g["x"].iloc[i]
            out.append((np.nan if len(v) < 5 or math.isnan(now) else (v <= now).mean(), np.quantile(v, 0.7) if len(v) >= 10 else np.nan))
        return pd.DataFrame(out)

    want = by_symbol(walk, exact)
    assert np.allclose(got, want[0], equal_nan=True) and np.allclose(quant, want[1], equal_nan=True)


@pytest.mark.parametrize(("horizon", "chunk"), [(1, 4096), (5, 17), (21, 40), (250, 100)])
def test_first_touch(rows, walk, horizon, chunk):
    x = rows.withColumns({"hi": F.col("x") + 4, "lo": F.when(F.col("y") < 2, F.col("x") - 3)})
    got = ordered(scans.first_touch(x, "x", "hi", "lo", horizon, "t", ["symbol", "date"], rows=chunk))["t"]

    def exact(g):
        x, y, out = g["x"].to_numpy(), g["y"].to_numpy(), []
        for i in range(len(x)):
            hi, lo, t = x[i] + 4, x[i] - 3 if y[i] < 2 else np.nan, np.nan
            for v in x[i + 1 : i + 1 + horizon]:
                if v >= hi or v <= lo:
                    t = float(v >= hi)
                    break
            out.append(t)
        return pd.Series(out)

    assert np.array_equal(got, by_symbol(walk, exact), equal_nan=True)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_as_of_with_a_hot_key(spark, partitions):
    """One key has most rows and spans ranges; ties, gaps, missing keys, times and values; a tolerance."""
    r = random.Random(4)
    key = lambda: r.choice(["hot"] * 8 + ["a", "b", None])
    day = lambda: r.choice([None, *DATES[:300].date]) if r.random() < 0.03 else DATES[r.randrange(300)].date()
    right = [(key(), day(), r.choice([None, 1.0, 2.0, 3.0]), "name") for _ in range(400)]
    left = [(i, key(), day(), "x") for i in range(900)] + [(900, "nobody", DATES[5].date(), "x")]
    l = spark.createDataFrame(left, "id long, k string, d date, value string").repartition(3)
    rt = spark.createDataFrame(right, "k string, d date, price double, id string").repartition(3)
    for tolerance in (None, 2):
        got = {x.id: x.price for x in scans.as_of(l, rt, ["k"], "d", ["price"], tolerance, partitions).collect()}
        assert len(got) == len(left)
        for i, k, d, _ in left:
            own = [(b, p is not None, p or 0) for a, b, p, _ in right if a == k and k is not None and b is not None and d is not None and b <= d]
            best = max(own, default=None)
            want = None if best is None or tolerance is not None and (d - best[0]).days > tolerance or not best[1] else best[2]
            assert got[i] == want, (i, k, d)


def test_no_single_task_in_the_fills(spark):
    bars, macro = bars_orders(spark, "/root/testdata/sf0.001"), macro_yearly(spark, "/root/testdata/sf0.001")
    out = sectors.as_of(bars, macro)
    assert "SinglePartition" not in plan(out)
    filled = scans.fill_forward(bars.groupBy("date").agg(F.max("close").alias("c")), [], ["date"], ["c"])
    assert "SinglePartition" not in plan(filled)


def test_barriers_hold_no_arrays(spark):
    p = plan(features.triple_barrier(bars_orders(spark, "/root/testdata/sf0.001"), 250))
    assert "collect_list" not in p and "array" not in p.lower().replace("arrayofdoubles", "")


def test_fractional_differences_of_own_orders(spark, rows, walk):
    x = rows.where("symbol IN ('s0', 's1', 's2', 's4')").select("symbol", "date", F.coalesce("x", F.lit(1e6)).alias("lp"))
    orders = spark.createDataFrame([("s0", 0.5), ("s1", 0.0), ("s2", 0.9), ("s4", None)], "symbol string, d double")
    got = features.fractional_own(x, orders, least=1e-2).toPandas().sort_values(["symbol", "date"], ignore_index=True)
    for s, d in (("s0", 0.5), ("s1", 0.0), ("s2", 0.9)):
        own = got[got["symbol"] == s]
        k = np.array(features.ffd_weights(d, 1e-2))
        v = own["lp"].to_numpy()
        want = [np.nan if i + 1 < len(k) else float(v[i - len(k) + 1 : i + 1][::-1] @ k) for i in range(len(v))]
        assert np.allclose(own["frac_diff"], want, equal_nan=True)
    assert got[got["symbol"] == "s4"]["frac_diff"].isna().all()
