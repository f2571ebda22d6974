"""Operators that SQL cannot check: plain re-statements, invariants, connectors and the entry without the llm part."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import broker, models, montecarlo, optimize, signal
from tapeloom.plans import features, sectors, trading
from tapeloom.sources import connectors

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(11)
    n = 420
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    return pd.DataFrame({"symbol": "A", "sector": "S", "date": pd.date_range("2020-01-05", periods=n).date, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": 1000.0 + rng.integers(0, 50, n)})


@pytest.fixture(scope="module")
def bars(spark, walk):
    return spark.createDataFrame(walk)


def by_date(df, col):
    return np.array([np.nan if r[col] is None else float(r[col]) for r in df.orderBy("date").select(col).collect()])


def test_rsi_and_atr_against_pandas(bars, walk):
    step = walk["close"].diff()
    gain, loss = (s.ewm(alpha=1 / 14, adjust=False).mean() for s in (step.clip(lower=0), (-step).clip(lower=0)))
    want = (100 - 100 / (1 + gain / loss.replace(0, np.nan))).fillna(50)
    assert np.allclose(by_date(features.rsi(bars), "rsi"), want)
    prev = walk["close"].shift()
    tr = pd.concat([walk["high"] - walk["low"], (walk["high"] - prev).abs(), (walk["low"] - prev).abs()], axis=1).max(axis=1)
    assert np.allclose(by_date(features.atr(bars), "atr"), tr.ewm(span=14, adjust=False).mean())


def test_rsi_without_losses_is_fifty(spark):
    up = spark.createDataFrame([("A", d.date(), 1.0 + i, 1.0 + i, 1.0 + i, 1.0) for i, d in enumerate(pd.date_range("2021-01-01", periods=30))], "symbol string, date date, close double, high double, low double, volume double")
    assert set(by_date(features.rsi(up), "rsi")) == {50.0}


def test_triple_barrier_against_loop(bars, walk):
    h, p = 21, walk["close"].to_numpy()
    lr = np.log(walk["close"]).diff()
    vol = lr.rolling(20).std().fillna(0.02).to_numpy() * np.sqrt(h)
    want = np.full(len(p), np.nan)
    for i in range(len(p) - h - 1):
        for q in p[i + 1 : i + 1 + h]:
            if q >= p[i] * (1 + 1.25 * vol[i]):
                want[i] = 1
                break
            if q <= p[i] * (1 - 2.5 * vol[i]):
                want[i] = 0
                break
    assert np.array_equal(by_date(features.triple_barrier(bars), "target"), want, equal_nan=True)


def test_flat_runs_lose_their_head(spark):
    x = spark.createDataFrame([("A", d.date(), v) for d, v in zip(pd.date_range("2021-01-03", periods=7), [10.0, 11.0, 12.0, 12.0, 12.0, 12.0, 13.0])], "symbol string, date date, close double")
    assert by_date(sectors.scrub(x), "filled").tolist() == [10, 11, 11, 11, 11, 11, 13]


def test_simulation_does_not_depend_on_partitions(spark):
    params = spark.createDataFrame([("A", 0.001, 0.02), ("B", 0.0, 0.01)], "symbol string, mu double, sigma double")
    for model in ("gbm", "ou", "jump", "unknown"):
        a, b = (sorted(map(tuple, montecarlo.simulate(params.repartition(k), model, 20, 3000).collect())) for k in (1, 4))
        assert a == b and len(a) == 6000
    mean = montecarlo.simulate(params, "gbm", 20, 20000).groupBy("symbol").agg(F.avg("ret")).collect()
    assert all(abs(m - {"A": np.expm1(0.02), "B": 0.0}[s]) < 0.004 for s, m in mean)


def test_simulation_queries_run_the_risk_job(spark):
    from tapeloom.plans import risk

    params = {r.symbol: r for r in risk._params(spark, "/root/testdata/sf0.001").collect()}
    got = risk.mc_gbm(spark, "/root/testdata/sf0.001").collect()
    assert {r.symbol for r in got} == set(params) and {r.sims for r in got} == {100_000}
    from statistics import NormalDist

    for r in got:  # quantiles of the lognormal end of 240 days
        mu, sd = 240 * (params[r.symbol].mu - params[r.symbol].sigma ** 2 / 2), 240 ** 0.5 * params[r.symbol].sigma
        for p, q in ((0.05, r.p5), (0.95, r.p95)):
            assert abs(NormalDist(mu, sd).cdf(float(np.log1p(q))) - p) < 0.005


def test_bootstrap_against_brute_force(spark):
    """Each path by hand from the same draws; the fan, drawdowns and tails of the same paths; any partitioning."""
    r = np.random.default_rng(5).normal(0.001, 0.02, 90).clip(-0.1, 0.1)
    days = pd.date_range("2020-01-01", periods=90).date
    rows = [("A", d, float(v)) for d, v in zip(days, r)] + [("B", days[0], 0.01), ("C", days[0], None)]
    df = spark.createDataFrame(rows, "symbol string, date date, r double")
    n = montecarlo.CHUNK + 100
    a, b = (sorted(map(tuple, montecarlo.bootstrap(df.repartition(k), 70, n).collect())) for k in (1, 5))
    assert a == b and len(a) == 2 * n and {x[0] for x in a} == {"A", "B"}
    paths = []
    for chunk, size in ((0, montecarlo.CHUNK), (1, 100)):
        rng = montecarlo._generator(7, "A", chunk)
        starts = [rng.integers(0, 60, size) for _ in range(3)]
        for s in range(size):
            steps = [r[starts[d // 30][s] + d % 30] for d in range(70)]
            paths.append(np.cumprod(1 + np.array(steps)))
    paths = np.array(paths)
    top = np.maximum(np.maximum.accumulate(paths, axis=1), 1)
    want = np.column_stack([paths[:, -1] - 1, (paths / top - 1).min(1).clip(max=0), (paths < top).mean(1)])
    got = np.array([x[2:] for x in a if x[0] == "A"])
    assert np.allclose(got, want)
    one = [x for x in a if x[0] == "B"]  # a history of one day is repeated
    assert np.allclose([x[2] for x in one], 1.01**70 - 1)
    fan = sorted(montecarlo.bootstrap_fan(df, (5, 50), 70, n).where("symbol = 'A'").collect(), key=lambda x: x.day)
    assert [x.day for x in fan] == list(range(71)) and fan[0].p5 == 1
    assert np.allclose([[x.p5, x.p50] for x in fan[1:]], np.percentile(paths, (5, 50), axis=0).T)


def test_best_allocation_against_a_fine_grid(spark):
    from tapeloom.plans import risk

    ret = np.random.default_rng(2).normal(0.03, 0.2, 500)
    df = spark.createDataFrame([("A", float(x)) for x in ret], "symbol string, ret double")
    coarse = risk.best_allocation(df, F.lit(0.0), 0.025, 40).first()
    fine = risk.best_allocation(df, F.lit(coarse.f - 0.025), 0.001, 50).first()
    grid = np.arange(1001) / 1000
    utility = [np.mean(np.maximum(1 + f * ret, 1e-6) ** -2.0 / -2) for f in grid]
    assert fine.f == grid[int(np.argmax(np.round(utility, 9)))]


def test_lags_by_information_criterion():
    rng = np.random.default_rng(4)
    e = rng.normal(size=600)
    x = np.cumsum(e)
    n = len(x) - 1
    most = int(np.ceil(12 * (n / 100) ** 0.25))
    a, y = models._lagged(x, most)
    scores = []
    for k in range(most + 1):
        b = a[:, : 2 + k]
        rest = y - b @ np.linalg.lstsq(b, y, rcond=None)[0]
        scores.append(len(y) * np.log(rest @ rest / len(y)) + 2 * (2 + k))
    assert models.best_lags(x) == int(np.argmin(scores))


def test_portfolios():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 6)) * [1, 2, 1, 3, 1, 2]
    cov, mu = np.cov(a.T), np.array([0.1, 0.3, 0.05, 0.4, 0.2, 0.1])
    w = optimize.min_variance(cov)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all()
    other = rng.dirichlet(np.ones(6), 2000)
    assert w @ cov @ w <= np.einsum("ij,jk,ik->i", other, cov, other).min() + 1e-9
    t = optimize.tangency(mu, cov, 0.0)
    assert t @ mu / np.sqrt(t @ cov @ t) >= (other @ mu / np.sqrt(np.einsum("ij,jk,ik->i", other, cov, other))).max() - 1e-3
    prior = np.full(6, 0.1)
    post = optimize.black_litterman(cov, prior, {2: (0.5, 0.9)})
    assert post[2] > 0.3 and np.allclose(optimize.black_litterman(cov, prior, {}), prior)


def test_models():
    rng = np.random.default_rng(2)
    calm, wild = rng.normal(0.1, 0.01, 300), rng.normal(0.5, 0.05, 100)
    assert models.regime(np.r_[calm, wild])[0] == "Stressed" and models.regime(np.r_[wild, calm])[0] == "Calm" and models.regime(calm[:50])[0] == "Neutral"
    h, r = 1e-4, []
    for z in rng.normal(size=3000):
        r.append(np.sqrt(h) * z)
        h = 2e-6 + 0.1 * r[-1] ** 2 + 0.88 * h
    _, _, alpha, beta, _ = models.garch(np.array(r))
    assert abs(alpha - 0.1) < 0.06 and abs(beta - 0.88) < 0.1
    noise = rng.normal(size=500)
    assert models.adf(noise, 1) < -10 and models.adf(np.cumsum(noise), 1) > -3.5
    x = rng.normal(size=(800, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=800) > 0).astype(float)
    p = signal.Boosted(60, 0.1, monotone={0: 1}).fit(x, y, np.ones(800))
    line = np.column_stack([np.linspace(-2, 2, 50), np.zeros(50), np.zeros(50)])
    assert ((p.predict(x) > 0.5) == (y > 0)).mean() > 0.85 and (np.diff(p.predict(line)) >= -1e-12).all()
    assert np.allclose(models.logistic(x, y, ridge=1e-6)[1:3] / models.logistic(x, y, ridge=1e-6)[0], 0, atol=0.3)


def _learnable(n: int = 900) -> pd.DataFrame:
    a = np.random.default_rng(3).normal(size=(n, 2))
    target = (a[:, 0] + 0.5 * np.random.default_rng(4).normal(size=n) > 0).astype(float)
    return pd.DataFrame({"symbol": "S", "date": pd.date_range("2015-01-01", periods=n), "trend_a": a[:, 0], "b": a[:, 1], "target": target})


def test_signal_on_a_learnable_target(spark):
    rows = _learnable()
    both = pd.concat([rows, rows.head(60).assign(symbol="T")])
    got = {r.symbol: r for r in signal.signal(spark.createDataFrame(both), ["trend_a", "b"], rounds=200).collect()}
    r = got["S"]
    assert r.folds == 5 and r.cv_score > 0.5 and r.top.startswith("trend_a") and r.calibrated and 0 <= r.probability <= 1 and r.auc > 0.75
    assert got["T"].note == "short history" and got["T"].probability == 0.5


def test_folds_see_nothing_of_later_rows():
    rows = _learnable(600)
    for train, start, stop in signal.splits(600, 5, 21):
        assert train == max(50, start - 20 - 63) and stop - start == 100
    changed = rows.copy()
    _, _, stop = signal.splits(600, 5, 21)[1]
    changed.loc[stop:, ["trend_a", "b"]] = 1e3  # after the second fold's test rows
    a, b = (signal.fit_fold(x, 2, ["trend_a", "b"], 21, 5, 30) for x in (rows, changed))
    assert a == b and len(a) == 100


def test_monotone_directions_by_name():
    assert [signal.direction(c) for c in ("sharpe_fast_z", "trend_slope", "vol_regime_z", "roll_skew", "rsi")] == [1, 1, -1, -1, 0]


def test_conviction():
    assert signal.conviction(0.5, 0.0, None) == 0 and signal.conviction(0.6, 0.05, 0.05) == pytest.approx(0.85)
    assert signal.conviction(0.59, 0.05, 0.0) == pytest.approx(0.95 * 0.85)


def test_broker_keeps_its_accounts(walk):
    rows = walk.assign(atr=2.0, prob=np.where(np.arange(len(walk)) % 40 < 20, 0.7, 0.4))
    got = broker.simulate(rows, capital=1e6)
    assert got["trades"] > 5 and got["max_drawdown"] <= 0 and 0 < got["exposure"] < 1
    idle = broker.simulate(rows.assign(prob=0.1))
    assert idle["trades"] == 0 and idle["final_equity"] == 10_000_000.0
    free = broker.simulate(rows, capital=1e6, fee=0.0, slippage=0.0)
    assert free["final_equity"] > got["final_equity"]


def test_fees_at_tier_edges(spark):
    x = spark.createDataFrame([(v,) for v in (2500.0, 2500.01, 50_000.0, 500_000.0, 2_000_000.0, 10_000_000.0, 10_000_001.0)], "a double")
    got = [r[0] for r in x.select(trading.commission("a")).collect()]
    assert np.allclose(got, [10.0, 2500.01 * 0.0036, 180.0, 1650.0, 6200.0, 27_000.0, 10_000_001.0 * 0.0024])


def test_connectors(spark, tmp_path):
    raw = spark.createDataFrame([("2024-01-02", "5", "x", 1), ("2024-01-01", "4", None, 2), ("2024-01-02", "6", "7", 3), ("bad", "1", "1", 4), ("2024-01-03", "?", "", 5)], "`Trade date` string, ` A ` string, B string, k int")
    got = sorted((str(r.date), r.asset, r.price) for r in connectors.price_matrix(raw, "k").collect())
    assert got == [("2024-01-01", "A", 4.0), ("2024-01-02", "A", 6.0), ("2024-01-02", "B", 7.0), ("2024-01-03", "A", 6.0), ("2024-01-03", "B", 7.0)]
    feed = spark.createDataFrame([("A", '{"t":[86400,172800],"o":[1,2],"h":[1,2],"l":[1,2],"c":[1,2],"v":[5,6]}'), ("B", "broken")], "symbol string, body string")
    assert [(r.symbol, str(r.date), r.close) for r in connectors.parse_chart(feed).collect()] == [("A", "1970-01-02", 1.0), ("A", "1970-01-03", 2.0)]
    old = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 2.0)], "s string, d int, v double")
    new = spark.createDataFrame([("A", 1, 9.0), ("C", 1, 3.0)], "s string, d int, v double")
    assert sorted(map(tuple, connectors.upsert(old, new, ["s", "d"]).collect())) == [("A", 1, 9.0), ("B", 1, 2.0), ("C", 1, 3.0)]
    path = connectors.write_artifacts(spark.createDataFrame([("A", 1.5, [1, 2]), ("B", None, [])], "symbol string, score double, xs array<int>"), str(tmp_path), "cv", "2024-01-01T00-00")
    assert [(r.symbol, r.score, r.xs) for r in connectors.read_artifacts(spark, path, "score double, xs array<int>", ["A"]).collect()] == [("A", 1.5, [1, 2])]
    (tmp_path / "bars.csv").write_text("symbol,date,open,high,low,close,volume\nA,2024-01-01,1,2,0.5,1.5,100\nA,bad,x,2,1,1,1\n")
    assert connectors.read_bars_csv(spark, str(tmp_path / "bars.csv")).where("date IS NOT NULL").count() == 1
    q = connectors.JobQueue(str(tmp_path / "queue"))
    q.submit("a", {"x": 1})
    assert q.lock() and not q.lock() and q.finish("a", True, y=2).parent.name == "completed"


def test_symbols_and_constant_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Name,Ticker\nx, abc \ny,def\ny,def\n")
    (tmp_path / "b.txt").write_text("abc\n\nxyz\n")
    read = lambda f: sorted(r[0] for r in connectors.read_symbols(spark, str(tmp_path / f)).collect())
    assert read("a.csv") == ["ABC", "DEF"] and read("b.txt") == ["ABC", "XYZ"]
    all_ = spark.createDataFrame([(c,) for c in "edcba"], "symbol string")
    assert [r[0] for r in connectors.pick_symbols(all_, limit=2).collect()] == ["a", "b"]
    assert connectors.pick_symbols(all_, sample=3).count() == 3
    x = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert features.drop_constant(x, ["a", "b"]).columns == ["b"] and features.drop_constant(x, ["a"]).columns == ["a", "b"]


def test_entry_works_without_the_training_data_part(tmp_path):
    for name in ("__spark_entry__.py", "tapeloom"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(__import__('re').match(r'op[0-9]', k) or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr[-800:]


def _copy(src: Path, to: Path) -> None:
    import shutil

    shutil.copytree(src, to, ignore=shutil.ignore_patterns("llm", "__pycache__"))


def test_macro_csv_and_cached_series(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Day,Rate\n2020-01-01,1.5\nnot a date,2\n2020-01-02,x\n2020-01-03,3\n")
    got = [(str(r.date), r.value) for r in connectors.read_macro_csv(spark, str(tmp_path / "m.csv")).orderBy("date").collect()]
    assert got == [("2020-01-01", 1.5), ("2020-01-03", 3.0)]
    calls = []

    def fetch(since):
        calls.append(since)
        return spark.createDataFrame([("2020-01-03", 4.0), ("2020-01-06", 5.0)], "date string, value double").selectExpr("to_date(date) AS date", "value")

    path = str(tmp_path / "cache")
    first = connectors.cached_series(spark, path, fetch, today="2020-01-06")
    assert calls == [None] and first.count() == 2
    assert connectors.cached_series(spark, path, fetch, today="2020-01-08").count() == 2 and len(calls) == 1  # fresh enough
    again = connectors.cached_series(spark, path, lambda since: fetch(since).withColumn("value", F.col("value") + 1), today="2020-01-20")
    assert str(calls[-1]) == "2020-01-06" and sorted(r.value for r in again.collect()) == [5.0, 6.0]  # the later value of a date stays


def test_summary_metadata_and_log(spark, tmp_path):
    x = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, pnl double")
    for kind in ("parquet", "csv"):
        connectors.write_summary(x, str(tmp_path), "cv", f"r-{kind}", kind)
        assert sorted(map(tuple, connectors.read_summary(spark, str(tmp_path), "cv", f"r-{kind}").collect())) == [("A", 1.0), ("B", 2.0)]
    assert connectors.read_summary(spark, str(tmp_path), "cv", "missing") is None
    with pytest.raises(ValueError):
        connectors.write_summary(x, str(tmp_path), "cv", "r", "xml")
    connectors.write_metadata(spark, str(tmp_path), "cv", "r1", {"symbols": 2, "at": "2020-01-01"})
    assert connectors.read_metadata(spark, str(tmp_path), "cv", "r1") == {"symbols": 2, "at": "2020-01-01"}
    log = str(tmp_path / "log")
    connectors.append_log(x, log)
    connectors.append_log(x, log)
    assert spark.read.csv(log, header=True).count() == 4


def test_scanner_gate_and_sector_scores(spark):
    from tapeloom.plans import scanner

    rng = np.random.default_rng(9)
    dates = [str(x.date()) for x in pd.date_range("2020-01-01", periods=120)]
    path = {"UP": 100 + np.arange(120.0), "WALK": 50 + 2 * rng.normal(size=120), "FEW": np.arange(1, 31.0), "LONE": 50 + 0.5 * np.arange(120) + rng.random(120)}
    rows = [(s, "X" if s != "LONE" else "Y", d, float(p)) for s, v in path.items() for d, p in zip(dates, v)]
    bars = spark.createDataFrame(rows, "symbol string, sector string, date string, close double").selectExpr("symbol", "sector", "to_date(date) AS date", "close")
    models_ = spark.createDataFrame([("UP", 0.6), ("WALK", 0.5), ("FEW", 0.9), ("LONE", 0.7)], "symbol string, cv_score double")
    tails = spark.createDataFrame([("UP", -0.2)], "symbol string, es_95 double")
    got = {r.symbol: r for r in scanner.scan(bars, models_, tails).collect()}
    walk = path["WALK"]
    dens = np.histogram(walk[-61:-1], 50, density=True)[0]
    noise, moved = -(dens[dens > 0] * np.log(dens[dens > 0])).sum(), abs(walk[-1] - walk[-31]) / np.abs(np.diff(walk[-31:])).sum()
    assert noise > scanner.GATE_ENTROPY and moved < scanner.GATE_EFFICIENCY  # so the gate takes it
    assert set(got) == {"UP", "LONE"}
    assert got["UP"].efficiency == pytest.approx(1) and got["UP"].tail == pytest.approx(0.2)
    assert got["LONE"].alpha == 0 and got["LONE"].tail == pytest.approx(0.05)
    assert all(r.score == pytest.approx(r.alpha + 2 * r.efficiency - 2 * r.entropy) for r in got.values())
