"""Parameters of known and unknown classes, regimes and sectors; figures as they are shown."""

from __future__ import annotations

from tapeloom.plans import artifacts, parameters


def test_trading_and_regime_parameters_take_defaults(spark):
    x = spark.createDataFrame([(1, "THIN_STOCK"), (2, "MEGA_INDEX"), (3, "NO_SUCH"), (4, None)], "id int, asset_class string")
    got = {r.id: r for r in parameters.trading_parameters(x).collect()}
    assert (got[1].stop_mult, got[1].max_weight, got[1].index_confirm) == (4.0, 0.10, True)
    assert (got[2].prob_thresh, got[2].floor, got[2].index_confirm) == (0.52, 0.40, False)
    for k in (3, 4):
        assert (got[k].stop_mult, got[k].regime_window, got[k].prob_thresh, got[k].index_confirm) == (2.0, 130, 0.62, False)
    x = spark.createDataFrame([(1, "index", "bull"), (2, "index", "odd"), (3, "fund", "bear"), (4, None, None)], "id int, kind string, regime string")
    got = {r.id: (r.regime_thresh, r.regime_floor) for r in parameters.regime_parameters_of(x).collect()}
    assert got == {1: (0.52, 0.80), 2: (0.55, 0.50), 3: (0.65, 0.0), 4: (0.60, 0.20)}


def test_barriers_of_unlisted_sectors_are_the_default(spark):
    x = spark.createDataFrame([(1, "Hydropower", "trend"), (2, "Manufacturing", "choppy"), (3, None, "normal"), (4, "Trading", "choppy")], "id int, sector string, regime string")
    got = {r.id: (r.pt, r.sl, r.horizon) for r in artifacts.barriers(x).collect()}
    assert got == {1: (2.20, 3.0, 30), 2: (1.0, 2.5, 21), 3: (1.25, 2.5, 21), 4: (1.0, 2.7, 21)}


def test_symbols_take_the_parameters_of_their_own_regimes(spark):
    bars = spark.createDataFrame([("A", "AFRICA"), ("A", "AFRICA"), ("B", "EUROPE"), ("C", None)], "symbol string, sector string")
    classes = spark.createDataFrame([("A", "EM_INDEX", "bear"), ("B", "LIQUID_STOCK", "bull"), ("C", "THIN_STOCK", "neutral")], "symbol string, asset_class string, regime string")
    regimes = spark.createDataFrame([("A", "choppy"), ("B", "trend"), ("C", "normal")], "symbol string, regime string")
    got = {r.symbol: r for r in parameters.symbol_parameters_of(bars, classes, regimes).collect()}
    assert set(got) == {"A", "B", "C"}
    assert (got["A"].pt, got["A"].horizon, got["A"].regime_thresh, got["A"].prob_thresh) == (0.75, 45, 0.60, 0.58)
    assert (got["B"].pt, got["B"].horizon, got["B"].regime_thresh) == (1.5, 21, 0.56)
    assert (got["C"].pt, got["C"].sl, got["C"].regime_floor, got["C"].index_confirm) == (1.25, 2.5, 0.20, True)


def test_shown_figures_round_half_to_even(spark):
    values = [0.125, 0.375, 12345.678, -0.0004, None]
    x = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v double")
    got = x.select("k", parameters.percent("v", 0).alias("p0"), parameters.percent("v", 1).alias("p1"), parameters.shown("v", 2).alias("s")).orderBy("k").collect()
    assert [r.p0 for r in got] == ["12%", "38%", "1234568%", "-0%", "N/A"]
    assert [r.p1 for r in got] == ["N/A" if v is None else f"{round(v * 100, 6):.1f}%" for v in values]
    assert [r.s for r in got] == [0.12, 0.38, 12345.68, -0.0, None]
