"""What each symbol is traded by, from its own class, regimes and sector; and figures as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tapeloom.plans import artifacts, features, jobs, returns, risk, scanner
from tapeloom.plans.artifacts import BARRIERS, DEFAULT_BARRIER, DEFAULT_CLASS, DEFAULT_HORIZON, HORIZONS, REGIMES, TRADING
from tapeloom.plans.registry import ORACLE_SQL, query
from tapeloom.sources.bars import BARS, bars_orders

#: Sectors that these tables' sectors stand for: two with all tables, one with barriers alone, one that no table knows; the
#: fifth has none.
STANDS = {"AFRICA": "Commercial Banks", "ASIA": "Hydropower", "AMERICA": "Trading", "EUROPE": "Manufacturing"}
#: The class that waits for its index, and the kind of asset whose regimes an unlisted one takes.
WAITING, OTHER_KIND = "THIN_STOCK", "emerging_stock"


def trading_parameters(x, asset_class: str = "asset_class"):
    """x with the stop, window, threshold, exposure floor and weight cap of its class; others take the default class."""
    known = [t[0] for t in TRADING]
    rules = x.sparkSession.createDataFrame(TRADING, "_class string, stop_mult double, regime_window int, prob_thresh double, floor double, max_weight double")
    kind = F.when(F.col(asset_class).isin(known), F.col(asset_class)).otherwise(DEFAULT_CLASS)
    return x.withColumn("_class", kind).join(F.broadcast(rules), "_class").withColumn("index_confirm", F.col("_class") == WAITING).drop("_class")


def regime_parameters_of(x, kind: str = "kind", regime: str = "regime"):
    """x with the entry threshold and exposure floor of its kind and regime; an unknown regime counts as neutral."""
    rules = x.sparkSession.createDataFrame(REGIMES, "_kind string, _regime string, regime_thresh double, regime_floor double")
    x = x.withColumn("_kind", F.when(F.col(kind) == "index", "index").otherwise(OTHER_KIND))
    x = x.withColumn("_regime", F.when(F.col(regime).isin("bull", "bear"), F.col(regime)).otherwise("neutral"))
    return x.join(F.broadcast(rules), ["_kind", "_regime"]).drop("_kind", "_regime")


def symbol_parameters_of(bars, classes, barrier_regimes):
    """All parameters of each symbol of `bars`, by its class and trend regime, its barrier regime and its sector."""
    own = bars.groupBy("symbol").agg(F.any_value("sector").alias("sector"))
    stand = F.coalesce(*[F.when(F.col("sector") == s, F.lit(name)) for s, name in STANDS.items()])
    x = own.withColumn("sector", stand).join(classes.select("symbol", "asset_class", F.col("regime").alias("trend")), "symbol")
    x = x.join(barrier_regimes.select("symbol", "regime"), "symbol").withColumn("kind", F.when(F.col("asset_class").endswith("INDEX"), "index").otherwise(OTHER_KIND))
    return artifacts.barriers(regime_parameters_of(trading_parameters(x), "kind", "trend"))


@query(f"""WITH {BARS}, ac AS ({ORACLE_SQL["asset_class"]}), br AS ({ORACLE_SQL["barrier_regime"]}),
s(region, sector) AS (VALUES {artifacts._values(STANDS.items())}), b(sector, normal, trend, choppy, sl) AS (VALUES {artifacts._values(BARRIERS)}), h(sector, hz) AS (VALUES {artifacts._values(HORIZONS)}),
t(cls, stop, win, thr, low, cap) AS (VALUES {artifacts._values(TRADING)}), r(kind, trend, thr, low) AS (VALUES {artifacts._values(REGIMES)}),
o AS (SELECT symbol, any_value(sector) AS region FROM bars GROUP BY symbol),
x AS (SELECT symbol, s.sector, asset_class, ac.regime AS trend, br.regime, CASE WHEN asset_class LIKE '%INDEX' THEN 'index' ELSE 'emerging_stock' END AS kind FROM o LEFT JOIN s USING (region) JOIN ac USING (symbol) JOIN br USING (symbol))
SELECT symbol, x.sector, asset_class, x.trend, regime, t.stop::DOUBLE AS stop_mult, t.win::INT AS regime_window, t.thr::DOUBLE AS prob_thresh, t.low::DOUBLE AS floor, t.cap::DOUBLE AS max_weight, t.cls = 'THIN_STOCK' AS index_confirm,
    r.thr::DOUBLE AS regime_thresh, r.low::DOUBLE AS regime_floor,
    coalesce(CASE regime WHEN 'trend' THEN b.trend WHEN 'choppy' THEN b.choppy ELSE b.normal END, CASE regime WHEN 'trend' THEN {DEFAULT_BARRIER[1]} WHEN 'choppy' THEN {DEFAULT_BARRIER[2]} ELSE {DEFAULT_BARRIER[0]} END)::DOUBLE AS pt,
    coalesce(b.sl, {DEFAULT_BARRIER[3]})::DOUBLE AS sl, coalesce(hz, {DEFAULT_HORIZON})::INT AS horizon
FROM x JOIN t ON t.cls = x.asset_class JOIN r ON r.kind = x.kind AND r.trend = x.trend LEFT JOIN b ON b.sector = x.sector LEFT JOIN h ON h.sector = x.sector""")
def symbol_parameters(spark, sf_dir):
    """Trading, regime, barrier and horizon parameters of each symbol by its own figures."""
    x = symbol_parameters_of(bars_orders(spark, sf_dir), returns.asset_class(spark, sf_dir), features.barrier_regime(spark, sf_dir))
    cols = "symbol sector asset_class trend regime stop_mult regime_window prob_thresh floor max_weight index_confirm regime_thresh regime_floor pt sl horizon"
    return x.select(*cols.split())


def shown(value, digits: int, factor: int = 1) -> Column:
    """A number as tables show it: scaled, then rounded half to even."""
    return F.bround((F.col(value) * factor).cast("decimal(24,6)"), digits).cast("double")


def percent(value: str, digits: int, missing: str = "N/A") -> Column:
    """A share as text with a percent sign; half to even, no thousands separators."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.coalesce(F.concat(F.expr(f"format_number(round({value} * 100, 6), '{pattern}')"), F.lit("%")), F.lit(missing))


def amount(value: Column) -> Column:
    """Whole units with thousands separators."""
    return F.format_number(value, 0)


#: Columns of the scanner's table, digits shown, and factor.
_SCAN_SHOWN = [("cv_score", 1, 100), ("entropy", 2, 1), ("efficiency", 2, 1), ("es_95", 1, 100), ("relative_alpha", 2, 1), ("final_score", 2, 1)]


def _percent(c, digits):
    return f"coalesce(format('{{:.{digits}f}}%', round({c} * 100, 6)), 'N/A')"


def _shown(c, digits, factor=1):
    return f"round_even(CAST({c} * {factor} AS DECIMAL(24, 6)), {digits})::DOUBLE"


@query(f"""SELECT symbol, sector, price, {", ".join(f"{_shown(c, k, f)} AS {c}" for c, k, f in _SCAN_SHOWN)} FROM ({ORACLE_SQL["flagship_sector_score"]})""")
def scan_display(spark, sf_dir):
    """The scanner's table as it is shown; its order is that of the unrounded scores."""
    x = scanner.flagship_sector_score(spark, sf_dir)
    return x.select("symbol", "sector", "price", *[shown(c, k, f).alias(c) for c, k, f in _SCAN_SHOWN])



@query(f"""WITH c AS ({ORACLE_SQL["decision_engine"]}), rt AS ({ORACLE_SQL["risk_tails"]}), {BARS}, l AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol)
SELECT symbol, {_percent("probability", 1)} AS signal, {_percent("size", 1)} AS share, format('{{:,.0f}}', round(size * {jobs.CAPITAL}, 6)) AS amount, floor({jobs.CAPITAL} * size / price)::BIGINT AS shares,
    {_percent("edge", 2)} AS edge, {_percent("es_95", 1)} AS downside FROM c JOIN l USING (symbol) LEFT JOIN rt USING (symbol) WHERE label = 'Bullish' AND size > 0""")
def allocation_display(spark, sf_dir):
    """Each allocation as it is shown: shares of the capital in percent, amounts with separators, a missing tail as N/A."""
    price = bars_orders(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    x = risk.decision_engine(spark, sf_dir).where("label = 'Bullish' AND size > 0").join(price, "symbol")
    x = x.join(risk.risk_tails(spark, sf_dir).select("symbol", "es_95"), "symbol", "left")
    capital = F.lit(jobs.CAPITAL)
    return x.select(
        "symbol",
        percent("probability", 1).alias("signal"),
        percent("size", 1).alias("share"),
        amount(F.round(F.col("size") * capital, 6)).alias("amount"),
        F.floor(capital * F.col("size") / F.col("price")).alias("shares"),
        percent("edge", 2).alias("edge"),
        percent("es_95", 1).alias("downside"),
    )
