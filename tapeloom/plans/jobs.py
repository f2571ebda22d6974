"""Filters, picks and fallbacks of the job flow, over the tables that the other queries make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.plans import artifacts, features, portfolio, risk, trading
from tapeloom.plans.registry import ORACLE_SQL, query
from tapeloom.sources.bars import BARS, bars_orders, table

# Model score of a candidate; confidence and probability below which a symbol is passed over.
CANDIDATE_SCORE, LOW_CONFIDENCE, LOW_PROBABILITY = 0.52, 0.52, 0.55
RISK_FREE = portfolio.RISK_FREE


def _r(x, n=6):
    return F.round(x, n)


#: The stand-in knows nothing and scores below the bound everywhere; here its probabilities lean towards what came, more so for
#: symbols of a higher number, so that some pass.
_LEAN = "prob + 0.002 * regexp_extract(symbol, '[0-9]+$')::INT * (2 * y - 1) AS prob"


def leaning(spark, sf_dir):
    lean = 0.002 * F.regexp_extract("symbol", "[0-9]+$", 0).cast("int") * (2 * F.col("y") - 1)
    return trading.history(spark, sf_dir).select("symbol", "date", (F.col("prob") + lean).alias("prob"))


@query(f"""WITH f AS ({ORACLE_SQL["fold_metrics"].replace("FROM p),", f"FROM (SELECT * REPLACE ({_LEAN}) FROM p)),", 1)}) SELECT symbol, cv_score, cv_std FROM f WHERE cv_score > {CANDIDATE_SCORE} ORDER BY cv_score DESC""")
def candidates(spark, sf_dir, probabilities=None):
    """Symbols whose model score makes them candidates."""
    x = trading.fold_metrics(spark, sf_dir, leaning(spark, sf_dir) if probabilities is None else probabilities).select("symbol", "cv_score", "cv_std")
    return x.where(F.col("cv_score") > CANDIDATE_SCORE).orderBy(F.desc("cv_score"))


_LEANING = ORACLE_SQL["fold_metrics"].replace("FROM p),", f"FROM (SELECT * REPLACE ({_LEAN}) FROM p)),", 1)
#: The tiers' SQL over a grid, with the symbols' own scores and sectors in the grid's place.
_TIERS = ORACLE_SQL["model_tier"].replace("p_partkey", "symbol").split("a AS (SELECT *, coalesce(sd, 0.2)", 1)[1]


@query(f"""WITH cv AS ({_LEANING}), z AS (WITH {trading._PROB} SELECT symbol, any_value(sector) AS sector, arg_max({_LEAN.replace(" AS prob", "")}, date) AS prob FROM p GROUP BY symbol),
t AS (WITH g AS (SELECT symbol, sector, cv_score AS s, cv_std AS sd, 0.0 AS pe, false AS cal FROM cv JOIN z USING (symbol)), a AS (SELECT *, coalesce(sd, 0.2){_TIERS}),
e AS (SELECT t.*, prob, cv_std AS sd, cv_score - 0.5 AS e FROM t JOIN cv USING (symbol) JOIN z USING (symbol)),
c AS (SELECT *, CASE WHEN sd > 0.07 OR e IS NULL OR e < 0.01 THEN least(greatest(prob, 0.48), 0.52) ELSE prob END AS c FROM e)
SELECT symbol, tier, trust, round(CASE WHEN trust = 0 THEN 0.5 ELSE c END, 6)::DOUBLE AS probability FROM c""")
def symbol_tiers(spark, sf_dir, probabilities=None):
    """Each symbol's model tier and trust by its scores and sector, and its last probability after the gates."""
    if probabilities is None:
        probabilities = leaning(spark, sf_dir)
    last = trading.history(spark, sf_dir, probabilities).groupBy("symbol", "sector").agg(F.max_by("prob", "date").alias("prob"))
    x = trading.fold_metrics(spark, sf_dir, probabilities).select("symbol", "cv_score", "cv_std").join(last, "symbol")
    x = x.withColumns({"prob_edge": F.lit(0.0), "warnings": F.array().cast("array<string>"), "edge": F.col("cv_score") - 0.5})
    x = artifacts.model_quality(x)
    return x.select("symbol", "tier", _r("trust").alias("trust"), _r(artifacts.gated("prob", "cv_std", "edge", "trust")).alias("probability"))


@query(f"""WITH m AS ({ORACLE_SQL["perf_metrics"]}), {BARS}, a AS (SELECT symbol, {d.log_return()} AS lr FROM bars), b AS (SELECT symbol, avg(lr) AS market FROM a GROUP BY symbol)
SELECT symbol, win_rate, daily_edge, round(market, 6) AS market, daily_edge > round(market, 6) AS beats_market FROM m JOIN b USING (symbol)""")
def bulk_edge(spark, sf_dir, probabilities=None):
    """Expected return of a trade and whether it beats the mean log return of holding the symbol."""
    lr = bars_orders(spark, sf_dir).withColumn("lr", w.log_return()).groupBy("symbol").agg(_r(F.avg("lr")).alias("market"))
    x = trading.perf_metrics(spark, sf_dir, probabilities).select("symbol", "win_rate", "daily_edge").join(lr, "symbol")
    return x.withColumn("beats_market", F.col("daily_edge") > F.col("market"))


@query(f"""WITH w AS ({ORACLE_SQL["bulk_edge"]}) SELECT symbol, win_rate, daily_edge FROM w WHERE beats_market ORDER BY win_rate DESC, symbol""")
def winners(spark, sf_dir, probabilities=None):
    """Symbols that beat the market, by win rate."""
    return bulk_edge(spark, sf_dir, probabilities).where("beats_market").select("symbol", "win_rate", "daily_edge").orderBy(F.desc("win_rate"), "symbol")


@query(f"""WITH {trading._PROB}, l AS (SELECT symbol, arg_max(prob, date) AS prob, round(avg(CASE WHEN (prob > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS confidence FROM p GROUP BY symbol)
SELECT symbol, round(prob, 6) AS probability, confidence FROM l WHERE NOT (confidence < {LOW_CONFIDENCE} AND round(prob, 9) < {LOW_PROBABILITY})""")
def confident(spark, sf_dir, probabilities=None):
    """Symbols with a history whose hit rate or last probability is high enough."""
    hit = F.when((F.col("prob") > 0.5) == (F.col("y") == 1), 1.0).otherwise(0.0)
    x = trading.history(spark, sf_dir, probabilities).groupBy("symbol").agg(F.max_by("prob", "date").alias("prob"), _r(F.avg(hit)).alias("confidence"))
    x = x.where(~((F.col("confidence") < LOW_CONFIDENCE) & (_r("prob", 9) < LOW_PROBABILITY)))
    return x.select("symbol", _r("prob").alias("probability"), "confidence")


@query(f"""WITH {BARS}, v AS (SELECT DISTINCT n_name AS symbol FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000)
SELECT symbol, count(*) AS bars FROM bars WHERE symbol IN (SELECT symbol FROM v) GROUP BY symbol""")
def active_views(spark, sf_dir):
    """Bars of the symbols that somebody has a view of: a left semi join."""
    nation = table(spark, sf_dir, "nation")
    views = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("symbol"))
    return bars_orders(spark, sf_dir).join(views, "symbol", "left_semi").groupBy("symbol").agg(F.count("*").alias("bars"))


def first_available(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Of several sources with the same columns, each symbol's row of the first one that has it, and that source's name."""
    columns = [c for c in sources[0][1].columns if c != "symbol"]
    tagged = [x.select("symbol", F.lit(k).alias("_k"), F.struct(F.lit(name).alias("source"), *columns).alias("row")) for k, (name, x) in enumerate(sources)]
    return reduce(DataFrame.unionByName, tagged).groupBy("symbol").agg(F.min_by("row", "_k").alias("row")).select("symbol", "row.*")


@query(f"""WITH {BARS}, a AS (SELECT symbol, sector, {d.log_return()} AS lr FROM bars), h AS (SELECT symbol, round(quantile_cont(lr, 0.05), 6) AS es FROM a GROUP BY symbol), s AS (SELECT DISTINCT symbol, sector FROM bars),
t AS ({ORACLE_SQL["risk_tails"]}), x AS (SELECT symbol, es_95 FROM t JOIN s USING (symbol) WHERE sector = 'AFRICA'), y AS (SELECT symbol, var_95 FROM t JOIN s USING (symbol) WHERE sector IN ('AFRICA', 'ASIA'))
SELECT symbol, CASE WHEN x.symbol IS NOT NULL THEN 'bootstrap' WHEN y.symbol IS NOT NULL THEN 'job' ELSE 'history' END AS source, CASE WHEN x.symbol IS NOT NULL THEN es_95 WHEN y.symbol IS NOT NULL THEN var_95 ELSE es END AS tail
FROM h LEFT JOIN x USING (symbol) LEFT JOIN y USING (symbol)""")
def risk_source_chain(spark, sf_dir):
    """The tail figure of each symbol from the first source that has one."""
    bars = bars_orders(spark, sf_dir)
    lr = bars.withColumn("lr", w.log_return()).groupBy("symbol").agg(_r(F.percentile("lr", F.lit(0.05))).alias("tail"))
    known = risk.cut(risk.risk_tails(spark, sf_dir).join(bars.select("symbol", "sector").distinct(), "symbol"))
    simulated = known.where("sector = 'AFRICA'").select("symbol", F.col("es_95").alias("tail"))
    job = known.where("sector IN ('AFRICA', 'ASIA')").select("symbol", F.col("var_95").alias("tail"))
    return first_available([("bootstrap", simulated), ("job", job), ("history", lr)])


@query(f"""WITH a AS ({ORACLE_SQL["rsi_atr"]}), n AS (SELECT DISTINCT n_name AS symbol FROM nation) SELECT symbol, round(coalesce(avg(atr), 1.0), 3) AS mean_atr FROM n LEFT JOIN a USING (symbol) GROUP BY symbol""")
def mean_atr(spark, sf_dir):
    """Mean true-range average of each symbol; 1 for a symbol without bars."""
    symbols = table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"))
    x = symbols.join(features.rsi_atr(spark, sf_dir), "symbol", "left")
    return x.groupBy("symbol").agg(_r(F.coalesce(F.avg("atr"), F.lit(1.0)), 3).alias("mean_atr"))


@query(f"""WITH m AS ({ORACLE_SQL["inverse_var_weights"]}), s AS (SELECT symbol, mu, sigma, round(CASE WHEN sigma > 0 THEN (mu - {RISK_FREE}) / sigma ELSE 0 END, 6) AS sharpe FROM m)
SELECT * FROM s ORDER BY sharpe DESC, symbol LIMIT 1""")
def best_sharpe(spark, sf_dir):
    """The portfolio (here: the single asset) with the best return above the risk-free rate for its volatility."""
    sharpe = _r(F.when(F.col("sigma") > 0, (F.col("mu") - RISK_FREE) / F.col("sigma")).otherwise(0.0))
    x = portfolio.inverse_var_weights(spark, sf_dir).select("symbol", "mu", "sigma", sharpe.alias("sharpe"))
    return x.orderBy(F.desc("sharpe"), "symbol").limit(1)


#: Capital to be dealt: these prices are order totals, so that a smaller one buys no share.
CAPITAL = 100_000_000.0


@query(f"""WITH c AS ({ORACLE_SQL["decision_engine"]}), {BARS}, l AS (SELECT symbol, arg_max(close, date) AS price FROM bars GROUP BY symbol),
o AS (SELECT symbol, floor({CAPITAL} * size / price)::BIGINT AS shares, price FROM c JOIN l USING (symbol))
SELECT symbol, shares, round(shares * price, 2) AS amount, format('{{:,.0f}}', floor(shares * price)) AS shown FROM o WHERE shares > 0 ORDER BY amount DESC, symbol""")
def order_book(spark, sf_dir):
    """Orders of whole shares, the largest amount first: sorted by the number, not by the text that is shown."""
    price = bars_orders(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "date").alias("price"))
    x = risk.decision_engine(spark, sf_dir).select("symbol", "size").join(price, "symbol")
    x = x.withColumn("shares", F.floor(CAPITAL * F.col("size") / F.col("price"))).where("shares > 0")
    amount = F.col("shares") * F.col("price")
    return x.select("symbol", "shares", _r(amount, 2).alias("amount"), F.format_number(F.floor(amount), 0).alias("shown")).orderBy(F.desc("amount"), "symbol")


def fee_struct(amount: str):
    """commission, regulator, depository and total of an order as one struct."""
    regulator = F.col(amount) * trading.REGULATOR
    return F.struct(trading.commission(amount).alias("commission"), regulator.alias("regulator"), F.lit(trading.DEPOSITORY).alias("depository"), trading.fees(amount).alias("total"))


_FEE = trading._fee_sql("o_totalprice")


@query(f"""SELECT o_orderkey, round({_FEE}, 8) AS commission, round(o_totalprice * {trading.REGULATOR}, 8) AS regulator, {trading.DEPOSITORY}::DOUBLE AS depository,
    round({_FEE} + o_totalprice * {trading.REGULATOR} + {trading.DEPOSITORY}, 8) AS total FROM orders""")
def fee_breakdown(spark, sf_dir):
    """The fields of each order's fee struct."""
    x = table(spark, sf_dir, "orders").select("o_orderkey", fee_struct("o_totalprice").alias("fees"))
    return x.select("o_orderkey", *[_r(f"fees.{c}", 8).alias(c) for c in ("commission", "regulator", "depository", "total")])


@query(f"""WITH {risk.PATHS} SELECT symbol, round(median(ret), 6) AS mc_er FROM term GROUP BY symbol""")
def mc_er(spark, sf_dir):
    """Median terminal return of the simulated paths."""
    return risk.terminals(spark, sf_dir).groupBy("symbol").agg(_r(F.median("ret")).alias("mc_er"))


#: What an allocation needs to be called one, in shares of the capital.
LEAST_SIZE = 0.001


def decision_rule(decisions: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """(symbol, label, reasons): the engine's label with its reasons as an array. A symbol without a probability is deferred.

    decisions: (symbol, probability, raw_kelly, size, edge, label); drivers: (symbol, top), an array of factor names.
    """
    x = decisions if drivers is None else decisions.join(drivers, "symbol", "left")
    top = F.col("top") if drivers is not None else F.lit(None).cast("array<string>")
    pct = lambda c, k=1: F.concat(F.format_number(F.round(F.col(c) * 100, k), k), F.lit("%"))
    why = F.array_compact(
        F.array(
            F.when(F.col("edge") <= 0, F.lit("No edge after costs and tax")),
            F.when((F.col("edge") > 0) & (F.col("size") < LEAST_SIZE), F.lit("Edge too small for an allocation")),
            F.concat(F.lit("Fused probability of gain: "), pct("probability")),
            F.concat(F.lit("Recommended allocation: "), pct("size")),
            F.when(F.size(top) > 0, F.concat(F.lit("Top drivers: "), F.array_join(top, ", "))),
        )
    )
    missing = F.col("probability").isNull()
    return x.select("symbol", F.when(missing, "INSUFFICIENT DATA").otherwise(F.col("label")).alias("label"), F.when(missing, F.array(F.lit("Signal model unavailable; decision deferred."))).otherwise(why).alias("reasons"))


_PCT = "format('{{:.1f}}%', round({c} * 100, 1))"


@query(f"""WITH c AS ({ORACLE_SQL["decision_engine"]}), {BARS}, l AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol), x AS (SELECT c.*, n >= 240 AS long FROM c JOIN l USING (symbol))
SELECT symbol, CASE WHEN long THEN label ELSE 'INSUFFICIENT DATA' END AS label, CASE WHEN long THEN array_to_string(list_filter([CASE WHEN edge <= 0 THEN 'No edge after costs and tax' END, CASE WHEN edge > 0 AND size < {LEAST_SIZE} THEN 'Edge too small for an allocation' END,
    'Fused probability of gain: ' || {_PCT.format(c="probability")}, 'Recommended allocation: ' || {_PCT.format(c="size")}], lambda v: v IS NOT NULL), '; ') ELSE 'Signal model unavailable; decision deferred.' END AS reasons FROM x""")
def decision_reasons(spark, sf_dir):
    """Each symbol's decision with its reasons; symbols with less than a year of bars have no model and are deferred."""
    n = bars_orders(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("n"))
    x = risk.decision_engine(spark, sf_dir).join(n, "symbol").withColumn("probability", F.when(F.col("n") >= 240, F.col("probability")))
    return decision_rule(x).withColumn("reasons", F.array_join("reasons", "; "))
