"""Backtests and validation of probabilities, model tiers, fees, taxes, orders and mark-to-market."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, scans, windows as w
from tapeloom.operators import broker
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders, by_symbol, table

#: A deterministic stand-in for out-of-sample probabilities: a hash-free function of the bar's order in its symbol.
_PROB = f"""{BARS}, h AS (SELECT symbol, sector, date, close, volume, {d.log_return()} AS lr, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars),
p AS (SELECT *, 0.4 + ((k * 7919) % 1000) / 4000.0 AS prob, CASE WHEN lead(lr) OVER (PARTITION BY symbol ORDER BY date) > 0 THEN 1 ELSE 0 END AS y FROM h WHERE lr IS NOT NULL)"""


def _r(x, n=6):
    return F.round(x, n)


def history(spark, sf_dir, probabilities=None, bars=None):
    """Bars with a probability of a rise and whether it came. Without a table of out-of-sample probabilities (symbol, date, prob),
    such as `calibration.fit` gives, a stand-in that SQL can compute takes its place."""
    x = bars_orders(spark, sf_dir) if bars is None else bars
    x = x.withColumns({"lr": w.log_return(), "k": F.row_number().over(w.W)}).where("lr IS NOT NULL")
    if probabilities is None:
        x = x.withColumn("prob", 0.4 + ((F.col("k") * 7919) % 1000) / F.lit(4000.0))
    else:
        x = by_symbol(x.join(probabilities.select("symbol", "date", "prob"), ["symbol", "date"]))
    return x.withColumn("y", F.when(F.lead("lr").over(w.W) > 0, 1).otherwise(0))


@query(f"""WITH {_PROB}, t AS (SELECT symbol, lead(lr) OVER (PARTITION BY symbol ORDER BY date) AS nxt FROM p WHERE prob > 0.55),
a AS (SELECT symbol, count(*) AS n, count(CASE WHEN nxt > 0 THEN 1 END) AS wins, coalesce(avg(CASE WHEN nxt > 0 THEN nxt END), 0.02) AS aw, coalesce(abs(avg(CASE WHEN nxt <= 0 THEN nxt END)), 0.02) AS al FROM t GROUP BY symbol),
b AS (SELECT *, wins / n AS wr, CASE WHEN al > 0 THEN aw / al ELSE 1.0 END AS b FROM a)
SELECT symbol, n AS trade_count, round(wr, 6) AS win_rate, round(b, 6) AS win_loss_ratio, round(greatest(0.0, (wr * b - (1 - wr)) / b), 6) AS kelly_fraction, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(aw * wr - al * (1 - wr), 6) AS daily_edge FROM b""")
def perf_metrics(spark, sf_dir, probabilities=None):
    """Trades are bars above the threshold; each earns the return of the next trade's bar."""
    t = history(spark, sf_dir, probabilities).where("prob > 0.55").withColumn("nxt", F.lead("lr").over(w.W))
    x = t.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(F.col("nxt") > 0, 1)).alias("wins"), F.coalesce(F.avg(F.when(F.col("nxt") > 0, F.col("nxt"))), F.lit(0.02)).alias("aw"), F.coalesce(F.abs(F.avg(F.when(F.col("nxt") <= 0, F.col("nxt")))), F.lit(0.02)).alias("al"))
    x = x.withColumns({"wr": F.col("wins") / F.col("n"), "b": F.when(F.col("al") > 0, F.col("aw") / F.col("al")).otherwise(1.0)})
    return x.select("symbol", F.col("n").alias("trade_count"), _r("wr").alias("win_rate"), _r("b").alias("win_loss_ratio"), _r(F.greatest(F.lit(0.0), (F.col("wr") * F.col("b") - (1 - F.col("wr"))) / F.col("b"))).alias("kelly_fraction"), _r("aw").alias("avg_win"), _r("al").alias("avg_loss"), _r(F.col("aw") * F.col("wr") - F.col("al") * (1 - F.col("wr"))).alias("daily_edge"))


@query(f"""WITH {_PROB}, s AS (SELECT symbol, date, CASE WHEN prob >= 0.55 THEN 1 ELSE 0 END * lead(lr) OVER (PARTITION BY symbol ORDER BY date) AS sr FROM p), e AS (SELECT *, exp(sum(sr) OVER {d.w()}) AS eq FROM s WHERE sr IS NOT NULL),
g AS (SELECT *, eq / max(eq) OVER {d.w()} - 1 AS dd FROM e)
SELECT symbol, round(arg_max(eq, date) - 1, 5) AS total_return, round(ln(arg_max(eq, date)) * 252.0 / count(*), 6) AS log_growth, round(min(dd), 6) AS max_drawdown, round(avg(CASE WHEN sr <> 0 THEN CASE WHEN sr > 0 THEN 1.0 ELSE 0.0 END END), 6) AS win_rate FROM g GROUP BY symbol""")
def prob_backtest(spark, sf_dir, probabilities=None):
    """Log-return curve of holding the next bar whenever the probability reaches the threshold; growth a year in logs."""
    x = history(spark, sf_dir, probabilities).withColumn("sr", F.when(F.col("prob") >= 0.55, 1).otherwise(0) * F.lead("lr").over(w.W)).where("sr IS NOT NULL")
    x = x.withColumn("eq", F.exp(F.sum("sr").over(w.PAST))).withColumn("dd", F.col("eq") / F.max("eq").over(w.PAST) - 1)
    last = F.max_by("eq", "date")
    return x.groupBy("symbol").agg(_r(last - 1, 5).alias("total_return"), _r(F.ln(last) * 252.0 / F.count("*")).alias("log_growth"), _r(F.min("dd")).alias("max_drawdown"), _r(F.avg(F.when(F.col("sr") != 0, F.when(F.col("sr") > 0, 1.0).otherwise(0.0)))).alias("win_rate"))


def average_rank(col: str, by=("symbol",)):
    """Mean rank among equal values."""
    return F.rank().over(Window.partitionBy(*by).orderBy(col)) + (F.count("*").over(Window.partitionBy(*by, col)) - 1) / 2.0


@query(f"""WITH {_PROB}, n AS (SELECT *, lead(lr) OVER (PARTITION BY symbol ORDER BY date) AS nxt, close * volume AS liq FROM p), f AS (SELECT *, quantile_cont(liq, 0.4) OVER (PARTITION BY symbol) AS floor FROM n),
s AS (SELECT *, CASE WHEN prob >= 0.55 AND (floor <= 0 OR round(liq, 4) >= round(floor, 4)) THEN 1 ELSE 0 END AS sig FROM f), t AS (SELECT *, sig * (coalesce(nxt, 0) - 0.003) AS tr FROM s),
r AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, prob) - 1) / 2.0 AS rp, rank() OVER (PARTITION BY symbol ORDER BY nxt) + (count(*) OVER (PARTITION BY symbol, nxt) - 1) / 2.0 AS rn FROM n WHERE nxt IS NOT NULL),
i AS (SELECT symbol, corr(rp, rn) AS ic, count(*) AS m FROM r GROUP BY symbol),
e AS (SELECT symbol, date, sig, tr, exp(sum(ln(greatest(1 + tr, 1e-6))) OVER {d.w()}) AS eq FROM t), g AS (SELECT *, eq / max(eq) OVER {d.w()} - 1 AS dd FROM e),
z AS (SELECT symbol, sum(sig)::BIGINT AS trade_count, avg(CASE WHEN sig = 1 THEN CASE WHEN tr > 0 THEN 1.0 ELSE 0.0 END END) AS win_rate, avg(CASE WHEN sig = 1 THEN tr END) AS avg_trade, arg_max(eq, date) AS eq, min(dd) AS mdd, count(*) AS n FROM g GROUP BY symbol)
SELECT symbol, round(ic, 6) AS ic, round(ic * sqrt((m - 2) / greatest(1e-6, 1 - ic * ic)), 5) AS ic_tstat, trade_count, round(win_rate, 6) AS win_rate, round(avg_trade, 6) AS avg_trade_return, round(pow(eq, 252.0 / n) - 1, 5) AS cagr, round(mdd, 5) AS max_drawdown,
    round(ic, 9) >= 0.02 AND ic * sqrt((m - 2) / greatest(1e-6, 1 - ic * ic)) >= 1.25 AND trade_count >= 25 AND pow(eq, 252.0 / n) - 1 >= 0 AS passed FROM z JOIN i USING (symbol)""")
def post_cv_validation(spark, sf_dir, probabilities=None):
    """Liquidity floor, slippage, rank information coefficient, equity curve and the pass rule (daily losses count down to the last millionth)."""
    x = history(spark, sf_dir, probabilities).withColumns({"nxt": F.lead("lr").over(w.W), "liq": F.col("close") * F.col("volume")})
    ic = x.where("nxt IS NOT NULL").select("symbol", average_rank("prob").alias("rp"), average_rank("nxt").alias("rn")).groupBy("symbol").agg(F.corr("rp", "rn").alias("ic"), F.count("*").alias("m"))
    x = x.withColumn("floor", F.percentile("liq", F.lit(0.4)).over(w.BY))
    x = x.withColumn("sig", F.when((F.col("prob") >= 0.55) & ((F.col("floor") <= 0) | (_r("liq", 4) >= _r("floor", 4))), 1).otherwise(0))
    x = x.withColumn("tr", F.col("sig") * (F.coalesce("nxt", F.lit(0.0)) - 0.003))
    x = x.withColumn("eq", F.exp(F.sum(F.ln(F.greatest(1 + F.col("tr"), F.lit(1e-6)))).over(w.PAST))).withColumn("dd", F.col("eq") / F.max("eq").over(w.PAST) - 1)
    taken = F.col("sig") == 1
    x = x.groupBy("symbol").agg(F.sum("sig").alias("trade_count"), F.avg(F.when(taken, F.when(F.col("tr") > 0, 1.0).otherwise(0.0))).alias("win_rate"), F.avg(F.when(taken, F.col("tr"))).alias("avg_trade"), F.max_by("eq", "date").alias("eq"), F.min("dd").alias("mdd"), F.count("*").alias("n")).join(ic, "symbol")
    t, cagr = F.col("ic") * F.sqrt((F.col("m") - 2) / F.greatest(F.lit(1e-6), 1 - F.col("ic") * F.col("ic"))), F.pow("eq", F.lit(252.0) / F.col("n")) - 1
    ok = (_r("ic", 9) >= 0.02) & (t >= 1.25) & (F.col("trade_count") >= 25) & (cagr >= 0)
    return x.select("symbol", _r("ic").alias("ic"), _r(t, 5).alias("ic_tstat"), "trade_count", _r("win_rate").alias("win_rate"), _r("avg_trade").alias("avg_trade_return"), _r(cagr, 5).alias("cagr"), _r("mdd", 5).alias("max_drawdown"), ok.alias("passed"))


@query(f"""WITH {_PROB}, m AS (SELECT symbol, date, prob, avg(prob) OVER {d.w(120)} AS roll FROM p)
SELECT symbol, round(arg_max(roll, date), 6) AS last_mean, round(avg(prob), 6) AS mean, abs(round(arg_max(roll, date) - avg(prob), 9)) > 0.002 AS drifted FROM m GROUP BY symbol""")
def prob_drift(spark, sf_dir, probabilities=None):
    x = history(spark, sf_dir, probabilities).withColumn("roll", F.avg("prob").over(w.frame(120)))
    last = F.max_by("roll", "date")
    return x.groupBy("symbol").agg(_r(last).alias("last_mean"), _r(F.avg("prob")).alias("mean"), (F.abs(_r(last - F.avg("prob"), 9)) > 0.002).alias("drifted"))


@query(f"""WITH {_PROB}, f AS (SELECT symbol, k % 3 AS fold, prob, y, CASE WHEN prob >= 0.6 THEN 1 ELSE 0 END AS hat, rank() OVER (PARTITION BY symbol, k % 3 ORDER BY prob) + (count(*) OVER (PARTITION BY symbol, k % 3, prob) - 1) / 2.0 AS rk FROM p),
a AS (SELECT symbol, fold, count(*) AS n, sum(y) AS pos, avg(CASE WHEN hat = y THEN 1.0 ELSE 0.0 END) AS acc, avg(CASE WHEN y = 1 THEN hat END) AS tpr, avg(CASE WHEN y = 0 THEN 1 - hat END) AS tnr, sum(CASE WHEN y = 1 THEN rk END) AS rs, avg(pow(prob - y, 2)) AS brier, -avg(y * ln(prob) + (1 - y) * ln(1 - prob)) AS ll FROM f GROUP BY 1, 2),
b AS (SELECT *, (rs - pos * (pos + 1) / 2.0) / (pos * (n - pos)) AS auc FROM a WHERE pos > 0 AND pos < n), c AS (SELECT *, 0.6 * auc + 0.4 * greatest(0.0, (ln(2) - ll) / ln(2)) AS score FROM b)
SELECT symbol, count(*) AS folds, round(avg(acc), 6) AS accuracy, round(avg((tpr + tnr) / 2), 6) AS balanced_accuracy, round(avg(auc), 6) AS auc, round(avg(brier), 6) AS brier, round(avg(ll), 6) AS log_loss, round(avg(score), 6) AS cv_score, round(stddev_samp(score), 6) AS cv_std FROM c GROUP BY symbol""")
def fold_metrics(spark, sf_dir, probabilities=None, bars=None):
    """Accuracy, balanced accuracy, AUC from average ranks, Brier score, log-loss and the combined score, by fold and averaged."""
    x = history(spark, sf_dir, probabilities, bars).withColumns({"fold": F.col("k") % 3, "hat": F.when(F.col("prob") >= 0.6, 1).otherwise(0)}).withColumn("rk", average_rank("prob", ("symbol", "fold")))
    pos = F.sum("y")
    x = x.groupBy("symbol", "fold").agg(
        F.count("*").alias("n"), pos.alias("pos"), F.avg(F.when(F.col("hat") == F.col("y"), 1.0).otherwise(0.0)).alias("acc"), F.avg(F.when(F.col("y") == 1, F.col("hat"))).alias("tpr"), F.avg(F.when(F.col("y") == 0, 1 - F.col("hat"))).alias("tnr"),
        F.sum(F.when(F.col("y") == 1, F.col("rk"))).alias("rs"), F.avg(F.pow(F.col("prob") - F.col("y"), 2)).alias("brier"), (-F.avg(F.col("y") * F.ln("prob") + (1 - F.col("y")) * F.ln(1 - F.col("prob")))).alias("ll"),
    ).where("pos > 0 AND pos < n")
    x = x.withColumn("auc", (F.col("rs") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * (F.col("n") - F.col("pos"))))
    x = x.withColumn("score", 0.6 * F.col("auc") + 0.4 * F.greatest(F.lit(0.0), (math.log(2) - F.col("ll")) / math.log(2)))
    a = lambda c: _r(F.avg(c))
    return x.groupBy("symbol").agg(F.count("*").alias("folds"), a("acc").alias("accuracy"), a((F.col("tpr") + F.col("tnr")) / 2).alias("balanced_accuracy"), a("auc").alias("auc"), a("brier").alias("brier"), a("ll").alias("log_loss"), a("score").alias("cv_score"), _r(F.stddev_samp("score")).alias("cv_std"))


@query(f"""WITH {_PROB}, e AS (SELECT symbol, date, prob, {d.ewm('prob', 0.3)} AS sm FROM p), q AS (SELECT *, quantile_cont(sm, 0.7) OVER {d.w(60)} AS q70, count(*) OVER {d.w(60)} AS n FROM e)
SELECT symbol, date, round(sm, 6) AS smoothed, round(least(greatest(CASE WHEN n >= 60 THEN q70 ELSE 0.52 END, 0.5), 0.8), 6) AS threshold, round(avg(prob) OVER {d.w(50)}, 6) AS trend50 FROM q""")
def prob_threshold(spark, sf_dir, probabilities=None):
    """Smoothed probability, its rolling 70 % quantile as entry threshold, and the 50-bar mean."""
    # Folded row by row: these probabilities are short decimals, so their means fall on rounding edges, where the order of sums tells.
    x = history(spark, sf_dir, probabilities).withColumns({"sm": w.ewm("prob", 0.3), "trend50": F.avg("prob").over(w.frame(50))})
    x = scans.rolling_quantile(x, "sm", 60, 0.7, "q70", ["symbol", "date", "sm", "trend50"])
    threshold = F.least(F.greatest(F.coalesce("q70", F.lit(0.52)), F.lit(0.5)), F.lit(0.8))
    return x.select("symbol", "date", _r("sm").alias("smoothed"), _r(threshold).alias("threshold"), _r("trend50").alias("trend50"))


# broker's rate by amount (upper bound, rate), fee of the regulator, depository fee, tax rates.
FEE_TIERS = [(50_000.0, 0.0036), (500_000.0, 0.0033), (2_000_000.0, 0.0031), (10_000_000.0, 0.0027)]
TOP_RATE, SMALL_AMOUNT, SMALL_FEE, REGULATOR, DEPOSITORY = 0.0024, 2_500.0, 10.0, 0.00015, 25.0
SHORT_TAX, LONG_TAX, LONG_DAYS = 0.075, 0.05, 365


def commission(amount):
    """Broker's commission: the tier of the whole amount; a flat fee for small ones."""
    a = F.col(amount) if isinstance(amount, str) else amount
    out = F.when(a <= SMALL_AMOUNT, F.lit(SMALL_FEE))
    for top, rate in FEE_TIERS:
        out = out.when(a <= top, a * rate)
    return out.otherwise(a * TOP_RATE)


def fees(amount):
    a = F.col(amount) if isinstance(amount, str) else amount
    return commission(a) + a * REGULATOR + DEPOSITORY


def gains_tax(profit, days):
    return F.when(profit <= 0, 0.0).when(days < LONG_DAYS, profit * SHORT_TAX).otherwise(profit * LONG_TAX)


def _fee_sql(a: str) -> str:
    tiers = " ".join(f"WHEN {a} <= {t} THEN {a} * {r}" for t, r in FEE_TIERS)
    return f"(CASE WHEN {a} <= {SMALL_AMOUNT} THEN {SMALL_FEE} {tiers} ELSE {a} * {TOP_RATE} END)"


@query(f"""SELECT o_orderkey, round({_fee_sql('o_totalprice')}, 8) AS commission, round({_fee_sql('o_totalprice')} + o_totalprice * {REGULATOR} + {DEPOSITORY}, 8) AS fees,
    round(({_fee_sql('o_totalprice')} + o_totalprice * {REGULATOR} + {DEPOSITORY}) / o_totalprice, 8) AS cost_pct,
    round(CASE WHEN o_totalprice - 150000 <= 0 THEN 0.0 WHEN o_orderkey % 800 < {LONG_DAYS} THEN (o_totalprice - 150000) * {SHORT_TAX} ELSE (o_totalprice - 150000) * {LONG_TAX} END, 8) AS tax FROM orders""")
def fees_and_tax(spark, sf_dir):
    x = table(spark, sf_dir, "orders")
    f = fees("o_totalprice")
    return x.select("o_orderkey", _r(commission("o_totalprice"), 8).alias("commission"), _r(f, 8).alias("fees"), _r(f / F.col("o_totalprice"), 8).alias("cost_pct"), _r(gains_tax(F.col("o_totalprice") - 150000, F.col("o_orderkey") % 800), 8).alias("tax"))


_BUY = f"""{BARS}, l AS (SELECT symbol, arg_max(close, date) AS ltp, max(date) AS d1, arg_min(close, date) AS buy, min(date) AS d0 FROM bars GROUP BY symbol), q AS (SELECT *, floor(500000.0 * 0.2 / buy)::BIGINT AS qty FROM l),
pf AS (SELECT symbol, d0, d1, ltp, buy, qty, qty * buy AS amount, {_fee_sql('(qty * buy)')} + qty * buy * {REGULATOR} + {DEPOSITORY} AS buy_fees FROM q WHERE qty > 0)"""


def open_portfolio(bars, capital: float = 500_000.0, size: float = 0.2):
    """One position a symbol at its first close: whole shares, amount, fees and cost basis."""
    x = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("ltp"), F.max("date").alias("d1"), F.min_by("close", "date").alias("buy"), F.min("date").alias("d0"))
    x = x.withColumn("qty", F.floor(F.lit(capital) * size / F.col("buy"))).where("qty > 0").withColumn("amount", F.col("qty") * F.col("buy"))
    return x.withColumn("buy_fees", fees("amount")).withColumn("basis", F.col("amount") + F.col("buy_fees"))


@query(f"""WITH {_BUY}, v AS (SELECT *, amount + buy_fees AS basis, qty * ltp AS val FROM pf), u AS (SELECT *, val - ({_fee_sql('val')} + val * {REGULATOR} + {DEPOSITORY}) - basis AS pnl FROM v)
SELECT symbol, d0 AS entry_date, qty AS quantity, round(amount, 2) AS amount, round(buy_fees, 4) AS buy_fees, round(basis, 2) AS cost_basis, round(ltp, 2) AS ltp, round(pnl, 2) AS unrealized_pnl, round(CASE WHEN pnl <= 0 THEN 0.0 ELSE pnl * {SHORT_TAX} END, 2) AS tax FROM u""")
def mark_to_market(spark, sf_dir):
    """Open positions valued at the last close, net of selling fees, with the tax on gains held for no day."""
    x = open_portfolio(bars_orders(spark, sf_dir)).withColumn("val", F.col("qty") * F.col("ltp"))
    x = x.withColumn("pnl", F.col("val") - fees("val") - F.col("basis"))
    return x.select("symbol", F.col("d0").alias("entry_date"), F.col("qty").alias("quantity"), _r("amount", 2).alias("amount"), _r("buy_fees", 4).alias("buy_fees"), _r("basis", 2).alias("cost_basis"), _r("ltp", 2).alias("ltp"), _r("pnl", 2).alias("unrealized_pnl"), _r(gains_tax(F.col("pnl"), F.lit(0)), 2).alias("tax"))


@query(f"""WITH {_BUY}, g AS (SELECT bars.symbol, date, qty * close - amount AS pnl FROM bars JOIN pf USING (symbol)), lp AS (SELECT symbol, arg_max(pnl, date) AS last_pnl FROM g GROUP BY symbol), t AS (SELECT sum(pnl) AS total FROM g WHERE date = (SELECT max(date) FROM g))
SELECT pf.symbol, round(last_pnl, 2) AS latest_pnl, round(sum(last_pnl) OVER (), 2) AS portfolio_pnl, round(sum(amount) OVER (), 2) AS invested FROM pf LEFT JOIN lp USING (symbol)""")
def pnl_latest(spark, sf_dir):
    """Positions with their latest log entry, and portfolio totals joined as one row."""
    bars = bars_orders(spark, sf_dir)
    pf = open_portfolio(bars).select("symbol", "qty", "amount")
    log = bars.join(pf, "symbol").select("symbol", "date", (F.col("qty") * F.col("close") - F.col("amount")).alias("pnl"))
    x = pf.join(log.groupBy("symbol").agg(F.max_by("pnl", "date").alias("last_pnl")), "symbol", "left")
    total = x.agg(F.sum("last_pnl").alias("tp"), F.sum("amount").alias("ti"))
    return x.join(F.broadcast(total)).select("symbol", _r("last_pnl", 2).alias("latest_pnl"), _r("tp", 2).alias("portfolio_pnl"), _r("ti", 2).alias("invested"))


@query(f"""WITH {_BUY}, g AS (SELECT date, sum(qty * close - amount) AS pnl, count(*) AS positions FROM bars JOIN pf USING (symbol) GROUP BY date) SELECT date, round(pnl, 2) AS pnl, positions FROM g""")
def daily_pnl(spark, sf_dir):
    bars = bars_orders(spark, sf_dir)
    pf = open_portfolio(bars).select("symbol", "qty", "amount")
    return bars.join(pf, "symbol").groupBy("date").agg(_r(F.sum(F.col("qty") * F.col("close") - F.col("amount")), 2).alias("pnl"), F.count("*").alias("positions"))


@query()
def t2_backtest(spark, sf_dir, probabilities=None):
    """Broker simulation with settlement queues and trailing stops, a fold over each symbol's bars."""
    from tapeloom.plans.features import atr

    x = atr(history(spark, sf_dir, probabilities)).select("symbol", "date", "close", "high", "low", "volume", "atr", "prob", "lr")
    return broker.backtest(x, capital=2e9)
