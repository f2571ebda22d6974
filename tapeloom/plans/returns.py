"""Return summaries, drawdowns, benchmarks and betas of each symbol."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders

LR = f"lr AS (SELECT symbol, sector, date, close, volume, {d.log_return()} AS lr FROM bars)"


def returns(spark, sf_dir):
    return bars_orders(spark, sf_dir).withColumn("lr", w.log_return())


def _r(x, n=6):
    return F.round(x, n)


def _newest(k="newest"):
    return F.row_number().over(w.BY.orderBy(F.desc("date"))).alias(k)


@query(f"""WITH {BARS}, {LR} SELECT symbol, count(lr) AS n, round(avg(lr), 6) AS mean, round(stddev_samp(lr), 6) AS std, round(min(lr), 6) AS min, round(max(lr), 6) AS max,
    round(skewness(lr), 5) AS skew, round(kurtosis(lr), 5) AS kurt FROM lr GROUP BY symbol""")
def return_summary(spark, sf_dir):
    """Moments of log returns; skewness and kurtosis bias-corrected."""
    n = F.count("lr").cast("double")
    skew = F.skewness("lr") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (F.kurtosis("lr") * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))
    return returns(spark, sf_dir).groupBy("symbol").agg(F.count("lr").alias("n"), *[_r(f("lr")).alias(k) for k, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))], _r(skew, 5).alias("skew"), _r(kurt, 5).alias("kurt"))


@query(f"""WITH {BARS}, {LR}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM lr WHERE lr IS NOT NULL),
b AS (SELECT symbol, avg(lr) AS mu, stddev_samp(lr) AS sigma, avg(CASE WHEN k <= 126 THEN lr END) AS recent, avg(CASE WHEN k <= 756 THEN lr END) AS far FROM a GROUP BY symbol)
SELECT symbol, round(mu, 6) AS mu_daily, round(sigma, 6) AS sigma_daily, round(mu * 240, 5) AS mu_annual, round(sigma * sqrt(240), 5) AS sigma_annual,
    round(0.95 * recent * 240 + 0.05 * 0.06, 5) AS recent_drift, round(0.95 * far * 240 + 0.05 * 0.06, 5) AS long_drift FROM b""")
def mu_sigma(spark, sf_dir):
    """Daily and annual mean and deviation (240 days), and drifts of recent and long windows shrunk to the risk-free rate."""
    x = returns(spark, sf_dir).where("lr IS NOT NULL").select("*", _newest("k"))
    tail = lambda n: F.avg(F.when(F.col("k") <= n, F.col("lr")))
    x = x.groupBy("symbol").agg(F.avg("lr").alias("mu"), F.stddev_samp("lr").alias("sigma"), tail(126).alias("recent"), tail(756).alias("far"))
    drift = lambda c: _r(0.95 * F.col(c) * 240 + 0.05 * 0.06, 5)
    return x.select("symbol", _r("mu").alias("mu_daily"), _r("sigma").alias("sigma_daily"), _r(F.col("mu") * 240, 5).alias("mu_annual"), _r(F.col("sigma") * math.sqrt(240), 5).alias("sigma_annual"), drift("recent").alias("recent_drift"), drift("far").alias("long_drift"))


@query(f"""WITH {BARS}, {LR}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM lr WHERE lr IS NOT NULL),
b AS (SELECT symbol, lr, lag(lr) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM a WHERE k <= 21)
SELECT symbol, round(coalesce(corr(lr, prev), 0), 6) AS autocorr21 FROM b GROUP BY symbol""")
def autocorr(spark, sf_dir):
    """Lag-one correlation inside the last 21 returns."""
    x = returns(spark, sf_dir).where("lr IS NOT NULL").select("*", _newest("k")).where("k <= 21").withColumn("prev", F.lag("lr").over(w.W))
    return x.groupBy("symbol").agg(_r(F.coalesce(F.corr("lr", "prev"), F.lit(0.0))).alias("autocorr21"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, avg(high - low) / avg(close) AS spread, avg(CASE WHEN volume <= 0 THEN 1.0 ELSE 0.0 END) AS zero_ratio, count(*) AS n FROM bars GROUP BY symbol),
{LR}, v AS (SELECT symbol, coalesce(stddev_samp(lr) * sqrt(252), 0.05) AS vol FROM lr GROUP BY symbol),
k AS (SELECT symbol, close, avg(close) OVER {d.w(200)} AS ma, first_value(close) OVER {d.w(200)} AS f, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn, count(*) OVER {d.w(200)} AS n200 FROM bars),
u AS (SELECT symbol, avg(volume) AS recent_volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) WHERE rn <= 50 GROUP BY symbol)
SELECT symbol, round(spread, 6) AS spread, round(zero_ratio, 6) AS zero_ratio, round(recent_volume, 4) AS recent_volume, round(vol, 6) AS vol,
    CASE WHEN zero_ratio > 0.5 THEN 'THIN_STOCK' WHEN round(vol, 9) >= 0.35 THEN 'LIQUID_STOCK' WHEN round(vol, 9) >= 0.18 THEN 'EM_INDEX' ELSE 'LIQUID_STOCK' END AS asset_class,
    CASE WHEN n200 < 200 THEN 'neutral' WHEN close > ma AND close > f THEN 'bull' WHEN close < ma AND close < f THEN 'bear' ELSE 'neutral' END AS regime
FROM a JOIN v USING (symbol) JOIN k USING (symbol) JOIN u USING (symbol) WHERE rn = 1""")
def asset_class(spark, sf_dir):
    """Liquidity figures, volatility class and trend regime of each symbol."""
    x = returns(spark, sf_dir).select("*", _newest("rn"), F.avg("close").over(w.frame(200)).alias("ma"), F.first("close").over(w.frame(200)).alias("f"), F.count("*").over(w.frame(200)).alias("n200"))
    last = lambda c: F.max_by(c, "date")
    x = x.groupBy("symbol").agg(
        (F.avg(F.col("high") - F.col("low")) / F.avg("close")).alias("spread"), F.avg(F.when(F.col("volume") <= 0, 1.0).otherwise(0.0)).alias("zero_ratio"), F.avg(F.when(F.col("rn") <= 50, F.col("volume"))).alias("recent_volume"),
        F.coalesce(F.stddev_samp("lr") * math.sqrt(252), F.lit(0.05)).alias("vol"), last("close").alias("c"), last("ma").alias("ma"), last("f").alias("f"), last("n200").alias("n200"),
    )
    kind = F.when(F.col("zero_ratio") > 0.5, "THIN_STOCK").when(_r("vol", 9) >= 0.35, "LIQUID_STOCK").when(_r("vol", 9) >= 0.18, "EM_INDEX").otherwise("LIQUID_STOCK")
    regime = F.when(F.col("n200") < 200, "neutral").when((F.col("c") > F.col("ma")) & (F.col("c") > F.col("f")), "bull").when((F.col("c") < F.col("ma")) & (F.col("c") < F.col("f")), "bear").otherwise("neutral")
    return x.select("symbol", _r("spread").alias("spread"), _r("zero_ratio").alias("zero_ratio"), _r("recent_volume", 4).alias("recent_volume"), _r("vol").alias("vol"), kind.alias("asset_class"), regime.alias("regime"))


@query(f"""WITH {BARS}, a AS (SELECT *, close / max(close) OVER {d.w()} - 1 AS dd FROM bars), b AS (SELECT *, sum(CASE WHEN dd < 0 THEN 0 ELSE 1 END) OVER {d.w()} AS isl FROM a),
c AS (SELECT symbol, isl, count(*) AS run FROM b WHERE dd < 0 GROUP BY symbol, isl)
SELECT a.symbol, round(min(dd), 6) AS max_drawdown, round(arg_max(dd, date), 6) AS current_drawdown, coalesce(any_value(r.longest), 0)::BIGINT AS longest,
    arg_min(date, dd * 1e9 + epoch(date) / 1e12) AS trough FROM a LEFT JOIN (SELECT symbol, max(run) AS longest FROM c GROUP BY symbol) r ON r.symbol = a.symbol GROUP BY a.symbol""")
def drawdowns(spark, sf_dir):
    """Deepest and present drawdown, the longest run below a peak, and the date of the trough."""
    x = bars_orders(spark, sf_dir).withColumn("dd", F.col("close") / F.max("close").over(w.PAST) - 1)
    x = x.withColumn("isl", F.sum(F.when(F.col("dd") < 0, 0).otherwise(1)).over(w.PAST))
    run = x.groupBy("symbol", "isl").agg(F.sum(F.when(F.col("dd") < 0, 1).otherwise(0)).alias("run"), F.min("dd").alias("m"), F.min_by("date", F.struct("dd", "date")).alias("at"), F.max_by("dd", "date").alias("now"), F.max("date").alias("last"))
    return run.groupBy("symbol").agg(_r(F.min("m")).alias("max_drawdown"), _r(F.max_by("now", "last")).alias("current_drawdown"), F.max("run").alias("longest"), F.min_by("at", F.struct("m", "at")).alias("trough"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, close / max(close) OVER {d.w()} - 1 AS dd, max(close) OVER {d.w()} AS peak, close FROM bars),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dd, date) AS k FROM a)
SELECT b.symbol, b.k, b.date AS trough, round(b.dd, 6) AS drawdown, (SELECT max(x.date) FROM bars x WHERE x.symbol = b.symbol AND x.date <= b.date AND x.close >= b.peak) AS peak_date FROM b WHERE k <= 3""")
def drawdown_windows(spark, sf_dir):
    """The three deepest drawdowns with the latest date of their peak."""
    x = bars_orders(spark, sf_dir).withColumn("peak", F.max("close").over(w.PAST))
    x = x.withColumns({"dd": F.col("close") / F.col("peak") - 1, "peak_date": F.last(F.when(F.col("close") == F.col("peak"), F.col("date")), ignorenulls=True).over(w.PAST)})
    x = x.withColumn("k", F.row_number().over(w.BY.orderBy("dd", "date"))).where("k <= 3")
    return x.select("symbol", F.col("k").cast("long").alias("k"), F.col("date").alias("trough"), _r("dd").alias("drawdown"), "peak_date")


@query(f"""WITH {BARS}, {LR}, a AS (SELECT symbol, date, exp(lr) - 1 AS r, exp(sum(lr) OVER {d.w()}) AS eq FROM lr WHERE lr IS NOT NULL), b AS (SELECT *, eq / max(eq) OVER {d.w()} - 1 AS dd FROM a)
SELECT symbol, round(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 6) AS semi_vol, round(min(dd), 6) AS max_drawdown, round(avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r END)), 0) * sqrt(240), 5) AS sortino,
    round(100 * arg_max(eq, date), 4) AS equity_index FROM b GROUP BY symbol""")
def downside_stats(spark, sf_dir):
    """Semi-volatility of losses, drawdown of the compounded curve, Sortino ratio, final index level."""
    x = returns(spark, sf_dir).where("lr IS NOT NULL").select("symbol", "date", (F.exp("lr") - 1).alias("r"), F.exp(F.sum("lr").over(w.PAST)).alias("eq"))
    x = x.withColumn("dd", F.col("eq") / F.max("eq").over(w.PAST) - 1)
    semi = F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r"))))
    return x.groupBy("symbol").agg(_r(semi).alias("semi_vol"), _r(F.min("dd")).alias("max_drawdown"), _r(F.avg("r") / F.nullif(semi, F.lit(0.0)) * math.sqrt(240), 5).alias("sortino"), _r(100 * F.max_by("eq", "date"), 4).alias("equity_index"))


MARKET = f"mk AS (SELECT date, avg(close) AS m FROM bars GROUP BY date), mr AS (SELECT date, ln(m / lag(m) OVER (ORDER BY date)) AS mr FROM mk)"


def market_returns(bars):
    """Log returns of the equal-weight mean close. One row a date, so the unpartitioned window is over calendar days only."""
    m = bars.groupBy("date").agg(F.avg("close").alias("m"))
    return m.select("date", F.ln(F.col("m") / F.lag("m").over(Window.orderBy("date"))).alias("mr"))


@query(f"""WITH {BARS}, {LR}, {MARKET}, a AS (SELECT symbol, date, lr, mr FROM lr JOIN mr USING (date) WHERE lr IS NOT NULL AND mr IS NOT NULL),
b AS (SELECT symbol, count(*) AS n, regr_slope(lr, mr) AS beta, regr_intercept(lr, mr) AS alpha, regr_r2(lr, mr) AS r2, avg(mr) AS am, avg(lr) AS al, var_samp(lr) AS vl FROM a GROUP BY symbol),
c AS (SELECT *, least(1.0, vl / (n * nullif(pow(al - am, 2), 0))) AS lam FROM b WHERE n >= 30)
SELECT symbol, n, round(beta, 6) AS beta, round(alpha, 6) AS alpha, round(r2, 6) AS r2, round(0.06 + beta * (am * 240 - 0.06), 5) AS capm_er,
    round(((1 - lam) * al + lam * am) * 240, 5) AS james_stein, round(beta * 100000, 2) AS hedge_notional FROM c""")
def beta_capm(spark, sf_dir):
    """Regression on the market, CAPM return, James-Stein drift (sample variance), and the hedge of 100,000."""
    bars = bars_orders(spark, sf_dir)
    x = bars.select("symbol", "date", w.log_return().alias("lr")).join(market_returns(bars), "date").where("lr IS NOT NULL AND mr IS NOT NULL")
    x = x.groupBy("symbol").agg(F.count("*").alias("n"), F.regr_slope("lr", "mr").alias("beta"), F.regr_intercept("lr", "mr").alias("alpha"), F.regr_r2("lr", "mr").alias("r2"), F.avg("mr").alias("am"), F.avg("lr").alias("al"), F.var_samp("lr").alias("vl")).where("n >= 30")
    lam = F.least(F.lit(1.0), F.col("vl") / (F.col("n") * F.nullif(F.pow(F.col("al") - F.col("am"), 2), F.lit(0.0))))
    return x.select("symbol", "n", _r("beta").alias("beta"), _r("alpha").alias("alpha"), _r("r2").alias("r2"), _r(0.06 + F.col("beta") * (F.col("am") * 240 - 0.06), 5).alias("capm_er"), _r(((1 - lam) * F.col("al") + lam * F.col("am")) * 240, 5).alias("james_stein"), _r(F.col("beta") * 100000, 2).alias("hedge_notional"))


@query(f"""WITH {BARS}, {LR}, {MARKET}, a AS (SELECT symbol, date, lr, mr FROM lr JOIN mr USING (date) WHERE lr IS NOT NULL AND mr IS NOT NULL), b AS (SELECT symbol, regr_slope(lr, mr) AS beta FROM a GROUP BY symbol)
SELECT symbol, date, round(lr - beta * mr, 6) AS hedged, round(sum(lr - beta * mr) OVER {d.w()}, 6) AS hedged_cum FROM a JOIN b USING (symbol)""")
def hedged_returns(spark, sf_dir):
    bars = bars_orders(spark, sf_dir)
    x = bars.select("symbol", "date", w.log_return().alias("lr")).join(market_returns(bars), "date").where("lr IS NOT NULL AND mr IS NOT NULL")
    x = x.withColumn("h", F.col("lr") - F.regr_slope("lr", "mr").over(w.BY) * F.col("mr"))
    return x.select("symbol", "date", _r("h").alias("hedged"), _r(F.sum("h").over(w.PAST)).alias("hedged_cum"))


@query(f"""WITH {BARS}, {LR}, a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM lr)
SELECT symbol, date, round(least(greatest(lr, -0.1), 0.1), 6) AS clipped, round(10000 * close / first_value(close) OVER (PARTITION BY symbol ORDER BY date), 4) AS buy_hold,
    round(stddev_samp(lr) OVER {d.w(60)} * sqrt(240), 6) AS vol60 FROM a WHERE lr IS NOT NULL""")
def clip_and_hold(spark, sf_dir):
    """Returns within the price limit, a buy-and-hold curve from the first return on, and the 60-bar annual volatility."""
    x = returns(spark, sf_dir).where("lr IS NOT NULL")
    hold = F.lit(10000.0) * F.col("close") / F.first("close").over(w.PAST)
    return x.select("symbol", "date", _r(F.least(F.greatest("lr", F.lit(-0.1)), F.lit(0.1))).alias("clipped"), _r(hold, 4).alias("buy_hold"), _r(F.stddev_samp("lr").over(w.frame(60)) * math.sqrt(240)).alias("vol60"))
