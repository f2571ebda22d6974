"""Indicators over daily bars: every query is one shuffle by symbol."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, scans, windows as w
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders


def _r(x, n=6):
    return F.round(x, n)


def _select(bars, **cols):
    return bars.select("symbol", "date", *[c.alias(k) for k, c in cols.items()])


def trend(bars, short: int = 20, long: int = 50):
    """Moving averages, returns, 20-bar volatility, the trend signal, the safety flag and the crossings."""
    x = bars.select("symbol", "date", "close", w.mean("close", short).alias("sma_short"), w.mean("close", long).alias("sma_long"), w.change("close").alias("ret"))
    x = x.withColumn("vol", w.std("ret", 20)).withColumn("signal", F.when((F.col("sma_short") > F.col("sma_long")) & (F.col("close") > F.col("sma_long")), 1).otherwise(0))
    step = F.col("signal") - F.lag("signal").over(w.W)
    return x.withColumns({"safe_to_enter": F.coalesce(F.col("vol") < 0.03, F.lit(False)), "golden_cross": F.coalesce(step == 1, F.lit(False)), "death_cross": F.coalesce(step == -1, F.lit(False))})


@query(f"""
WITH {BARS}, a AS (SELECT symbol, date, close, {d.mean('close', 20)} AS sma_short, {d.mean('close', 50)} AS sma_long, {d.change('close')} AS ret FROM bars),
b AS (SELECT *, {d.std('ret', 20)} AS vol, CASE WHEN sma_short > sma_long AND close > sma_long THEN 1 ELSE 0 END AS signal FROM a)
SELECT symbol, date, round(sma_short, 4) AS sma_short, round(sma_long, 4) AS sma_long, round(ret, 6) AS ret, round(vol, 6) AS vol, signal,
    coalesce(vol < 0.03, false) AS safe_to_enter, coalesce(signal - {d.lag('signal')} = 1, false) AS golden_cross, coalesce(signal - {d.lag('signal')} = -1, false) AS death_cross FROM b""")
def trend_features(spark, sf_dir):
    x = trend(bars_orders(spark, sf_dir))
    return x.select("symbol", "date", _r("sma_short", 4).alias("sma_short"), _r("sma_long", 4).alias("sma_long"), _r("ret").alias("ret"), _r("vol").alias("vol"), "signal", "safe_to_enter", "golden_cross", "death_cross")


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, close, volume, {d.log_return()} AS lr FROM bars)
SELECT symbol, date, round({d.zscore('close')}, 6) AS close_z, round({d.zscore('lr', 126)}, 6) AS ret_z, round({d.zscore('volume', 252)}, 6) AS volume_z FROM a""")
def rolling_zscore(spark, sf_dir):
    x = bars_orders(spark, sf_dir).withColumn("lr", w.log_return())
    x = scans.zscores(x, {"close_z": ("close", 60), "ret_z": ("lr", 126), "volume_z": ("volume", 252)})
    return _select(x, close_z=_r("close_z"), ret_z=_r("ret_z"), volume_z=_r("volume_z"))


def momentum(x="ret", n: int = 20):
    """Annualised mean over deviation of returns."""
    return F.coalesce(w.mean(x, n) / F.nullif(w.std(x, n), F.lit(0.0)) * math.sqrt(252), F.lit(0.0))


def _mom(x, n):
    return f"coalesce(({d.mean(x, n)}) / nullif(({d.std(x, n)}), 0) * sqrt(252), 0.0)"


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, close, {d.change('close')} AS ret FROM bars),
b AS (SELECT *, {_mom('ret', 20)} AS m20, {_mom('ret', 10)} AS m10 FROM a)
SELECT symbol, date, round(m20, 5) AS m20, round(m10, 5) AS m10, round({d.zscore('m20')}, 5) AS m20_z FROM b""")
def vol_adj_momentum(spark, sf_dir):
    x = bars_orders(spark, sf_dir).withColumn("ret", w.change("close"))
    x = x.withColumns({"m20": momentum("ret", 20), "m10": momentum("ret", 10)})
    x = scans.zscores(x, {"m20_z": ("m20", 60)})
    return _select(x, m20=_r("m20", 5), m10=_r("m10", 5), m20_z=_r("m20_z", 5))


def squeeze(p="close"):
    """Width of the 20-bar two-deviation band over its middle."""
    return w.ratio(w.std(p, 20) * 4, w.mean(p, 20))


@query(f"""WITH {BARS}, a AS (SELECT *, 4 * ({d.std('close', 20)}) / nullif(({d.mean('close', 20)}), 0) AS width FROM bars)
SELECT symbol, date, round(width, 6) AS width, round({d.zscore('width', 126)}, 5) AS width_z FROM a""")
def bb_squeeze(spark, sf_dir):
    x = scans.zscores(bars_orders(spark, sf_dir).withColumn("width", squeeze()), {"width_z": ("width", 126)})
    return _select(x, width=_r("width"), width_z=_r("width_z", 5))


def reversion(bars, n: int = 30):
    """Distance from the mean, place in the band and in the 400-bar range, distance from the 200-bar mean."""
    m, s = w.mean("close", n), w.std("close", n)
    x = scans.slide(scans.slide(bars, 400, ("close",), extremes=True), 200, ("close",))
    low, high, m200 = F.col("close_400.l_x"), F.col("close_400.g_x"), scans.mean_of("close_200", 200)
    x = x.withColumns({"dist": w.ratio(F.col("close") - m, m), "dist200": w.ratio(F.col("close") - m200, m200), "place": w.ratio(F.col("close") - (m - 2 * s), 4 * s), "range_pos": w.ratio(F.col("close") - low, high - low)})
    half = lambda c: F.coalesce(w.clamp(F.col(c), 0.0, 1.0), F.lit(0.5))
    x = x.withColumns({"bb_position": half("place"), "price_range_pos": half("range_pos")}).drop("close_400", "close_200")
    return scans.zscores(x, {"dist_ma_z": ("dist", 60), "dist_sma200_z": ("dist200", 252)})


_M30, _S30 = f"({d.mean('close', 30)})", f"({d.std('close', 30)})"


@query(f"""WITH {BARS}, a AS (SELECT *, (close - {_M30}) / nullif({_M30}, 0) AS dist, (close - ({d.mean('close', 200)})) / nullif(({d.mean('close', 200)}), 0) AS dist200,
    (close - ({_M30} - 2 * {_S30})) / nullif(4 * {_S30}, 0) AS place, (close - min(close) OVER {d.w(400)}) / nullif(max(close) OVER {d.w(400)} - min(close) OVER {d.w(400)}, 0) AS range_pos FROM bars)
SELECT symbol, date, round({d.zscore('dist')}, 5) AS dist_ma_z, round(coalesce({d.clamp('place', 0, 1)}, 0.5), 5) AS bb_position,
    round(coalesce({d.clamp('range_pos', 0, 1)}, 0.5), 5) AS price_range_pos, round({d.zscore('dist200', 252)}, 5) AS dist_sma200_z FROM a""")
def mean_reversion(spark, sf_dir):
    x = reversion(bars_orders(spark, sf_dir))
    return _select(x, **{c: _r(c, 5) for c in ("dist_ma_z", "bb_position", "price_range_pos", "dist_sma200_z")})


def rsi(bars, n: int = 14):
    """Relative strength from exponential gains and losses; 50 where there is no loss."""
    step = F.col("close") - F.lag("close").over(w.W)
    x = bars.withColumns({"up": F.when(step.isNotNull(), F.greatest(step, F.lit(0.0))), "down": F.when(step.isNotNull(), F.greatest(-step, F.lit(0.0)))})
    x = scans.ewm(x, {"gain": "up", "loss": "down"}, 1 / n)
    return x.withColumn("rsi", F.coalesce(F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.col("gain") / F.nullif("loss", F.lit(0.0))), F.lit(50.0))).drop("up", "down", "gain", "loss")


def true_range(prev):
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr(bars, span: int = 14):
    """Exponential mean (by span) of the true range."""
    x = bars.withColumn("tr", true_range(F.lag("close").over(w.W)))
    return scans.ewm(x, {"atr": "tr"}, 2 / (span + 1)).drop("tr")


_TR = "greatest(high - low, abs(high - prev), abs(low - prev))"


@query(f"""WITH {BARS}, a AS (SELECT *, close - {d.lag('close')} AS step, {d.lag('close')} AS prev FROM bars),
b AS (SELECT *, greatest(step, 0.0) AS u0, greatest(-step, 0.0) AS d0, {_TR} AS tr FROM a),
c AS (SELECT *, CASE WHEN step IS NOT NULL THEN u0 END AS up, CASE WHEN step IS NOT NULL THEN d0 END AS down FROM b),
e AS (SELECT symbol, date, {d.ewm('up', 1 / 14)} AS gain, {d.ewm('down', 1 / 14)} AS loss, {d.ewm('tr', 2 / 15)} AS atr FROM c)
SELECT symbol, date, round(coalesce(100.0 - 100.0 / (1.0 + gain / nullif(loss, 0)), 50.0), 6) AS rsi, round(atr, 4) AS atr FROM e""")
def rsi_atr(spark, sf_dir):
    return _select(atr(rsi(bars_orders(spark, sf_dir))), rsi=_r("rsi"), atr=_r("atr", 4))


def adx(bars, n: int = 14):
    """Directional movement index: exponential directional moves over the mean true range, averaged over n bars."""
    x = bars.withColumns({"tr": true_range(F.lag("close").over(w.W)), "u": F.col("high") - F.lag("high").over(w.W), "v": F.lag("low").over(w.W) - F.col("low")})
    plus = F.when((F.col("u") > F.col("v")) & (F.col("u") > 0), F.col("u")).otherwise(0.0)
    minus = F.when((F.col("v") > F.col("u")) & (F.col("v") > 0), F.col("v")).otherwise(0.0)
    x = x.withColumns({"pm": plus, "mm": minus, "range": F.nullif(w.mean("tr", n), F.lit(0.0))})
    x = scans.ewm(x, {"pe": "pm", "me": "mm"}, 1 / n)
    x = x.withColumns({"pd": 100 * F.col("pe") / F.col("range"), "md": 100 * F.col("me") / F.col("range")})
    total = F.col("pd") + F.col("md")
    x = x.withColumn("dx", 100 * F.abs(F.col("pd") - F.col("md")) / F.when(total == 0, F.lit(1.0)).otherwise(total))
    return x.withColumn("adx", F.coalesce(w.mean("dx", n), F.lit(0.0))).drop("tr", "u", "v", "pm", "mm", "range", "pe", "me", "pd", "md", "dx")


@query(f"""WITH {BARS}, a AS (SELECT *, {d.lag('close')} AS prev, high - {d.lag('high')} AS u, {d.lag('low')} - low AS v FROM bars),
b AS (SELECT *, {_TR} AS tr, CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END AS pm, CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END AS mm FROM a),
c AS (SELECT *, nullif(({d.mean('tr', 14)}), 0) AS r, {d.ewm('pm', 1 / 14)} AS pe, {d.ewm('mm', 1 / 14)} AS me FROM b),
e AS (SELECT *, 100 * pe / r AS pd, 100 * me / r AS md FROM c),
f AS (SELECT *, 100 * abs(pd - md) / (CASE WHEN pd + md = 0 THEN 1.0 ELSE pd + md END) AS dx FROM e)
SELECT symbol, date, round(coalesce({d.mean('dx', 14)}, 0.0), 5) AS adx FROM f""")
def adx_structure(spark, sf_dir):
    return _select(adx(bars_orders(spark, sf_dir)), adx=_r("adx", 5))


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, {d.log_return()} AS lr FROM bars), v AS (SELECT symbol, var_samp(lr) AS seed FROM a GROUP BY symbol),
b AS (SELECT symbol, date, lr, count(lr) OVER (PARTITION BY symbol ORDER BY date) AS k FROM a WHERE lr IS NOT NULL),
c AS (SELECT symbol, date, list_reduce(list_prepend(seed, list(lr * lr) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 699 PRECEDING AND CURRENT ROW)), lambda acc, x: 0.94 * acc + 0.06 * x) AS var FROM b JOIN v USING (symbol))
SELECT symbol, date, round(sqrt(var), 6) AS ewma_vol FROM c""")
def ewma_vol(spark, sf_dir):
    """Exponential volatility from the full-sample variance."""
    x = bars_orders(spark, sf_dir).withColumn("lr", w.log_return()).where("lr IS NOT NULL")
    x = x.withColumns({"seed": F.var_samp("lr").over(w.BY), "square": 0.06 * F.col("lr") * F.col("lr")})
    return _select(scans.decayed(x, {"var": "square"}, 0.94, start="seed"), ewma_vol=_r(F.sqrt("var")))


_SMF_DEPTH = 400


@query(f"""WITH {BARS}, a AS (SELECT *, {d.lag('close')} AS prev FROM bars),
b AS (SELECT *, greatest(high, prev) AS th, least(low, prev) AS tl FROM a),
c AS (SELECT *, coalesce((2 * close - th - tl) / nullif(th - tl, 0), 0.0) * volume AS adv FROM b),
e AS (SELECT symbol, date, list(adv) OVER {d.w(_SMF_DEPTH)} AS av, list(volume) OVER {d.w(_SMF_DEPTH)} AS vv, count(*) OVER {d.w()} AS k FROM c),
f AS (SELECT *, list_sum([av[i] * pow(1 - 2.0 / 21, len(av) - i) FOR i IN range(1, len(av) + 1)]) AS num, list_sum([vv[i] * pow(1 - 2.0 / 21, len(vv) - i) FOR i IN range(1, len(vv) + 1)]) AS den FROM e)
SELECT symbol, date, round(coalesce(CASE WHEN k >= 20 THEN num / nullif(den, 0) END, 0.0), 6) AS smart_money FROM f""")
def smart_money(spark, sf_dir):
    """Weighted place of the close in the true range by volume: two exponential sums (span 20) and their ratio."""
    return _select(money_flow(bars_orders(spark, sf_dir)), smart_money=_r("smart_money"))


def money_flow(bars):
    prev = F.lag("close").over(w.W)
    x = bars.withColumns({"_th": F.greatest("high", prev), "_tl": F.least("low", prev)})
    place = w.ratio(2 * F.col("close") - F.col("_th") - F.col("_tl"), F.col("_th") - F.col("_tl"))
    x = x.withColumn("_adv", F.coalesce(place, F.lit(0.0)) * F.col("volume"))
    x = scans.decayed(x, {"_flow": "_adv"}, 1 - 2 / 21)
    x = scans.decayed(x, {"_turn": "volume"}, 1 - 2 / 21)
    flow = F.when(F.count("*").over(w.PAST) >= 20, w.ratio(F.col("_flow"), F.col("_turn")))
    return x.withColumn("smart_money", F.coalesce(flow, F.lit(0.0))).drop("_th", "_tl", "_adv", "_flow", "_turn")


def efficiency(p="close", n: int = 20):
    """Net move over the path's length."""
    step = F.abs(F.col(p) - F.lag(p).over(w.W))
    return step, lambda s: F.coalesce(w.ratio(F.abs(F.col(p) - F.lag(p, n).over(w.W)), w.roll(F.sum, s, n)), F.lit(0.0))


@query(f"""WITH {BARS}, a AS (SELECT *, abs(close - {d.lag('close')}) AS step, abs({d.change('close')}) / nullif(ln(CASE WHEN volume = 0 THEN 1 ELSE volume END), 0) AS impact, pow(ln(high / low), 2) / (4 * ln(2)) AS hl FROM bars)
SELECT symbol, date, round(coalesce(abs(close - {d.lag('close', 20)}) / nullif(({d.roll('sum', 'step', 20)}), 0), 0.0), 6) AS efficiency,
    round(avg(impact) OVER {d.w(20)}, 6) AS kyle_lambda, round(sqrt({d.mean('hl', 20)}), 6) AS parkinson FROM a""")
def efficiency_kyle_parkinson(spark, sf_dir):
    """Efficiency ratio, price impact of volume (days of one trade say nothing and are skipped), high-low volatility."""
    step, ratio = efficiency()
    impact = F.abs(w.change("close")) / F.nullif(F.ln(F.when(F.col("volume") == 0, F.lit(1.0)).otherwise(F.col("volume"))), F.lit(0.0))
    x = bars_orders(spark, sf_dir).withColumns({"step": step, "impact": impact, "hl": F.pow(F.ln(F.col("high") / F.col("low")), 2) / (4 * math.log(2))})
    return _select(x, efficiency=_r(ratio("step")), kyle_lambda=_r(F.avg("impact").over(w.frame(20))), parkinson=_r(F.sqrt(w.mean("hl", 20))))


def entropy(bars, col: str, n: int, bins: int = 50):
    """bars with the entropy of the histogram densities of the n values before each bar; missing ones take the next one, or 0."""
    x = bars.withColumn("_x", F.collect_list(col).over(w.W.rowsBetween(-n, -1)))
    x = x.withColumns({"_lo": F.array_min("_x"), "_wd": (F.array_max("_x") - F.array_min("_x")) / bins})
    place = F.transform("_x", lambda v: F.least(F.floor(F.round((v - F.col("_lo")) / F.col("_wd"), 9)), F.lit(bins - 1)))
    x = x.withColumn("_bin", F.when((F.size("_x") == n) & (F.col("_wd") > 0), place))
    dens = F.transform(F.array_distinct("_bin"), lambda b: F.size(F.filter("_bin", lambda v: v == b)) / F.lit(float(n)) / F.col("_wd"))
    x = x.withColumn("_ent", F.when(F.col("_bin").isNotNull(), -F.aggregate(dens, F.lit(0.0), lambda acc, v: acc + v * F.ln(v))))
    return x.withColumn("entropy", F.coalesce(w.bfill("_ent"), F.lit(0.0))).drop("_x", "_lo", "_wd", "_bin", "_ent")


def entropy_sql(source: str, col: str, n: int, bins: int = 50) -> str:
    """The common table expressions e1 .. e6 of the same over `source`; e6 has symbol, date and entropy."""
    return f"""e1 AS (SELECT symbol, date, list_filter(list({col}) OVER ({d.OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), lambda v: v IS NOT NULL) AS x FROM {source}),
e2 AS (SELECT symbol, date, x, list_min(x) AS lo, (list_max(x) - list_min(x)) / {bins} AS wd FROM e1 WHERE len(x) = {n}),
e3 AS (SELECT symbol, date, wd, unnest([least(floor(round((v - lo) / wd, 9)), {bins - 1}) FOR v IN x]) AS bin FROM e2 WHERE wd > 0),
e4 AS (SELECT symbol, date, bin, count(*) / {float(n)} / any_value(wd) AS dens FROM e3 GROUP BY symbol, date, bin),
e5 AS (SELECT symbol, date, -sum(dens * ln(dens)) AS ent FROM e4 GROUP BY symbol, date),
e6 AS (SELECT symbol, date, coalesce({d.bfill("ent")}, 0.0) AS entropy FROM {source} LEFT JOIN e5 USING (symbol, date))"""


@query(f"""WITH {BARS}, r AS (SELECT symbol, date, {d.log_return()} AS lr FROM bars), {entropy_sql("r", "lr", 20)}
SELECT symbol, date, round(entropy, 3) AS entropy FROM e6""")
def rolling_entropy(spark, sf_dir):
    """Entropy of the histogram densities (50 bins) of the 20 returns before the bar."""
    x = entropy(bars_orders(spark, sf_dir).withColumn("lr", w.log_return()), "lr", 20)
    return _select(x, entropy=_r("entropy", 3))


def ffd_weights(order: float, least: float = 1e-4) -> list[float]:
    """Weights of fixed-width fractional differences, newest first, until one is below `least`."""
    out = [1.0]
    while abs(nxt := -out[-1] * (order - len(out) + 1) / len(out)) >= least:
        out.append(nxt)
    return out


_FFD = ffd_weights(0.4)


def fractional(lp: str = "lp", weights: list[float] = _FFD):
    """Weighted sum of the last values, NULL until there is one for each weight."""
    n = len(weights)
    products = F.zip_with(F.collect_list(lp).over(w.frame(n)), F.array(*map(F.lit, reversed(weights))), lambda x, k: x * k)
    return F.when(F.count(lp).over(w.frame(n)) >= n, F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v))


def fractional_sql(lp: str = "lp", weights: list[float] = _FFD) -> str:
    n = len(weights)
    return f"CASE WHEN count({lp}) OVER {d.w(n)} >= {n} THEN list_dot_product(list({lp}) OVER {d.w(n)}, {[float(x) for x in reversed(weights)]}) END"


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, ln(close) AS lp FROM bars) SELECT symbol, date, round({fractional_sql()}, 6) AS frac_diff FROM a""")
def frac_diff(spark, sf_dir):
    """Fixed-width fractional difference of order 0.4 of the log price, with all weights of 1e-4 and more."""
    x = bars_orders(spark, sf_dir).withColumn("lp", F.ln("close"))
    return _select(x, frac_diff=_r(fractional()))


def fractional_own(x, orders, lp: str = "lp", least: float = 1e-4):
    """x with frac_diff by each symbol's own order, from a table (symbol, d); d of 0 leaves the value, symbols without one get NULL.

    Orders come from a short grid, so there is a row of weights for each distinct one; they are joined to the symbols.
    """
    grid = [r.d for r in orders.select("d").where("d IS NOT NULL").distinct().collect()]
    weights = x.sparkSession.createDataFrame([(d, [float(v) for v in reversed(ffd_weights(d, least))]) for d in grid], "d double, _weights array<double>")
    x = x.join(orders.join(weights, "d").select("symbol", "_weights"), "symbol", "left")
    widest = max((len(ffd_weights(d, least)) for d in grid), default=1)
    seen = F.collect_list(lp).over(w.frame(widest))
    last = F.slice("_seen", F.size("_seen") - F.size("_weights") + 1, F.size("_weights"))
    x = x.withColumn("_seen", seen)
    total = F.aggregate(F.zip_with(last, "_weights", lambda v, k: v * k), F.lit(0.0), lambda acc, v: acc + v)
    return x.withColumn("frac_diff", F.when((F.size("_seen") >= F.size("_weights")) & F.col(lp).isNotNull(), total)).drop("_seen", "_weights")


#: Orders by the last digit of a symbol's number, a stand-in for searched ones that SQL can follow.
_ORDERS = (0.3, 0.45, 0.6)


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, ln(close) AS lp, regexp_extract(symbol, '[0-9]+$')::INT % {len(_ORDERS)} AS k FROM bars)
SELECT symbol, date, round(CASE k {" ".join(f"WHEN {k} THEN {fractional_sql('lp', ffd_weights(o))}" for k, o in enumerate(_ORDERS))} END, 6) AS frac_diff FROM a""")
def frac_diff_own(spark, sf_dir):
    """Fractional differences of each symbol's own order."""
    x = bars_orders(spark, sf_dir).withColumn("lp", F.ln("close"))
    number = F.regexp_extract("symbol", "[0-9]+$", 0).cast("int") % len(_ORDERS)
    orders = x.select("symbol").distinct().select("symbol", F.element_at(F.array(*map(F.lit, _ORDERS)), number + 1).alias("d"))
    return _select(fractional_own(x, orders), frac_diff=_r("frac_diff"))


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, {d.log_return()} AS lr FROM bars), b AS (SELECT *, {d.lag('lr')} AS prev FROM a)
SELECT symbol, date, round({d.roll('skewness', 'lr', 60)}, 5) AS skew60, round({d.roll('kurtosis', 'lr', 60)}, 4) AS kurt60,
    round(CASE WHEN count(lr) OVER {d.w(60)} >= 60 THEN corr(lr, prev) OVER {d.w(59)} END, 5) AS autocorr60 FROM b""")
def rolling_moments(spark, sf_dir):
    """Bias-corrected skewness and kurtosis, and lag-one autocorrelation inside the window."""
    x = bars_orders(spark, sf_dir).withColumn("lr", w.log_return()).withColumn("prev", F.lag("lr").over(w.W))
    auto = F.when(F.count("lr").over(w.frame(60)) >= 60, F.corr("lr", "prev").over(w.frame(59)))
    return _select(x, skew60=_r(w.skewness("lr", 60), 5), kurt60=_r(w.kurtosis("lr", 60), 4), autocorr60=_r(auto, 5))


@query(f"""WITH {BARS}, s AS (SELECT sector, date, avg(close) AS bench FROM bars GROUP BY 1, 2),
a AS (SELECT symbol, date, {d.log_return()} AS lr, ln(bench / lag(bench) OVER (PARTITION BY symbol ORDER BY date)) AS br FROM bars JOIN s USING (sector, date))
SELECT symbol, date, round({d.beta('lr', 'br', 126)}, 5) AS beta126, round({d.pair('corr', 'lr', 'br', 126)}, 5) AS corr126 FROM a""")
def rolling_beta_corr(spark, sf_dir):
    bars = bars_orders(spark, sf_dir)
    bench = bars.groupBy("sector", "date").agg(F.avg("close").alias("bench"))
    x = bars.join(bench, ["sector", "date"]).withColumns({"lr": w.log_return(), "br": w.log_return("bench")})
    x = scans.slide(x, 126, pairs=(("lr", "br"),))
    return _select(x, beta126=_r(scans.beta_of("lr_br_126", 126), 5), corr126=_r(scans.corr_of("lr_br_126", 126), 5))


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, close, list(close) OVER {d.w(252)} AS x FROM bars)
SELECT symbol, date, round(CASE WHEN len(x) >= 20 THEN len(list_filter(x, lambda v: v <= close)) / len(x) END, 6) AS pct_rank FROM a""")
def rolling_pct_rank(spark, sf_dir):
    x = scans.rolling_rank(bars_orders(spark, sf_dir), "close", 252, 20, "pct_rank", ["symbol", "date"])
    return _select(x, pct_rank=_r("pct_rank"))


@query(f"""WITH {BARS}, a AS (SELECT *, {d.mean('close', 50)} AS ma FROM bars), b AS (SELECT *, ma - {d.lag('ma')} AS step FROM a)
SELECT symbol, date, round(close / ma - 1, 6) AS trend_strength, round(({d.mean('step', 5)}) / close, 6) AS trend_slope,
    round({d.lag('close')}, 2) AS lag1, round({d.lag('close', 5)}, 2) AS lag5, round({d.lag('close', 21)}, 2) AS lag21 FROM b""")
def trend_slope_lags(spark, sf_dir):
    """Distance from and slope of the 50-bar mean, and lags 1, 5 and 21."""
    x = bars_orders(spark, sf_dir).withColumn("ma", w.mean("close", 50)).withColumn("step", F.col("ma") - F.lag("ma").over(w.W))
    lags = {f"lag{k}": _r(F.lag("close", k).over(w.W), 2) for k in (1, 5, 21)}
    return _select(x, trend_strength=_r(F.col("close") / F.col("ma") - 1), trend_slope=_r(w.mean("step", 5) / F.col("close")), **lags)


_XS = ["a1", "a2", "a3", "a4"]


@query(f"""WITH {BARS}, r AS (SELECT *, {d.change('close')} AS ret, {d.log_return()} AS lr FROM bars),
z AS (SELECT symbol, date, {d.zscore('close')} AS a1, {d.zscore('ret', 126)} AS a2, {d.zscore('volume')} AS a3, {d.zscore('high')} AS a4 FROM r),
m AS (SELECT *, (a1 + a2 + a3 + a4) / 4 AS mu FROM z), s AS (SELECT *, sqrt((pow(a1 - mu, 2) + pow(a2 - mu, 2) + pow(a3 - mu, 2) + pow(a4 - mu, 2)) / 3) AS sd FROM m)
SELECT symbol, date, {', '.join(f"round(CASE WHEN sd > 1e-9 THEN ({c} - mu) / sd ELSE 0 END, 4) AS x_{c}" for c in _XS)} FROM s""")
def xsec_normalize(spark, sf_dir):
    """Each row's factors in deviations from the row's own mean."""
    x = bars_orders(spark, sf_dir).withColumn("ret", w.change("close"))
    x = x.withColumns({"a1": w.zscore("close"), "a2": w.zscore("ret", 126), "a3": w.zscore("volume"), "a4": w.zscore("high")})
    x = x.withColumn("mu", sum(F.col(c) for c in _XS) / 4).withColumn("sd", F.sqrt(sum(F.pow(F.col(c) - F.col("mu"), 2) for c in _XS) / 3))
    return _select(x, **{f"x_{c}": _r(F.when(F.col("sd") > 1e-9, (F.col(c) - F.col("mu")) / F.col("sd")).otherwise(0.0), 4) for c in _XS})


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, lead(close, 20) OVER ({d.OVER}) / close - 1 AS fwd, close / {d.lag('close', 20)} - 1 AS rel FROM bars),
b AS (SELECT *, CASE WHEN rel IS NOT NULL THEN rank() OVER (PARTITION BY symbol, rel IS NULL ORDER BY rel) END AS rk, count(*) OVER (PARTITION BY symbol, rel) AS ties, count(rel) OVER (PARTITION BY symbol) AS n FROM a),
c AS (SELECT *, (rk + (ties - 1) / 2.0) / n AS pr FROM b)
SELECT symbol, date, round(fwd, 6) AS fwd_ret, round(pr, 6) AS pct_rank, CASE WHEN round(pr, 9) >= 0.8 THEN 1 WHEN round(pr, 9) <= 0.2 THEN 0 END AS sector_rank_label FROM c""")
def fwd_return_rank(spark, sf_dir):
    """Forward return, average percent rank over the whole history, and the outer quintiles as labels."""
    x = bars_orders(spark, sf_dir).withColumns({"fwd": F.lead("close", 20).over(w.W) / F.col("close") - 1, "rel": F.col("close") / F.lag("close", 20).over(w.W) - 1})
    rank = F.rank().over(Window.partitionBy("symbol", F.col("rel").isNull()).orderBy("rel"))
    ties = F.count("*").over(Window.partitionBy("symbol", "rel"))
    x = x.withColumn("pr", F.when(F.col("rel").isNotNull(), (rank + (ties - 1) / 2.0) / F.count("rel").over(w.BY)))
    return _select(x, fwd_ret=_r("fwd"), pct_rank=_r("pr"), sector_rank_label=F.when(_r("pr", 9) >= 0.8, 1).when(_r("pr", 9) <= 0.2, 0))


def triple_barrier(bars, horizon: int = 21, up: float = 1.25, down: float = 2.5):
    """First touch within the next bars: 1 above the upper barrier, 0 below the lower one, else missing."""
    x = bars.withColumn("lr", w.log_return()).withColumn("vol", F.coalesce(w.std("lr", 20), F.lit(0.02)) * math.sqrt(max(horizon, 1)))
    x = x.withColumns({"_hi": F.col("close") * (1 + up * F.col("vol")), "_lo": F.col("close") * (1 - down * F.col("vol")), "_left": F.row_number().over(w.BY.orderBy(F.desc("date")))})
    x = scans.first_touch(x, "close", "_hi", "_lo", horizon, "_touch", [*bars.columns, "vol", "_left"])
    return x.withColumn("target", F.when((F.col("_left") > horizon + 1) & (F.col("volume") > 0), F.col("_touch"))).drop("_touch", "_left")


@query(f"""WITH {BARS}, a AS (SELECT *, {d.log_return()} AS lr FROM bars), b AS (SELECT *, coalesce({d.std('lr', 20)}, 0.02) * sqrt(21) AS vol FROM a),
c AS (SELECT *, list(close) OVER ({d.OVER} ROWS BETWEEN 1 FOLLOWING AND 21 FOLLOWING) AS ahead, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM b),
e AS (SELECT *, coalesce(list_position([v >= close * (1 + 1.25 * vol) FOR v IN ahead], true), 0) AS up, coalesce(list_position([v <= close * (1 - 2.5 * vol) FOR v IN ahead], true), 0) AS dn FROM c)
SELECT symbol, date, round(vol, 6) AS vol, CASE WHEN rn > 22 AND volume > 0 THEN CASE WHEN up > 0 AND (dn = 0 OR up < dn) THEN 1.0 WHEN dn > 0 THEN 0.0 END END::DOUBLE AS target FROM e""")
def triple_barrier_labels(spark, sf_dir):
    return _select(triple_barrier(bars_orders(spark, sf_dir)), vol=_r("vol"), target=F.col("target"))


@query(f"""WITH {BARS}, a AS (SELECT *, {d.log_return()} AS lr FROM bars), b AS (SELECT *, coalesce({d.std('lr', 20)}, 0.02) * sqrt(250) AS vol FROM a),
c AS (SELECT *, list(close) OVER ({d.OVER} ROWS BETWEEN 1 FOLLOWING AND 250 FOLLOWING) AS ahead, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM b),
e AS (SELECT *, coalesce(list_position([v >= close * (1 + 0.125 * vol) FOR v IN ahead], true), 0) AS up, coalesce(list_position([v <= close * (1 - 0.0625 * vol) FOR v IN ahead], true), 0) AS dn FROM c)
SELECT symbol, date, CASE WHEN rn > 251 AND volume > 0 THEN CASE WHEN up > 0 AND (dn = 0 OR up < dn) THEN 1.0 WHEN dn > 0 THEN 0.0 END END::DOUBLE AS target FROM e""")
def barrier_year(spark, sf_dir):
    """Barriers of a year's horizon, near enough to be touched."""
    return _select(triple_barrier(bars_orders(spark, sf_dir), 250, 0.125, 0.0625), target=F.col("target"))


def drop_constant(x, columns: list[str], least: float = 1e-9):
    """x without the columns whose deviation is at most `least`; all of them where every one is constant."""
    sd = x.agg(*[F.stddev_samp(c).alias(c) for c in columns]).first()
    flat = [c for c in columns if sd[c] is None or sd[c] <= least]
    return x.drop(*flat) if len(flat) < len(columns) else x


@query(f"""WITH {BARS}, a AS (SELECT *, close - {d.lag('close')} AS step, {d.log_return()} AS lr FROM bars), b AS (SELECT *, greatest(step, 0.0) AS u0, greatest(-step, 0.0) AS d0 FROM a),
c AS (SELECT *, CASE WHEN step IS NOT NULL THEN u0 END AS up, CASE WHEN step IS NOT NULL THEN d0 END AS down FROM b), e AS (SELECT symbol, date, {d.ewm('up', 1 / 14)} AS gain, {d.ewm('down', 1 / 14)} AS loss, {d.std('lr', 20)} AS s20, {d.std('lr', 120)} AS s120 FROM c),
f AS (SELECT symbol, date, coalesce(100.0 - 100.0 / (1.0 + gain / nullif(loss, 0)), 50.0) AS rsi, least(greatest(s20 / nullif(s120, 0), 0), 5) AS vr, s20 / nullif(s120, 0) AS v0 FROM e),
g AS (SELECT symbol, round(arg_max(rsi, date), 9) AS rsi, round((SELECT arg_max(vr, date) FROM f x WHERE x.symbol = f.symbol AND v0 IS NOT NULL), 9) AS vr FROM f GROUP BY symbol)
SELECT symbol, round(rsi, 6) AS rsi, round(vr, 6) AS vol_ratio, CASE WHEN vr IS NULL THEN 'normal' WHEN rsi >= 55 AND vr >= 1.05 THEN 'trend' WHEN rsi <= 45 AND vr <= 0.95 THEN 'choppy' ELSE 'normal' END AS regime FROM g""")
def barrier_regime(spark, sf_dir):
    """Regime of the barriers from the last strength index and the last ratio of short to long volatility."""
    x = rsi(bars_orders(spark, sf_dir)).withColumn("lr", w.log_return())
    x = x.withColumn("vr", w.clamp(w.ratio(w.std("lr", 20), w.std("lr", 120)), 0.0, 5.0))
    x = x.groupBy("symbol").agg(_r(F.max_by("rsi", "date"), 9).alias("rsi"), _r(F.max_by("vr", F.when(F.col("vr").isNotNull(), F.col("date"))), 9).alias("vr"))
    kind = F.when(F.col("vr").isNull(), "normal").when((F.col("rsi") >= 55) & (F.col("vr") >= 1.05), "trend").when((F.col("rsi") <= 45) & (F.col("vr") <= 0.95), "choppy").otherwise("normal")
    return x.select("symbol", _r("rsi").alias("rsi"), _r("vr").alias("vol_ratio"), kind.alias("regime"))
