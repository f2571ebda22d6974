"""Sector benchmarks, sector-relative and macro features, data health and liquidity thresholds."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, scans, windows as w
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, MACRO, bars_orders, by_symbol, macro_yearly, table


#: Other symbols of a sector that stand for it.
PEERS = 8


def _r(x, n=6):
    return F.round(x, n)


def with_bench(bars):
    """bars with the mean close of the sector on each date, dealt by symbol."""
    return by_symbol(bars.withColumn("bench", F.avg("close").over(Window.partitionBy("sector", "date"))))


def benchmark(bars):
    """Mean close of a sector's symbols on each date, and the same without the symbol itself."""
    s = Window.partitionBy("sector", "date")
    return bars.withColumns({"bench": F.avg("close").over(s), "peers": (F.sum("close").over(s) - F.col("close")) / F.nullif(F.count("close").over(s) - 1, F.lit(0))})


@query(f"""WITH {BARS} SELECT symbol, date, round(avg(close) OVER (PARTITION BY sector, date), 4) AS bench, round((sum(close) OVER (PARTITION BY sector, date) - close) / nullif(count(close) OVER (PARTITION BY sector, date) - 1, 0), 4) AS peers FROM bars""")
def sector_benchmark(spark, sf_dir):
    return benchmark(bars_orders(spark, sf_dir)).select("symbol", "date", _r("bench", 4).alias("bench"), _r("peers", 4).alias("peers"))


@query(f"""WITH {BARS}, p AS (SELECT DISTINCT symbol, sector FROM bars), q AS (SELECT a.symbol, b.symbol AS peer, row_number() OVER (PARTITION BY a.symbol ORDER BY b.symbol) AS k FROM p a JOIN p b ON a.sector = b.sector AND a.symbol <> b.symbol)
SELECT q.symbol, x.date, round(avg(x.close), 4) AS bench, count(*) AS peers FROM q JOIN bars x ON x.symbol = q.peer WHERE k <= {PEERS} GROUP BY 1, 2""")
def leave_one_out(spark, sf_dir):
    """Mean close of the first PEERS other symbols of the sector."""
    bars = bars_orders(spark, sf_dir)
    p = bars.select("symbol", "sector").distinct()
    q = p.join(p.withColumnRenamed("symbol", "peer"), "sector").where("symbol <> peer")
    q = q.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy("peer"))).where(F.col("k") <= PEERS).select("symbol", "peer")
    x = bars.select(F.col("symbol").alias("peer"), "date", "close")
    return x.join(q, "peer").groupBy("symbol", "date").agg(_r(F.avg("close"), 4).alias("bench"), F.count("*").alias("peers"))


#: Bars of the forward return and of what is measured over the same time.
HORIZON = 21
SECTOR_COLUMNS = [
    "rel_strength_z", "spread_z", "vol_spread_z", "spread_pct_rank", "momentum_spread_z", "beta_raw", "corr_raw", "beta_z", "corr_z",
    "trend_interaction", "corr_interaction", "drawdown_z",
]


def sector_frame(x, horizon: int = HORIZON):
    """x (symbol, date, close, bench) with the SECTOR_COLUMNS under `sector_`; what is missing counts 0."""
    n, zero = max(horizon, 5), lambda c: F.coalesce(c, F.lit(0.0))

    def momentum(r):
        return zero(w.mean(r, n) / F.nullif(w.std(r, n), F.lit(0.0)) * F.sqrt(F.lit(252.0)))

    x = x.withColumns({"_ar": w.change("close"), "_br": w.change("bench"), "_rel": zero(w.ratio(F.col("close"), F.col("bench")) - 1)})
    x = x.withColumns({"_a0": zero(F.col("_ar")), "_b0": zero(F.col("_br"))})
    x = x.withColumns(
        {
            "_spread": zero(w.change("close", n) - w.change("bench", n)),
            "_vol": zero(w.std("_ar", 20) - w.std("_br", 20)),
            "_mom": momentum("_ar") - momentum("_br"),
            "_dd": F.col("close") / F.max("close").over(w.PAST) - F.col("bench") / F.max("bench").over(w.PAST),
        }
    )
    x = scans.slide(x, 126, pairs=(("_a0", "_b0"),))
    x = x.withColumns({"_beta": zero(scans.beta_of("_a0__b0_126", 126)), "_corr": zero(scans.corr_of("_a0__b0_126", 126))}).drop("_a0__b0_126")
    made = {"rel_strength_z": "_rel", "beta_z": "_beta", "corr_z": "_corr", "spread_z": "_spread", "vol_spread_z": "_vol", "momentum_spread_z": "_mom", "drawdown_z": "_dd"}
    x = scans.zscores(x, {f"sector_{k}": (v, 126) for k, v in made.items()})
    x = scans.rolling_rank(x, "_spread", 252, 20, "_rank", x.columns)
    made = {
        "spread_pct_rank": zero(F.col("_rank")),
        "beta_raw": F.col("_beta"),
        "corr_raw": F.col("_corr"),
        "trend_interaction": F.col("sector_beta_z") * F.col("sector_rel_strength_z"),
        "corr_interaction": F.col("sector_corr_z") * F.col("sector_rel_strength_z"),
    }
    return x.withColumns({f"sector_{k}": v for k, v in made.items()}).drop("_ar", "_br", "_rel", "_a0", "_b0", "_spread", "_vol", "_mom", "_dd", "_beta", "_corr", "_rank")


def sector_frame_sql(source: str, horizon: int = HORIZON) -> str:
    """The common table expressions s1 .. s5 of the same over `source`; s5 has symbol, date and the columns."""
    n = max(horizon, 5)

    def momentum(r):
        return f"coalesce(({d.mean(r, n)}) / nullif(({d.std(r, n)}), 0) * sqrt(252.0), 0.0)"

    return f"""s1 AS (SELECT symbol, date, close, bench, {d.change("close")} AS ar, {d.change("bench")} AS br, coalesce(close / nullif(bench, 0) - 1, 0.0) AS rel FROM {source}),
s2 AS (SELECT *, coalesce(ar, 0.0) AS a0, coalesce(br, 0.0) AS b0 FROM s1),
s3 AS (SELECT *, coalesce(({d.std("ar", 20)}) - ({d.std("br", 20)}), 0.0) AS volspread,
    {momentum("ar")} - {momentum("br")} AS mom, close / max(close) OVER {d.w()} - bench / max(bench) OVER {d.w()} AS ddspread,
    coalesce({d.beta("a0", "b0", 126)}, 0.0) AS beta, coalesce({d.pair("corr", "a0", "b0", 126)}, 0.0) AS co, list(spread) OVER {d.w(252)} AS seen FROM (SELECT *, coalesce(({d.change("close", n)}) - ({d.change("bench", n)}), 0.0) AS spread FROM s2)),
s4 AS (SELECT *, {d.zscore("rel", 126)} AS relz, {d.zscore("beta", 126)} AS betaz, {d.zscore("co", 126)} AS corrz FROM s3),
s5 AS (SELECT symbol, date, relz AS sector_rel_strength_z, {d.zscore("spread", 126)} AS sector_spread_z, {d.zscore("volspread", 126)} AS sector_vol_spread_z,
    coalesce(CASE WHEN len(seen) >= 20 THEN len(list_filter(seen, lambda v: v <= spread)) / len(seen) END, 0.0) AS sector_spread_pct_rank, {d.zscore("mom", 126)} AS sector_momentum_spread_z,
    beta AS sector_beta_raw, co AS sector_corr_raw, betaz AS sector_beta_z, corrz AS sector_corr_z, betaz * relz AS sector_trend_interaction, corrz * relz AS sector_corr_interaction,
    {d.zscore("ddspread", 126)} AS sector_drawdown_z FROM s4)"""


_BENCH = f"{BARS}, bb AS (SELECT *, avg(close) OVER (PARTITION BY sector, date) AS bench FROM bars)"


@query(f"""WITH {_BENCH}, {sector_frame_sql("bb")} SELECT symbol, date, {", ".join(f"round(sector_{c}, 4) AS sector_{c}" for c in SECTOR_COLUMNS)} FROM s5""")
def sector_features(spark, sf_dir):
    """All features of a symbol against its sector's mean close."""
    x = with_bench(bars_orders(spark, sf_dir))
    return sector_frame(x).select("symbol", "date", *[_r(f"sector_{c}", 4).alias(f"sector_{c}") for c in SECTOR_COLUMNS])


@query(f"""WITH {BARS}, s AS (SELECT *, avg(close) OVER (PARTITION BY sector, date) AS bench FROM bars), a AS (SELECT symbol, date, ({d.change('close', 63)}) - ({d.change('bench', 63)}) AS spread FROM s),
b AS (SELECT symbol, date, (spread - ({d.mean('spread', 252, 63)})) / nullif(({d.std('spread', 252, 63)}), 0) AS z FROM a), c AS (SELECT symbol, arg_max(z, date) AS z FROM b WHERE z IS NOT NULL GROUP BY symbol)
SELECT symbol, round(z, 6) AS z, round(0.5 + 0.2 * tanh(z), 6) AS probability, round(least(greatest(1 + z / 4, 0.5), 1.5), 6) AS size, round(least(1.0, abs(z) / 2), 6) AS confidence FROM c""")
def sector_signal(spark, sf_dir):
    """Signal of the 63-bar spread to the sector: probability, size and confidence from its last z-score."""
    x = with_bench(bars_orders(spark, sf_dir)).withColumn("spread", w.change("close", 63) - w.change("bench", 63))
    x = x.withColumn("z", (F.col("spread") - w.mean("spread", 252, 63)) / F.nullif(w.std("spread", 252, 63), F.lit(0.0))).where("z IS NOT NULL")
    x = x.groupBy("symbol").agg(F.max_by("z", "date").alias("z"))
    return x.select("symbol", _r("z").alias("z"), _r(0.5 + 0.2 * F.tanh("z")).alias("probability"), _r(F.least(F.greatest(1 + F.col("z") / 4, F.lit(0.5)), F.lit(1.5))).alias("size"), _r(F.least(F.lit(1.0), F.abs("z") / 2)).alias("confidence"))


def as_of(bars, macro):
    """Each bar with the last value dated on or before it, as column macro."""
    return by_symbol(scans.as_of(bars, macro.select("date", F.col("value").alias("macro")), [], "date", ["macro"]))


@query(f"""WITH {BARS}, {MACRO} SELECT bars.symbol, bars.date, round(macro.value, 4) AS macro FROM bars ASOF LEFT JOIN macro ON bars.date >= macro.date""")
def asof_macro(spark, sf_dir):
    return as_of(bars_orders(spark, sf_dir), macro_yearly(spark, sf_dir)).select("symbol", "date", _r("macro", 4).alias("macro"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS date FROM orders),
u AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_totalprice) AS price FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1, 2)
SELECT o.o_orderkey, CASE WHEN o.date - u.date <= 180 THEN u.price END AS price FROM o ASOF LEFT JOIN u ON o.o_custkey = u.o_custkey AND o.date >= u.date""")
def asof_by_key(spark, sf_dir):
    """Each order with the amount of its customer's last urgent order, at most 180 days old."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), "o_orderpriority")
    urgent = o.where(F.col("o_orderpriority").startswith("1")).select("o_custkey", "date", "price")
    return scans.as_of(o.select("o_orderkey", "o_custkey", "date"), urgent, ["o_custkey"], "date", ["price"], tolerance=180).select("o_orderkey", "price")


@query(f"""WITH {BARS}, {MACRO}, j AS (SELECT bars.symbol, bars.date, bars.close, macro.value AS m0 FROM bars ASOF LEFT JOIN macro ON bars.date >= macro.date),
f AS (SELECT *, coalesce(m0, {d.bfill('m0')}) AS m FROM j), a AS (SELECT symbol, date, m, {d.change('m', 5)} AS r5, {d.change('m', 20)} AS r20, {d.change('m')} AS mr, {d.change('close')} AS ar FROM f),
b AS (SELECT *, ({d.mean('mr', 60)}) / nullif(({d.std('mr', 60)}), 0) * sqrt(252) AS mom FROM a)
SELECT symbol, date, round({d.zscore('m', 252)}, 5) AS macro_z, round(r5, 6) AS return_5d, round(r20, 6) AS return_20d, round(coalesce(mom, 0), 5) AS momentum, round({d.beta('ar', 'mr', 126)}, 4) AS beta_raw FROM b""")
def macro_features(spark, sf_dir):
    """Features of the yearly macro series at bar dates; bars before its first value take that value."""
    x = as_of(bars_orders(spark, sf_dir), macro_yearly(spark, sf_dir))
    x = x.withColumn("m", F.coalesce("macro", w.bfill("macro")))
    x = x.withColumns({"r5": w.change("m", 5), "r20": w.change("m", 20), "mr": w.change("m"), "ar": w.change("close")})
    x = scans.zscores(scans.slide(scans.slide(x, 60, ("mr",)), 126, pairs=(("ar", "mr"),)), {"macro_z": ("m", 252)})
    mom = F.coalesce(scans.mean_of("mr_60", 60) / F.nullif(scans.std_of("mr_60", 60), F.lit(0.0)) * F.sqrt(F.lit(252.0)), F.lit(0.0))
    return x.select("symbol", "date", _r("macro_z", 5).alias("macro_z"), _r("r5").alias("return_5d"), _r("r20").alias("return_20d"), _r(mom, 5).alias("momentum"), _r(scans.beta_of("ar_mr_126", 126), 4).alias("beta_raw"))


def calendar(bars):
    """Sunday to Thursday dates between each symbol's first and last bar, left-joined to the bars."""
    span = bars.groupBy("symbol").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select("symbol", F.explode(F.sequence("a", "b")).alias("date")).where(F.dayofweek("date").between(1, 5))
    return by_symbol(days.join(bars.drop("sector"), ["symbol", "date"], "left"))


_CAL = f"""{BARS}, span AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol), days AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS date FROM span),
cal AS (SELECT symbol, date, close, volume, open, high, low FROM (SELECT * FROM days WHERE dayofweek(date) BETWEEN 0 AND 4) LEFT JOIN bars USING (symbol, date))"""


def scrub(x, col: str = "close", run: int = 3):
    """Islands of `run` and more flat steps (missing steps count as flat) are erased with their head, then filled."""
    x = x.withColumn("flat", F.coalesce(F.abs(F.col(col) - F.lag(col).over(w.W)) < 1e-8, F.lit(True)).cast("int"))
    x = x.withColumn("isl", F.sum(1 - F.col("flat")).over(w.PAST))
    bad = F.sum("flat").over(Window.partitionBy("symbol", "isl")) >= run
    return x.withColumn("scrubbed", F.when(~bad, F.col(col))).withColumn("filled", F.coalesce(w.ffill("scrubbed"), w.bfill("scrubbed")))


@query(f"""WITH {_CAL}, a AS (SELECT *, CASE WHEN abs(close - {d.lag('close')}) < 1e-8 OR close - {d.lag('close')} IS NULL THEN 1 ELSE 0 END AS flat FROM cal), b AS (SELECT *, sum(1 - flat) OVER {d.w()} AS isl FROM a),
c AS (SELECT *, CASE WHEN sum(flat) OVER (PARTITION BY symbol, isl) < 3 THEN close END AS scrubbed FROM b)
SELECT symbol, date, round(scrubbed, 2) AS scrubbed, round(coalesce({d.ffill('scrubbed')}, {d.bfill('scrubbed')}), 2) AS filled, coalesce(volume, 0.0) AS volume FROM c""")
def calendar_scrub(spark, sf_dir):
    """Bars on the trading calendar, with flat runs erased and gaps filled."""
    x = scrub(calendar(bars_orders(spark, sf_dir)))
    return x.select("symbol", "date", _r("scrubbed", 2).alias("scrubbed"), _r("filled", 2).alias("filled"), F.coalesce("volume", F.lit(0.0)).alias("volume"))


@query(f"""WITH {_CAL}, a AS (SELECT *, close - {d.lag('close')} AS step FROM cal),
h AS (SELECT symbol, count(close) AS trading_days, avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) AS missing, avg(CASE WHEN step IS NOT NULL THEN CASE WHEN abs(step) < 1e-8 THEN 1.0 ELSE 0.0 END END) AS flat, median(volume) AS mv, median(close * volume) AS ml, min(CASE WHEN volume > 0 THEN date END) AS first_trade FROM a GROUP BY symbol)
SELECT symbol, trading_days, round(missing, 6) AS missing_close_pct, round(flat, 6) AS flat_close_pct, round(mv, 4) AS median_volume, round(ml, 4) AS median_liquidity, first_trade,
    CASE WHEN trading_days >= 250 AND missing < 0.7 THEN 'standard' WHEN trading_days >= 120 THEN 'emerging' ELSE 'insufficient' END AS tier,
    array_to_string(list_filter([CASE WHEN trading_days < 250 THEN 'short history' END, CASE WHEN missing >= 0.7 THEN 'missing closes' END, CASE WHEN flat > 0.3 THEN 'flat closes' END, CASE WHEN mv < 2 THEN 'thin volume' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h""")
def symbol_health(spark, sf_dir):
    """Health figures of each symbol on the calendar, its tier and the reasons against it."""
    x = calendar(bars_orders(spark, sf_dir)).withColumn("step", F.col("close") - F.lag("close").over(w.W))
    yes = lambda c: F.when(c, 1.0).otherwise(0.0)
    x = x.groupBy("symbol").agg(
        F.count("close").alias("trading_days"), F.avg(yes(F.col("close").isNull())).alias("missing"), F.avg(F.when(F.col("step").isNotNull(), yes(F.abs("step") < 1e-8))).alias("flat"),
        F.median("volume").alias("mv"), F.median(F.col("close") * F.col("volume")).alias("ml"), F.min(F.when(F.col("volume") > 0, F.col("date"))).alias("first_trade"),
    )
    tier = F.when((F.col("trading_days") >= 250) & (F.col("missing") < 0.7), "standard").when(F.col("trading_days") >= 120, "emerging").otherwise("insufficient")
    why = F.array_compact(F.array(F.when(F.col("trading_days") < 250, "short history"), F.when(F.col("missing") >= 0.7, "missing closes"), F.when(F.col("flat") > 0.3, "flat closes"), F.when(F.col("mv") < 2, "thin volume")))
    return x.select("symbol", "trading_days", _r("missing").alias("missing_close_pct"), _r("flat").alias("flat_close_pct"), _r("mv", 4).alias("median_volume"), _r("ml", 4).alias("median_liquidity"), "first_trade", tier.alias("tier"), F.array_join(why, ",").alias("reasons"))


@query(f"""WITH {BARS}, m AS (SELECT symbol, sector, median(volume) AS v, median(close * volume) AS l, avg(CASE WHEN volume <= 1 THEN 1.0 ELSE 0.0 END) AS z FROM bars GROUP BY 1, 2)
SELECT sector, count(*) AS symbols, round(greatest(quantile_cont(v, 0.25), 1.0), 4) AS min_volume, round(greatest(quantile_cont(l, 0.25), 50000.0), 6) AS min_liquidity, round(least(greatest(quantile_cont(z, 0.7), 0.1), 0.6), 6) AS max_zero_volume FROM m GROUP BY sector""")
def sector_liquidity_thresholds(spark, sf_dir):
    """Two-level statistics: medians of symbols, then their quartiles by sector, within floors and caps."""
    m = bars_orders(spark, sf_dir).groupBy("symbol", "sector").agg(F.median("volume").alias("v"), F.median(F.col("close") * F.col("volume")).alias("l"), F.avg(F.when(F.col("volume") <= 1, 1.0).otherwise(0.0)).alias("z"))
    q = lambda c, p: F.percentile(c, F.lit(p))
    return m.groupBy("sector").agg(F.count("*").alias("symbols"), _r(F.greatest(q("v", 0.25), F.lit(1.0)), 4).alias("min_volume"), _r(F.greatest(q("l", 0.25), F.lit(50000.0)), 6).alias("min_liquidity"), _r(F.least(F.greatest(q("z", 0.7), F.lit(0.1)), F.lit(0.6))).alias("max_zero_volume"))
