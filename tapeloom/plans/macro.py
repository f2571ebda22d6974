"""Macro blocks by keyword, over a daily series known on some bar dates only."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import duck as d, scans, windows as w
from tapeloom.operators import macro
from tapeloom.plans.registry import query
from tapeloom.plans.sectors import with_bench
from tapeloom.sources.bars import BARS, bars_orders, table

_COLS = ("z", "return_5d", "return_20d", "beta_z", "spread_z", "asset_interaction", "inflation_carry_z", "fx_shock", "fx_carry", "remit_trend_z", "hydro_stress_z")


@query(f"""WITH {BARS}, s AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS value FROM lineitem WHERE dayofweek(l_shipdate) <> 0 GROUP BY 1),
j AS (SELECT symbol, bars.date, close, value AS raw FROM bars LEFT JOIN s ON s.date = bars.date), f AS (SELECT symbol, date, close, {d.ffill('raw')} AS m FROM j),
a AS (SELECT *, coalesce({d.change('close')}, 0.0) AS ar, coalesce({d.change('m')}, 0.0) AS mr, {d.mean('m', 90)} AS m90 FROM f),
b AS (SELECT *, coalesce({d.beta('ar', 'mr', 126)}, 0.0) AS beta, ar * mr AS link, ar - mr AS gap, coalesce(({d.mean('mr', 30)}) - ({d.mean('mr', 5)}), 0.0) AS slow, coalesce({d.change('m90')}, 0.0) AS trend, coalesce(m - ({d.mean('m', 252)}), 0.0) AS dev FROM a),
c AS (SELECT *, {d.mean('link', 126)} AS carry FROM b)
SELECT symbol, date, round({d.zscore('m', 252)}, 4) AS macro_z, round(coalesce({d.change('m', 5)}, 0.0), 6) AS macro_return_5d, round(coalesce({d.change('m', 20)}, 0.0), 6) AS macro_return_20d, round({d.zscore('beta', 126)}, 4) AS macro_beta_z,
    round({d.zscore('gap', 126)}, 4) AS macro_spread_z, round(link, 6) AS macro_asset_interaction, round({d.zscore('carry', 126)}, 4) AS macro_inflation_carry_z, round({d.zscore('mr', 60)}, 4) AS macro_fx_shock, round({d.zscore('slow', 126)}, 4) AS macro_fx_carry,
    round({d.zscore('trend', 126)}, 4) AS macro_remit_trend_z, round({d.zscore('dev', 252)}, 4) AS macro_hydro_stress_z FROM c""")
def macro_keyword_blocks(spark, sf_dir):
    """Every block over the daily mean unit price, which has no value on Sundays."""
    item = table(spark, sf_dir, "lineitem").where(F.dayofweek("l_shipdate") != 1)
    series = item.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    x, _ = macro.block(macro.at_dates(bars_orders(spark, sf_dir), series), "usd_remit_rain_cpi")
    digits = {"return_5d": 6, "return_20d": 6, "asset_interaction": 6}
    return x.select("symbol", "date", *[F.round(f"macro_{c}", digits.get(c, 4)).alias(f"macro_{c}") for c in _COLS])


#: Sectors that these tables' sectors stand for; the others have no block of their own.
_STANDS = {"AFRICA": macro.BANK_SECTORS[0], "ASIA": macro.HYDRO_SECTORS[0]}
_SECTOR_COLS = ("corr_z", "momentum", "sector_beta_interaction", "inflation_sensitivity_z", "asset_link", "hydro_interaction", "bank_interaction")


def _ratio60(c):
    return f"coalesce(({d.mean(c, 60)}) / nullif(({d.std(c, 60)}), 0) * sqrt(252), 0.0)"


@query(f"""WITH {BARS}, s AS (SELECT CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS value FROM lineitem WHERE dayofweek(l_shipdate) <> 0 GROUP BY 1),
g AS (SELECT symbol, sector, date, close, avg(close) OVER (PARTITION BY sector, date) AS bench FROM bars),
j AS (SELECT g.*, value AS raw FROM g LEFT JOIN s ON s.date = g.date), f AS (SELECT *, {d.ffill('raw')} AS m FROM j),
a AS (SELECT *, coalesce({d.change('close')}, 0.0) AS ar, coalesce({d.change('bench')}, 0.0) AS br, coalesce({d.change('m')}, 0.0) AS mr, {d.mean('m', 90)} AS m90 FROM f),
b AS (SELECT *, coalesce(nullif(({d.pair('corr', 'ar', 'mr', 126)}), 'NaN'::DOUBLE), 0.0) AS co, coalesce({d.beta('ar', 'br', 126)}, 0.0) * mr AS pull, coalesce({d.change('m90')}, 0.0) AS trend FROM a),
c AS (SELECT *, nullif(({d.pair('corr', 'ar', 'trend', 60)}), 'NaN'::DOUBLE) AS tie, ({d.std('ar', 20)}) / nullif(({d.std('ar', 120)}), 0) AS vr, {d.roll('min', 'm', 252)} AS low, {d.roll('max', 'm', 252)} AS high FROM b)
SELECT symbol, sector, date, round({d.zscore('co', 126)}, 4) AS macro_corr_z, round({_ratio60('mr')}, 4) AS macro_momentum, round(pull, 6) AS macro_sector_beta_interaction, round({d.zscore('pull', 126)}, 4) AS macro_inflation_sensitivity_z,
    round({d.zscore('tie', 126)}, 4) AS macro_asset_link, CASE WHEN sector = 'ASIA' THEN round({_ratio60('ar')} * coalesce((m - low) / (high - low + 1e-6), 0.5), 4) END AS macro_hydro_interaction,
    CASE WHEN sector = 'AFRICA' THEN round(coalesce(({d.zscore('m', 126)}) / {d.clamp('vr', 0.5, 2.0)}, 0.0), 4) END AS macro_bank_interaction FROM c""")
def macro_sector_blocks(spark, sf_dir):
    """What a macro series says by sector: links to the symbol and its sector's beta, and the blocks of banks and hydropower."""
    item = table(spark, sf_dir, "lineitem").where(F.dayofweek("l_shipdate") != 1)
    series = item.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    x = macro.at_dates(with_bench(bars_orders(spark, sf_dir)), series)
    x = x.withColumns({c: F.coalesce(w.change(v), F.lit(0.0)) for c, v in (("_a", "close"), ("_b", "bench"))})
    x = scans.slide(x, 126, pairs=(("_a", "_b"),)).withColumn("sector_beta", scans.beta_of("_a__b_126", 126)).drop("_a", "_b", "_a__b_126")
    kind = F.coalesce(*[F.when(F.col("sector") == s, F.lit(name)) for s, name in _STANDS.items()])
    x, _ = macro.block(x.withColumn("kind", kind), "usd_remit_rain_cpi", beta="sector_beta", by="kind")
    return x.select("symbol", "sector", "date", *[F.round(f"macro_{c}", 6 if c == "sector_beta_interaction" else 4).alias(f"macro_{c}") for c in _SECTOR_COLS])


@query("""WITH c AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'index' ELSE 'emerging_stock' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN 'bull' WHEN 1 THEN 'bear' WHEN 2 THEN 'neutral' ELSE 'unknown' END AS regime, o_totalprice FROM orders),
p AS (SELECT *, CASE WHEN kind = 'index' THEN CASE regime WHEN 'bull' THEN 0.52 WHEN 'bear' THEN 0.60 ELSE 0.55 END ELSE CASE regime WHEN 'bull' THEN 0.56 WHEN 'bear' THEN 0.65 ELSE 0.60 END END::DOUBLE AS thr FROM c)
SELECT kind, regime, thr AS prob_threshold, count(*) AS n, min(o_totalprice) AS low FROM p GROUP BY 1, 2, 3""")
def regime_parameters(spark, sf_dir):
    """Parameters by kind of asset and regime; an unknown regime counts as neutral."""
    from tapeloom.plans.artifacts import REGIMES

    k = F.col("o_orderkey")
    x = table(spark, sf_dir, "orders").select(F.when(k % 2 == 0, "index").otherwise("emerging_stock").alias("kind"), F.when(k % 4 == 0, "bull").when(k % 4 == 1, "bear").when(k % 4 == 2, "neutral").otherwise("unknown").alias("regime"), "o_totalprice")
    dim = spark.createDataFrame([(a, r, t) for a, r, t, _ in REGIMES], "kind string, key string, prob_threshold double")
    known = [r for _, r, *_ in REGIMES]
    x = x.withColumn("key", F.when(F.col("regime").isin(known), F.col("regime")).otherwise("neutral")).join(F.broadcast(dim), ["kind", "key"])
    return x.groupBy("kind", "regime", "prob_threshold").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"))


@query("""WITH a AS (SELECT p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY abs(p_retailprice - 1200), p_partkey) AS k FROM part) SELECT p_brand, p_size, round(p_retailprice, 4) AS price FROM a WHERE k = 1""")
def nearest_value(spark, sf_dir):
    """The row nearest to a value in each group."""
    x = table(spark, sf_dir, "part")
    near = F.struct(F.abs(F.col("p_retailprice") - 1200), "p_partkey")
    return x.groupBy("p_brand").agg(F.min_by("p_size", near).alias("p_size"), F.round(F.min_by("p_retailprice", near), 4).alias("price"))


@query("""WITH h AS (SELECT s_nationkey, s_acctbal, CASE WHEN s_acctbal < 0 THEN 'negative' WHEN s_acctbal < 1000 THEN 'too small' ELSE 'ok' END AS reason FROM supplier)
SELECT reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4)::DOUBLE AS pct FROM h GROUP BY reason""")
def skip_reasons(spark, sf_dir):
    """Rows by reason and their share; three rows at most meet the total."""
    x = table(spark, sf_dir, "supplier").select(F.when(F.col("s_acctbal") < 0, "negative").when(F.col("s_acctbal") < 1000, "too small").otherwise("ok").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    total = x.agg(F.sum("n").alias("total"))
    return x.join(F.broadcast(total)).select("reason", "n", F.round(F.col("n") * 100.0 / F.col("total"), 4).alias("pct"))
