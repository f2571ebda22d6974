"""The factor frame: every base factor, their cross-sectional form, the sector's features, the target and forward return."""

from __future__ import annotations

import math

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.plans import features as f, sectors
from tapeloom.plans.registry import query
from tapeloom.sources.bars import bars_orders

HORIZON, LONG = 21, 50
FAST, SLOW = max(3, HORIZON // 2), max(5, HORIZON)
BASE = [
    "frac_diff", "sharpe_fast_z", "sharpe_slow_z", "adx_z", "efficiency_z", "liquidity_z", "smart_money_z", "vol_regime_z", "roll_skew", "roll_kurt",
    "trend_strength", "trend_slope", "rsi", "volume_z", "range_compression_z", "bb_width_z", "dist_ma_z", "bb_position", "price_range_pos", "dist_sma200_z",
    "regime_intensity_z", "regime_tag", "atr_z", "vol_ratio_z", "autocorr_z", "drawdown_z",
]
SECTOR = [f"sector_{c}" for c in sectors.SECTOR_COLUMNS]


def _zero(x):
    return F.coalesce(x, F.lit(0.0))


def base_factors(bars):
    """bars with the BASE columns. Missing values stay NULL here: the cross-section skips them."""
    x = f.money_flow(f.adx(f.rsi(f.atr(bars.withColumn("volume", F.coalesce("volume", F.lit(0.0)))))))
    x = f.reversion(x, max(20, HORIZON))
    step, ratio = f.efficiency()
    impact = F.abs(w.change("close")) / F.nullif(F.ln(F.when(F.col("volume") == 0, F.lit(1.0)).otherwise(F.col("volume"))), F.lit(0.0))
    x = x.withColumns({"lr": w.log_return(), "ret": w.change("close"), "step": step, "impact": impact, "lp": F.ln("close"), "ma": w.mean("close", LONG)})
    x = x.withColumns(
        {
            "s20": w.std("lr", 20),
            "vr": _zero(w.clamp(w.ratio(w.std("lr", 20), w.std("lr", 120)), 0.0, 5.0)),
            "prev": F.lag("lr").over(w.W),
            "mfast": f.momentum("ret", FAST),
            "mslow": f.momentum("ret", SLOW),
            "eff": ratio("step"),
            "kyle": F.avg("impact").over(w.frame(20)),
            "vol20": w.mean("volume", 20),
            "span": w.ratio(F.col("high") - F.col("low"), F.col("close")),
            "width": f.squeeze(),
            "mstep": F.col("ma") - F.lag("ma").over(w.W),
            "atrp": _zero(w.ratio(F.col("atr"), F.col("close"))),
            "dd": F.col("close") / F.max("close").over(w.PAST) - 1,
        }
    )
    auto = F.when(F.count("lr").over(w.frame(60)) >= 60, F.corr("lr", "prev").over(w.frame(59)))
    x = x.withColumns({"span20": _zero(w.mean("span", 20)), "calm": w.mean("s20", 126), "auto": _zero(auto), "v20": w.ffill("vol20")})
    x = x.withColumn("regime_intensity_z", w.zscore("calm", 252))
    return x.withColumns(
        {
            "frac_diff": f.fractional(),
            "sharpe_fast_z": w.zscore("mfast"),
            "sharpe_slow_z": w.zscore("mslow"),
            "adx_z": w.zscore("adx"),
            "efficiency_z": w.zscore("eff"),
            "liquidity_z": w.zscore("kyle", 126),
            "smart_money_z": w.zscore("smart_money", 126),
            "vol_regime_z": w.zscore("s20", 252),
            "roll_skew": _zero(w.skewness("lr", 60)),
            "roll_kurt": _zero(w.kurtosis("lr", 60)),
            "trend_strength": F.col("close") / F.col("ma") - 1,
            "trend_slope": w.mean("mstep", 5) / F.col("close"),
            "volume_z": w.zscore("v20"),
            "range_compression_z": w.zscore("span20"),
            "bb_width_z": w.zscore("width", 126),
            "regime_tag": F.signum(F.round("regime_intensity_z", 9)),
            "atr_z": w.zscore("atrp", 126),
            "vol_ratio_z": w.zscore("vr", 126),
            "autocorr_z": w.zscore("auto", 252),
            "drawdown_z": w.zscore("dd", 252),
        }
    )


def cross_section(x, columns):
    """x with xsec_<column>: each row's factors in deviations from the row's own mean, over those that it has."""
    known = F.filter(F.array(*columns), lambda v: v.isNotNull())
    x = x.withColumn("_known", known).withColumn("_mu", F.aggregate("_known", F.lit(0.0), lambda a, v: a + v) / F.size("_known"))
    around = F.aggregate("_known", F.lit(0.0), lambda a, v: a + (v - F.col("_mu")) * (v - F.col("_mu")))
    x = x.withColumn("_sd", F.sqrt(around / F.nullif(F.size("_known") - 1, F.lit(0))))
    each = {f"xsec_{c}": _zero(F.when(F.col("_sd") > 1e-9, (F.col(c) - F.col("_mu")) / F.col("_sd"))) for c in columns}
    return x.withColumns(each).drop("_known", "_mu", "_sd")


def labelled(x, horizon: int = HORIZON):
    """x (with bench) with fwd_ret and target: the outer fifths of the forward return against the sector, over all of a symbol's
    history; none without volume. The last `horizon` rows go."""
    ahead = lambda c: F.lead(c, horizon).over(w.W) / F.col(c) - 1
    x = x.withColumns({"fwd_ret": ahead("close"), "_rel": ahead("close") - ahead("bench")})
    rank = F.rank().over(Window.partitionBy("symbol", F.col("_rel").isNull()).orderBy("_rel"))
    ties = F.count("*").over(Window.partitionBy("symbol", "_rel"))
    share = F.round(F.when(F.col("_rel").isNotNull(), (rank + (ties - 1) / 2.0) / F.count("_rel").over(w.BY)), 9)
    x = x.withColumn("target", F.when(F.col("volume") > 0, F.when(share >= 0.8, 1.0).when(share <= 0.2, 0.0)))
    return x.where("fwd_ret IS NOT NULL").drop("_rel")


def factor_frame(bars):
    """(symbol, date, base, cross-sectional and sector factors, target, fwd_ret): windows of one shuffle by symbol."""
    x = sectors.with_bench(bars)
    x = labelled(sectors.sector_frame(cross_section(base_factors(x), BASE), HORIZON))
    names = [*BASE, *(f"xsec_{c}" for c in BASE), *SECTOR]
    return x.select("symbol", "date", *[_zero(F.col(c)).alias(c) for c in names], "target", "fwd_ret")


def _mom(n):
    return f"coalesce(({d.mean('ret', n)}) / nullif(({d.std('ret', n)}), 0) * {math.sqrt(252)}, 0.0)"


_M, _S = f"({d.mean('close', max(20, HORIZON))})", f"({d.std('close', max(20, HORIZON))})"
_ROW = f"[{', '.join(BASE)}]"
_SQL = f"""{sectors._BENCH}, {sectors.sector_frame_sql("bb", HORIZON)},
a AS (SELECT *, {d.log_return()} AS lr, {d.change("close")} AS ret, close - {d.lag("close")} AS chg, {d.lag("close")} AS prev, high - {d.lag("high")} AS u, {d.lag("low")} - low AS v, ln(close) AS lp,
    (high - low) / nullif(close, 0) AS span, close / max(close) OVER {d.w()} - 1 AS dd, {d.mean("close", LONG)} AS ma, (close - {_M}) / nullif({_M}, 0) AS dist,
    (close - ({d.mean("close", 200)})) / nullif(({d.mean("close", 200)}), 0) AS dist200, (close - ({_M} - 2 * {_S})) / nullif(4 * {_S}, 0) AS place,
    (close - min(close) OVER {d.w(400)}) / nullif(max(close) OVER {d.w(400)} - min(close) OVER {d.w(400)}, 0) AS range_pos, 4 * ({d.std("close", 20)}) / nullif(({d.mean("close", 20)}), 0) AS width,
    {d.mean("volume", 20)} AS vol20 FROM bb),
b AS (SELECT *, CASE WHEN chg IS NOT NULL THEN greatest(chg, 0.0) END AS up, CASE WHEN chg IS NOT NULL THEN greatest(-chg, 0.0) END AS down, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr,
    CASE WHEN u > v AND u > 0 THEN u ELSE 0.0 END AS pm, CASE WHEN v > u AND v > 0 THEN v ELSE 0.0 END AS mm, abs(chg) AS step, greatest(high, prev) AS th, least(low, prev) AS tl,
    abs(ret) / nullif(ln(CASE WHEN volume = 0 THEN 1 ELSE volume END), 0) AS impact, {d.std("lr", 20)} AS s20, {d.std("lr", 120)} AS s120, {d.lag("lr")} AS plr, {_mom(FAST)} AS mfast, {_mom(SLOW)} AS mslow,
    ma - {d.lag("ma")} AS mstep FROM a),
c AS (SELECT *, {d.ewm("up", 1 / 14)} AS gain, {d.ewm("down", 1 / 14)} AS loss, {d.ewm("tr", 2 / 15)} AS atr, {d.ewm("pm", 1 / 14)} AS pe, {d.ewm("mm", 1 / 14)} AS me, nullif(({d.mean("tr", 14)}), 0) AS r14,
    coalesce((2 * close - th - tl) / nullif(th - tl, 0), 0.0) * volume AS adv, coalesce(least(greatest(s20 / nullif(s120, 0), 0), 5), 0.0) AS vr,
    coalesce(abs(close - {d.lag("close", 20)}) / nullif(({d.roll("sum", "step", 20)}), 0), 0.0) AS eff, avg(impact) OVER {d.w(20)} AS kyle, coalesce({d.mean("span", 20)}, 0.0) AS span20, {d.mean("s20", 126)} AS calm,
    coalesce(CASE WHEN count(lr) OVER {d.w(60)} >= 60 THEN corr(lr, plr) OVER {d.w(59)} END, 0.0) AS auto, {d.ffill("vol20")} AS v20 FROM b),
e AS (SELECT *, 100 * pe / r14 AS pd, 100 * me / r14 AS md, list(adv) OVER {d.w(f._SMF_DEPTH)} AS av, list(volume) OVER {d.w(f._SMF_DEPTH)} AS vv, count(*) OVER {d.w()} AS k FROM c),
g AS (SELECT *, 100 * abs(pd - md) / (CASE WHEN pd + md = 0 THEN 1.0 ELSE pd + md END) AS dx, coalesce(atr / nullif(close, 0), 0.0) AS atrp,
    coalesce(CASE WHEN k >= 20 THEN list_sum([av[i] * pow(1 - 2.0 / 21, len(av) - i) FOR i IN range(1, len(av) + 1)]) / nullif(list_sum([vv[i] * pow(1 - 2.0 / 21, len(vv) - i) FOR i IN range(1, len(vv) + 1)]), 0) END, 0.0) AS smf FROM e),
h AS (SELECT *, coalesce({d.mean("dx", 14)}, 0.0) AS adx, {d.zscore("calm", 252)} AS regime_intensity_z FROM g),
z AS (SELECT symbol, date, close, volume, bench, {f.fractional_sql()} AS frac_diff, {d.zscore("mfast")} AS sharpe_fast_z, {d.zscore("mslow")} AS sharpe_slow_z, {d.zscore("adx")} AS adx_z, {d.zscore("eff")} AS efficiency_z,
    {d.zscore("kyle", 126)} AS liquidity_z, {d.zscore("smf", 126)} AS smart_money_z, {d.zscore("s20", 252)} AS vol_regime_z, coalesce({d.roll("skewness", "lr", 60)}, 0.0) AS roll_skew,
    coalesce({d.roll("kurtosis", "lr", 60)}, 0.0) AS roll_kurt, close / ma - 1 AS trend_strength, ({d.mean("mstep", 5)}) / close AS trend_slope, coalesce(100.0 - 100.0 / (1.0 + gain / nullif(loss, 0)), 50.0) AS rsi,
    {d.zscore("v20")} AS volume_z, {d.zscore("span20")} AS range_compression_z, {d.zscore("width", 126)} AS bb_width_z, {d.zscore("dist")} AS dist_ma_z, coalesce({d.clamp("place", 0, 1)}, 0.5) AS bb_position,
    coalesce({d.clamp("range_pos", 0, 1)}, 0.5) AS price_range_pos, {d.zscore("dist200", 252)} AS dist_sma200_z, regime_intensity_z, sign(round(regime_intensity_z, 9))::DOUBLE AS regime_tag, {d.zscore("atrp", 126)} AS atr_z,
    {d.zscore("vr", 126)} AS vol_ratio_z, {d.zscore("auto", 252)} AS autocorr_z, {d.zscore("dd", 252)} AS drawdown_z FROM h),
x AS (SELECT *, list_avg({_ROW}) AS mu, list_stddev_samp({_ROW}) AS sd, lead(close, {HORIZON}) OVER ({d.OVER}) / close - 1 AS fwd_ret,
    lead(close, {HORIZON}) OVER ({d.OVER}) / close - lead(bench, {HORIZON}) OVER ({d.OVER}) / bench AS rel FROM z),
y AS (SELECT *, round(CASE WHEN rel IS NOT NULL THEN (rank() OVER (PARTITION BY symbol, rel IS NULL ORDER BY rel) + (count(*) OVER (PARTITION BY symbol, rel) - 1) / 2.0) / count(rel) OVER (PARTITION BY symbol) END, 9) AS share FROM x)"""


@query(f"""WITH {_SQL} SELECT symbol, date, {", ".join(f"round(coalesce({c}, 0.0), 3) AS {c}" for c in BASE)},
    {", ".join(f"round(coalesce(CASE WHEN sd > 1e-9 THEN ({c} - mu) / sd END, 0.0), 3) AS xsec_{c}" for c in BASE)}, {", ".join(f"round(coalesce({c}, 0.0), 3) AS {c}" for c in SECTOR)},
    CASE WHEN volume > 0 THEN CASE WHEN share >= 0.8 THEN 1.0 WHEN share <= 0.2 THEN 0.0 END END::DOUBLE AS target, round(fwd_ret, 5) AS fwd_ret FROM y JOIN s5 USING (symbol, date) WHERE fwd_ret IS NOT NULL""")
def factor_assembly(spark, sf_dir):
    x = factor_frame(bars_orders(spark, sf_dir))
    names = [c for c in x.columns if c not in ("symbol", "date", "target", "fwd_ret")]
    return x.select("symbol", "date", *[F.round(c, 3).alias(c) for c in names], "target", F.round("fwd_ret", 5).alias("fwd_ret"))


@query(f"""WITH {_SQL}, t AS (SELECT y.*, CASE WHEN share >= 0.8 THEN 1.0 WHEN share <= 0.2 THEN 0.0 END AS target FROM y WHERE fwd_ret IS NOT NULL AND volume > 0),
i AS ({" UNION ALL ".join(f"SELECT symbol, '{c}' AS feature, CASE WHEN stddev_pop(coalesce({c}, 0.0)) > 1e-9 AND stddev_pop(target) > 0 THEN abs(corr(coalesce({c}, 0.0), target)) END AS importance FROM t WHERE target IS NOT NULL GROUP BY symbol" for c in BASE)}),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(coalesce(importance, 0), 6) DESC, feature) AS k FROM i)
SELECT symbol, k, feature, round(coalesce(importance, 0), 4) AS importance FROM r WHERE k <= 8""")
def feature_importance(spark, sf_dir):
    """The eight base factors of each symbol that go most with its target, by absolute correlation."""
    x = factor_frame(bars_orders(spark, sf_dir)).where("target IS NOT NULL")
    # not corr: it divides by zero where a factor is constant
    spread = lambda c: F.when((F.stddev_pop(c) > 1e-9) & (F.stddev_pop("target") > 0), F.stddev_pop(c) * F.stddev_pop("target"))
    tie = lambda c: F.abs(F.covar_pop(c, "target") / spread(c))
    x = x.groupBy("symbol").agg(*[F.coalesce(tie(c), F.lit(0.0)).alias(c) for c in BASE])
    x = x.select("symbol", F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in BASE])))
    k = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(F.round("importance", 6)), "feature"))
    return x.withColumn("k", k.cast("long")).where("k <= 8").select("symbol", "k", "feature", F.round("importance", 4).alias("importance"))
