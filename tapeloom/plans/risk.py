"""Tail risk, fan charts, decisions and allocations over simulated paths."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.operators import montecarlo as mc
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders
from tapeloom.sources.shared import cut

SIMS, BLOCKS, BLOCK = 150, 2, 30
DAYS = BLOCKS * BLOCK

_CLIP = f"""{BARS}, h0 AS (SELECT symbol, date, {d.log_return()} AS lr FROM bars),
h AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx, least(greatest(lr, -0.1), 0.1) AS r FROM h0 WHERE lr IS NOT NULL)"""
PATHS = f"""{_CLIP}, sz AS (SELECT symbol, count(*) AS n FROM h GROUP BY symbol HAVING count(*) >= {BLOCK}),
steps AS (SELECT symbol, sim, b * {BLOCK} + j + 1 AS day, (sim * 7919 + b * 104729) % (n - {BLOCK} + 1) + j AS idx
    FROM sz, range({SIMS}) s(sim), range({BLOCKS}) t(b), range({BLOCK}) u(j)),
paths AS (SELECT symbol, sim, day, exp(sum(ln(1 + r)) OVER (PARTITION BY symbol, sim ORDER BY day)) AS growth FROM steps JOIN h USING (symbol, idx)),
term AS (SELECT symbol, sim, growth - 1 AS ret FROM paths WHERE day = {DAYS})"""


def clipped(spark, sf_dir, bars=None):
    x = (bars_orders(spark, sf_dir) if bars is None else bars).withColumn("lr", w.log_return()).where("lr IS NOT NULL")
    return x.select("symbol", "date", F.least(F.greatest("lr", F.lit(-0.1)), F.lit(0.1)).alias("r"))


def paths(spark, sf_dir, bars=None):
    return mc.bootstrap_paths(clipped(spark, sf_dir, bars), SIMS, BLOCKS, BLOCK)


def terminals(spark, sf_dir, bars=None):
    return paths(spark, sf_dir, bars).where(F.col("day") == DAYS).select("symbol", "sim", (F.col("growth") - 1).alias("ret"))


def _r(x, n=6):
    return F.round(x, n)


def quantiles(x, value: str, levels):
    """symbol, q: the interpolated quantiles of a column, from its ranks (a sort, where exact percentiles would build hash maps)."""
    by = Window.partitionBy("symbol")
    x = x.where(F.col(value).isNotNull()).select("symbol", F.col(value).alias("v"))
    x = x.select("symbol", "v", (F.row_number().over(by.orderBy("v")) - 1).alias("k"), F.count("*").over(by).alias("n"))

    def quantile(p: float):
        at = F.lit(p) * (F.col("n") - 1)
        low = F.max(F.when(F.col("k") == F.floor(at), F.col("v")))
        high = F.max(F.when(F.col("k") == F.ceil(at), F.col("v")))
        return low + (high - low) * F.max(at - F.floor(at))

    return x.groupBy("symbol").agg(F.array(*[quantile(p) for p in levels]).alias("q"))


def tails(x, value, levels=(0.05, 0.01)):
    """Rows of x with the percentiles `q` of a value in their group, from one pass over x and a join of one row a symbol."""
    x = cut(x.withColumn("v", value))
    return x.join(quantiles(x, "v", levels), "symbol")


def tail_mean(k: int):
    """Mean of the values at or below the k-th percentile."""
    return F.avg(F.when(_r("v", 9) <= _r(F.col("q")[k], 9), F.col("v")))


@query(f"""WITH {PATHS}, q AS (SELECT symbol, quantile_cont(ln(1 + ret), 0.05) AS q95, quantile_cont(ln(1 + ret), 0.01) AS q99 FROM term GROUP BY symbol)
SELECT symbol, round(avg(ret), 6) AS mean, round(median(ret), 6) AS median, round(-(exp(any_value(q95)) - 1), 6) AS var_95, round(-(exp(avg(CASE WHEN round(ln(1 + ret), 9) <= round(q95, 9) THEN ln(1 + ret) END)) - 1), 6) AS cvar_95,
    round(-(exp(any_value(q99)) - 1), 6) AS var_99, round(-(exp(avg(CASE WHEN round(ln(1 + ret), 9) <= round(q99, 9) THEN ln(1 + ret) END)) - 1), 6) AS cvar_99 FROM term JOIN q USING (symbol) GROUP BY symbol""")
def risk_table(spark, sf_dir):
    """Mean, median, and value at risk and expected shortfall, taken in log space, as positive losses."""
    return log_tails(terminals(spark, sf_dir))


def log_tails(x):
    x = tails(x, F.log1p("ret"))
    x = x.join(quantiles(x, "ret", (0.5,)).select("symbol", F.col("q")[0].alias("mid")), "symbol")
    loss = lambda c: _r(-F.expm1(c))
    return x.groupBy("symbol").agg(
        _r(F.avg("ret")).alias("mean"),
        _r(F.first("mid")).alias("median"),
        loss(F.first("q")[0]).alias("var_95"),
        loss(tail_mean(0)).alias("cvar_95"),
        loss(F.first("q")[1]).alias("var_99"),
        loss(tail_mean(1)).alias("cvar_99"),
    )


@query(f"""WITH {PATHS}, q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q95, quantile_cont(ret, 0.01) AS q99 FROM term GROUP BY symbol)
SELECT symbol, round(any_value(q95), 6) AS var_95, round(any_value(q99), 6) AS var_99, round(avg(CASE WHEN round(ret, 9) <= round(q95, 9) THEN ret END), 6) AS es_95, round(avg(CASE WHEN round(ret, 9) <= round(q99, 9) THEN ret END), 6) AS es_99, round(avg(ret), 6) AS expected_return FROM term JOIN q USING (symbol) GROUP BY symbol""")
def risk_tails(spark, sf_dir, bars=None):
    """Signed tail figures of simple returns, as the risk job stores them."""
    return simple_tails(terminals(spark, sf_dir, bars))


def simple_tails(x):
    x = tails(x, F.col("ret"))
    return x.groupBy("symbol").agg(
        _r(F.first("q")[0]).alias("var_95"),
        _r(F.first("q")[1]).alias("var_99"),
        _r(tail_mean(0)).alias("es_95"),
        _r(tail_mean(1)).alias("es_99"),
        _r(F.avg("ret")).alias("expected_return"),
    )


@query(f"""WITH {PATHS} SELECT symbol, day, {', '.join(f'round(quantile_cont(growth, {p / 100}), 6) AS p{p}' for p in (5, 25, 50, 75, 95))} FROM paths GROUP BY symbol, day""")
def fan_chart(spark, sf_dir):
    x = paths(spark, sf_dir).groupBy("symbol", F.col("day").cast("long").alias("day")).agg(F.percentile("growth", F.array(*[F.lit(p / 100) for p in (5, 25, 50, 75, 95)])).alias("q"))
    return x.select("symbol", "day", *[_r(F.col("q")[k]).alias(f"p{p}") for k, p in enumerate((5, 25, 50, 75, 95))])


@query(f"""WITH {PATHS}, b AS (SELECT symbol, min(ret) AS lo, max(ret) AS hi FROM term GROUP BY symbol), x AS (SELECT symbol, coalesce(least(floor(round((ret - lo) / CASE WHEN hi - lo > 1e-9 THEN (hi - lo) / 40 END, 9)), 39), 0)::INT AS bin, lo, hi FROM term JOIN b USING (symbol))
SELECT symbol, bin, round(any_value(lo + bin * (hi - lo) / 40), 6) AS edge, count(*) AS n FROM x GROUP BY symbol, bin""")
def histogram(spark, sf_dir):
    """Forty bins of equal width between the extremes; the last one is closed, and a value within 1e-9 of an edge is on it."""
    return forty_bins(terminals(spark, sf_dir))


def forty_bins(x):
    x = cut(x)
    ends = x.groupBy("symbol").agg(F.min("ret").alias("lo"), F.max("ret").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / 40
    place = F.floor(_r((F.col("ret") - F.col("lo")) / F.when(F.col("hi") - F.col("lo") > 1e-9, width), 9))
    x = x.join(ends, "symbol").withColumn("bin", F.coalesce(F.least(place, F.lit(39)), F.lit(0)).cast("int"))
    return x.groupBy("symbol", "bin").agg(_r(F.first(F.col("lo") + F.col("bin") * width)).alias("edge"), F.count("*").alias("n"))


@query(f"""WITH {PATHS}, a AS (SELECT *, growth / greatest(1.0, max(growth) OVER (PARTITION BY symbol, sim ORDER BY day)) - 1 AS dd FROM paths),
b AS (SELECT symbol, sim, min(dd) AS mdd, avg(CASE WHEN dd < 0 THEN 1.0 ELSE 0.0 END) AS under FROM a GROUP BY symbol, sim), q AS (SELECT symbol, quantile_cont(mdd, 0.05) AS q FROM b GROUP BY symbol)
SELECT symbol, round(avg(mdd), 6) AS mean_mdd, round(avg(CASE WHEN round(mdd, 9) <= round(q, 9) THEN mdd END), 6) AS path_es, round(avg(CASE WHEN mdd <= -0.3 THEN 1.0 ELSE 0.0 END), 6) AS failure_prob, round(avg(under), 6) AS under_water FROM b JOIN q USING (symbol) GROUP BY symbol""")
def path_risk(spark, sf_dir):
    """Drawdowns along each path: mean, tail mean, chance of -30 %, time under water."""
    past = Window.partitionBy("symbol", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    x = paths(spark, sf_dir).withColumn("dd", F.col("growth") / F.greatest(F.lit(1.0), F.max("growth").over(past)) - 1)
    x = x.groupBy("symbol", "sim").agg(F.min("dd").alias("mdd"), F.avg(F.when(F.col("dd") < 0, 1.0).otherwise(0.0)).alias("under"))
    return drawdown_figures(x)


def drawdown_figures(x):
    """Figures of each path's deepest drawdown `mdd` and share of days `under` water."""
    x = cut(x)
    x = x.join(quantiles(x, "mdd", (0.05,)).select("symbol", F.col("q")[0].alias("q")), "symbol")
    return x.groupBy("symbol").agg(_r(F.avg("mdd")).alias("mean_mdd"), _r(F.avg(F.when(_r("mdd", 9) <= _r("q", 9), F.col("mdd")))).alias("path_es"), _r(F.avg(F.when(F.col("mdd") <= -0.3, 1.0).otherwise(0.0))).alias("failure_prob"), _r(F.avg("under")).alias("under_water"))


def decide(x, cost: float = 0.009, tax: float = 0.05, scale=0.5, cap: float = 0.20, prob=None, by=("symbol",)):
    """Kelly size and edge of each group from terminal returns net of costs and, for gains, of tax.

    `scale` may be a column; it counts within 0.05 and 1. `prob` (a column) replaces the paths' chance of a gain.
    """
    net = F.col("ret") - cost
    x = x.groupBy(*by).agg(F.avg(F.when(net > 0, net * (1 - tax))).alias("win"), F.avg(F.when(net <= 0, -net)).alias("loss"), F.avg(net).alias("mean_net"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("mc"))
    x = x.withColumn("avg_win", F.coalesce("win", F.greatest("mean_net", F.lit(1e-4))))
    x = x.withColumn("avg_loss", F.coalesce("loss", F.greatest("avg_win", F.lit(1e-4)))).withColumn("payoff", F.col("avg_win") / F.greatest("avg_loss", F.lit(1e-6)))
    x = x.withColumn("p", F.coalesce(prob, F.col("mc")) if prob is not None else F.col("mc"))
    factor = F.least(F.greatest(scale if not isinstance(scale, float) else F.lit(scale), F.lit(0.05)), F.lit(1.0))
    x = x.withColumns({"raw_kelly": F.col("p") - (1 - F.col("p")) / F.col("payoff"), "edge": F.col("p") * F.col("avg_win") - (1 - F.col("p")) * F.col("avg_loss"), "confidence": F.least(F.lit(1.0), 2 * F.abs(F.col("p") - 0.5))})
    x = x.withColumn("size", F.greatest(F.lit(0.0), F.least(F.col("raw_kelly") * factor, F.lit(cap))))
    return x.withColumn("label", F.when(F.col("size") <= 0, "Avoid").otherwise("Bullish"))


_DECIDE = """n AS (SELECT symbol, ret - 0.009 AS net, ret FROM term), e AS (SELECT symbol, avg(CASE WHEN net > 0 THEN net * 0.95 END) AS win, avg(CASE WHEN net <= 0 THEN -net END) AS loss, avg(net) AS mn, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p FROM n GROUP BY symbol),
f AS (SELECT symbol, p, coalesce(win, greatest(mn, 1e-4)) AS aw, loss, mn FROM e), g AS (SELECT *, coalesce(loss, greatest(aw, 1e-4)) AS al FROM f), k AS (SELECT *, aw / greatest(al, 1e-6) AS payoff FROM g), r AS (SELECT *, p - (1 - p) / payoff AS raw FROM k)"""


@query(f"""WITH {PATHS}, {_DECIDE} SELECT symbol, round(p, 6) AS probability, round(aw, 6) AS avg_win, round(al, 6) AS avg_loss, round(raw, 6) AS raw_kelly, round(greatest(0.0, least(raw * 0.5, 0.2)), 6) AS size, round(p * aw - (1 - p) * al, 6) AS edge,
    CASE WHEN greatest(0.0, least(raw * 0.5, 0.2)) <= 0 THEN 'Avoid' ELSE 'Bullish' END AS label, round(least(1.0, 2 * abs(p - 0.5)), 6) AS confidence FROM r""")
def decision_engine(spark, sf_dir):
    return decisions(terminals(spark, sf_dir))


def decisions(x):
    x = decide(x)
    return x.select("symbol", _r("p").alias("probability"), _r("avg_win").alias("avg_win"), _r("avg_loss").alias("avg_loss"), _r("raw_kelly").alias("raw_kelly"), _r("size").alias("size"), _r("edge").alias("edge"), "label", _r("confidence").alias("confidence"))


@query(f"""WITH {PATHS}, {_DECIDE} SELECT symbol, s / 10.0 AS kelly_scale, round(greatest(0.0, least(raw * least(greatest(s / 10.0, 0.05), 1.0), 0.2)), 6) AS size FROM r, range(1, 11) t(s)""")
def sensitivity_sweep(spark, sf_dir):
    """Size of each symbol for ten Kelly scales."""
    x = decide(terminals(spark, sf_dir)).select("symbol", "raw_kelly", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("s"))
    scale = F.col("s") / F.lit(10.0)
    return x.select("symbol", scale.alias("kelly_scale"), _r(F.greatest(F.lit(0.0), F.least(F.col("raw_kelly") * F.least(F.greatest(scale, F.lit(0.05)), F.lit(1.0)), F.lit(0.2)))).alias("size"))


@query(f"""WITH {PATHS}, g AS (SELECT symbol, k / 50.0 AS f, avg(pow(greatest(1 + k / 50.0 * ret, 1e-6), -2.0) / -2.0) AS u FROM term, range(0, 51) t(k) GROUP BY symbol, k)
SELECT symbol, f AS allocation, round(u, 6) AS utility FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY round(u, 9) DESC, f) AS k FROM g) WHERE k = 1""")
def crra_grid(spark, sf_dir):
    """Allocation in [0, 1] with the greatest expected power utility (gamma 3), on a grid of 0.02."""
    x = terminals(spark, sf_dir).select("symbol", "ret", F.explode(F.sequence(F.lit(0), F.lit(50))).alias("k")).withColumn("f", F.col("k") / F.lit(50.0))
    x = x.groupBy("symbol", "f").agg(F.avg(F.pow(F.greatest(1 + F.col("f") * F.col("ret"), F.lit(1e-6)), -2.0) / -2.0).alias("u"))
    x = x.withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(_r("u", 9)), "f"))).where("k = 1")
    return x.select("symbol", F.col("f").alias("allocation"), _r("u").alias("utility"))


@query(f"""WITH {PATHS}, l AS (SELECT symbol, arg_max(close, date) AS last FROM bars GROUP BY symbol)
SELECT symbol, round(any_value(last) * 0.8, 2) AS stressed, round(avg(CASE WHEN ret <= -0.2 THEN 1.0 ELSE 0.0 END), 6) AS p_shock20, round(avg(CASE WHEN ret <= -0.1 THEN 1.0 ELSE 0.0 END), 6) AS p_shock10, round(CASE WHEN var_pop(ret) > 1e-12 THEN kurtosis_pop(ret) END, 5) AS kurt,
    round(any_value(last) * quantile_cont(1 + ret, 0.05), 2) AS low_price FROM term JOIN l USING (symbol) GROUP BY symbol""")
def stress_scenario(spark, sf_dir):
    """Shocked price, chances of shocks, kurtosis of terminal returns."""
    return shocks(terminals(spark, sf_dir), bars_orders(spark, sf_dir))


def shocks(x, bars):
    last = bars.groupBy("symbol").agg(F.max_by("close", "date").alias("last"))
    x = cut(x)
    x = x.join(last, "symbol").join(quantiles(x, "ret", (0.05,)), "symbol")
    p = lambda v: _r(F.avg(F.when(F.col("ret") <= v, 1.0).otherwise(0.0)))
    return x.groupBy("symbol").agg(_r(F.first("last") * 0.8, 2).alias("stressed"), p(-0.2).alias("p_shock20"), p(-0.1).alias("p_shock10"), _r(F.when(F.var_pop("ret") > 1e-12, F.kurtosis("ret")), 5).alias("kurt"), _r(F.first("last") * (1 + F.first("q")[0]), 2).alias("low_price"))


@query(f"""WITH {_CLIP}, a AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sd FROM h GROUP BY symbol)
SELECT symbol, round(least(greatest(exp((mu + sd * sd / 2) * 60 / 240) - 1, -0.4), 0.6), 6) AS drift_er, round(ln(1 + least(greatest(exp(mu * 240) - 1, -0.4), 0.6)) / 240, 8) AS canonical_mu FROM a""")
def drift_er(spark, sf_dir):
    """Drift return over a horizon (daily drift times years, as in the original definition), and the clamped canonical drift."""
    x = clipped(spark, sf_dir).groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    hold = lambda c: F.least(F.greatest(c, F.lit(-0.4)), F.lit(0.6))
    return x.select("symbol", _r(hold(F.exp((F.col("mu") + F.col("sd") * F.col("sd") / 2) * 60 / 240) - 1)).alias("drift_er"), _r(F.log1p(hold(F.exp(F.col("mu") * 240) - 1)) / 240, 8).alias("canonical_mu"))


def _params(spark, sf_dir):
    return clipped(spark, sf_dir).groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sigma"))


def _simulated(spark, sf_dir, model, **options):
    x = tails(mc.simulate(_params(spark, sf_dir), model, **options), F.col("ret"), (0.05, 0.95))
    gain = F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))
    return x.groupBy("symbol").agg(
        F.count("*").alias("sims"),
        _r(F.avg("ret")).alias("mean"),
        _r(F.first("q")[0]).alias("p5"),
        _r(F.first("q")[1]).alias("p95"),
        _r(gain).alias("prob_gain"),
    )


@query()
def mc_gbm(spark, sf_dir):
    return _simulated(spark, sf_dir, "gbm")


@query()
def mc_student_t(spark, sf_dir):
    return _simulated(spark, sf_dir, "gbm", df=8.0, rho=0.1)


@query()
def mc_ou(spark, sf_dir):
    return _simulated(spark, sf_dir, "ou")


@query()
def mc_jump(spark, sf_dir):
    return _simulated(spark, sf_dir, "jump")


def shortfall(x, level: float = 0.05):
    """symbol, es: the mean log return at or below its percentile, as a positive loss."""
    q = tails(x, F.log1p("ret"), (level,))
    return q.groupBy("symbol").agg(F.abs(F.least(F.expm1(tail_mean(0)), F.lit(0.0))).alias("es"))


@query()
def mc_blend(spark, sf_dir):
    """Expected return and shortfall of a horizon of 240 days.

    The return is half the drift return, half the mean of heavy-tailed paths (8 degrees); the shortfall is the mean of those
    of normal and of heavy-tailed paths.
    """
    params = _params(spark, sf_dir)
    heavy = cut(mc.simulate(params, "gbm", df=8.0, seed=8))
    years = mc.DAYS / 240
    drift = params.select("symbol", F.expm1((F.col("mu") + F.col("sigma") * F.col("sigma") / 2) * years).alias("drift"))
    x = drift.join(heavy.groupBy("symbol").agg(F.avg("ret").alias("mean")), "symbol")
    x = x.join(shortfall(mc.simulate(params, "gbm")), "symbol").join(shortfall(heavy).withColumnRenamed("es", "es_heavy"), "symbol")
    er = _r((F.col("drift") + F.col("mean")) / 2).alias("expected_return")
    return x.select("symbol", er, _r((F.col("es") + F.col("es_heavy")) / 2).alias("expected_shortfall"))


@query()
def canonical_engine(spark, sf_dir):
    """Paths whose yearly return is held within -40 % and 60 %: mean, shortfall, chance of a gain, kurtosis; the return used."""
    held = F.least(F.greatest(F.expm1(F.col("mu") * 240), F.lit(-0.4)), F.lit(0.6))
    params = _params(spark, sf_dir).withColumn("er", held)
    x = cut(mc.simulate(params.withColumn("mu", F.log1p("er") / 240), "gbm"))
    figures = x.groupBy("symbol").agg(
        F.avg("ret").alias("mean"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("gain"),
        F.kurtosis("ret").alias("kurt"),
    )
    figures = figures.join(shortfall(x), "symbol").join(params, "symbol")
    yearly = F.col("es") * F.sqrt(F.lit(240 / mc.DAYS))
    named = {"er_used": "er", "mc_expected_return": "mean", "mc_expected_shortfall": "es", "prob_gain": "gain", "sim_kurtosis": "kurt"}
    return figures.select("symbol", *[_r(c).alias(n) for n, c in named.items()], _r(yearly).alias("es_annual"))


def job_paths(spark, sf_dir):
    """The risk job's paths: 100,000 of 240 days a symbol, blocks from random starts."""
    return mc.bootstrap(clipped(spark, sf_dir))


@query()
def job_risk_table(spark, sf_dir):
    return log_tails(job_paths(spark, sf_dir))


@query()
def job_risk_tails(spark, sf_dir):
    return simple_tails(job_paths(spark, sf_dir))


@query()
def job_histogram(spark, sf_dir):
    return forty_bins(job_paths(spark, sf_dir))


@query()
def job_fan_chart(spark, sf_dir):
    x = mc.bootstrap_fan(clipped(spark, sf_dir), (5, 25, 50, 75, 95))
    return x.select("symbol", "day", *[_r(c).alias(c) for c in x.columns[2:]])


@query()
def job_path_risk(spark, sf_dir):
    return drawdown_figures(job_paths(spark, sf_dir))


@query()
def job_decision(spark, sf_dir):
    return decisions(job_paths(spark, sf_dir))


@query()
def job_stress(spark, sf_dir):
    return shocks(job_paths(spark, sf_dir), bars_orders(spark, sf_dir))


def best_allocation(x, low, step: float, steps: int):
    """symbol, f, u: the allocation low + k * step (k up to steps, within 0 and 1) with the greatest expected power utility."""
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    x = x.withColumn("f", _r(F.least(F.greatest(low + F.col("k") * step, F.lit(0.0)), F.lit(1.0)), 4))
    x = x.groupBy("symbol", "f").agg(F.avg(F.pow(F.greatest(1 + F.col("f") * F.col("ret"), F.lit(1e-6)), -2.0) / -2.0).alias("u"))
    first = Window.partitionBy("symbol").orderBy(F.desc(_r("u", 9)), "f")
    return x.withColumn("k", F.row_number().over(first)).where("k = 1").select("symbol", "f", "u")


@query()
def job_crra(spark, sf_dir):
    """Allocation on a grid of 0.001 with the greatest expected power utility (gamma 3).

    The utility is concave in the allocation, so the best point of the fine grid lies beside that of a coarse one.
    """
    x = cut(job_paths(spark, sf_dir).select("symbol", "ret"))
    coarse = best_allocation(x, F.lit(0.0), 0.025, 40).select("symbol", F.col("f").alias("low"))
    fine = best_allocation(x.join(coarse, "symbol"), F.col("low") - 0.025, 0.001, 50)
    return fine.select("symbol", F.col("f").alias("allocation"), _r("u").alias("utility"))
