"""The market scanner: regime metrics and model scores of each symbol relative to its sector."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.operators import calibration
from tapeloom.plans import features, risk, trading
from tapeloom.plans.registry import ORACLE_SQL, query
from tapeloom.sources import connectors
from tapeloom.sources.bars import BARS, bars_orders, by_symbol
from tapeloom.sources.shared import cut, new_folder

# Bars of the entropy and of the efficiency ratio, bars that a symbol must have, the regime gate, the tail
# loss of a symbol without a risk record.
ENTROPY_BARS, EFFICIENCY_BARS, LEAST_BARS = 60, 30, 60
GATE_ENTROPY, GATE_EFFICIENCY = 0.82, 0.25
DEFAULT_TAIL = -0.05


def scan(bars: DataFrame, models: DataFrame, tails: DataFrame) -> DataFrame:
    """Symbols by composite score: the sector's z of the model score, plus twice the efficiency, less twice the entropy.

    bars: (symbol, sector, date, close); models: (symbol, cv_score); tails: (symbol, es_95). Symbols with too few bars or
    without a model score, and those in a noisy market without a trend, are left out. One shuffle by symbol, then one row a
    symbol; a sector's deviation of 0, or of a single symbol, gives an alpha of 0.
    """
    back = F.row_number().over(w.BY.orderBy(F.desc("date")))
    x = bars.select("symbol", "sector", "date", "close", F.count("*").over(w.BY).alias("n"), back.alias("back"))
    x = x.where(F.col("back") <= max(ENTROPY_BARS, EFFICIENCY_BARS) + 1)  # the last bar's figures need no more rows
    x = features.entropy(x, "close", ENTROPY_BARS)
    step, ratio = features.efficiency("close", EFFICIENCY_BARS)
    x = x.withColumn("step", step).withColumn("efficiency", ratio("step"))
    x = x.groupBy("symbol", "sector").agg(F.max("n").alias("n"), *[F.max_by(c, "date").alias(k) for c, k in (("close", "price"), ("entropy", "entropy"), ("efficiency", "efficiency"))])
    x = x.where(F.col("n") >= LEAST_BARS).join(models.where("cv_score IS NOT NULL"), "symbol").join(tails, "symbol", "left")
    x = x.where(~((F.round("entropy", 9) > GATE_ENTROPY) & (F.round("efficiency", 9) < GATE_EFFICIENCY)))
    s = Window.partitionBy("sector")
    alpha = (F.col("cv_score") - F.avg("cv_score").over(s)) / F.nullif(F.stddev_samp("cv_score").over(s), F.lit(0.0))
    x = x.withColumn("alpha", F.coalesce(alpha, F.lit(0.0)))
    tail = F.abs(F.coalesce(F.nullif("es_95", F.lit(0.0)), F.lit(DEFAULT_TAIL)))
    return x.withColumns({"tail": tail, "score": F.col("alpha") + 2 * F.col("efficiency") - 2 * F.col("entropy")})


def stored_scores(models: DataFrame, path: str) -> DataFrame:
    """(symbol, cv_score) of models whose scores are written as artifacts of a run and read back, as the scanner finds them."""
    at = connectors.write_artifacts(models.select("symbol", "cv_score"), path, "cv", "latest")
    return connectors.read_artifacts(models.sparkSession, at, "cv_score double")


def _scan(spark, sf_dir, probabilities=None) -> DataFrame:
    bars = by_symbol(cut(bars_orders(spark, sf_dir), "bars"))
    models = stored_scores(trading.fold_metrics(spark, sf_dir, probabilities, bars), new_folder(spark, "artifacts"))
    return scan(bars, models, risk.risk_tails(spark, sf_dir, bars).select("symbol", "es_95"))


_SCAN = f"""{BARS}, {features.entropy_sql("bars", "close", ENTROPY_BARS)},
f1 AS (SELECT *, abs(close - {d.lag("close")}) AS step FROM bars),
f2 AS (SELECT symbol, sector, date, close, coalesce(abs(close - {d.lag("close", EFFICIENCY_BARS)}) / nullif(({d.roll("sum", "step", EFFICIENCY_BARS)}), 0), 0.0) AS eff FROM f1),
f3 AS (SELECT symbol, sector, count(*) AS n, arg_max(close, date) AS price, arg_max(entropy, date) AS ent, arg_max(eff, date) AS eff FROM f2 JOIN e6 USING (symbol, date) GROUP BY 1, 2),
cv AS ({ORACLE_SQL["fold_metrics"]}), rt AS ({ORACLE_SQL["risk_tails"]}),
f4 AS (SELECT f3.*, cv_score, es_95 FROM f3 JOIN cv USING (symbol) LEFT JOIN rt USING (symbol)
    WHERE n >= {LEAST_BARS} AND cv_score IS NOT NULL AND NOT (round(ent, 9) > {GATE_ENTROPY} AND round(eff, 9) < {GATE_EFFICIENCY})),
f5 AS (SELECT *, coalesce((cv_score - avg(cv_score) OVER (PARTITION BY sector)) / nullif(stddev_samp(cv_score) OVER (PARTITION BY sector), 0), 0.0) AS alpha FROM f4),
f6 AS (SELECT *, abs(coalesce(nullif(es_95, 0), {DEFAULT_TAIL})) AS tail, alpha + 2 * eff - 2 * ent AS score FROM f5)"""


@query(f"""WITH {_SCAN} SELECT symbol, sector, round(price, 2) AS price, cv_score, round(ent, 6) AS entropy, round(eff, 6) AS efficiency,
    round(tail, 6) AS es_95, round(alpha, 6) AS relative_alpha, round(score, 6) AS final_score FROM f6 ORDER BY final_score DESC""")
def flagship_sector_score(spark, sf_dir, probabilities=None):
    """Composite score of each symbol, best first. The model scores are those of the stand-in probabilities (`trading.history`)."""
    x = _scan(spark, sf_dir, probabilities)
    r = lambda c, k=6: F.round(c, k)
    out = x.select(
        "symbol",
        "sector",
        r("price", 2).alias("price"),
        "cv_score",
        r("entropy").alias("entropy"),
        r("efficiency").alias("efficiency"),
        r("tail").alias("es_95"),
        r("alpha").alias("relative_alpha"),
        r("score").alias("final_score"),
    )
    return out.orderBy(F.desc("final_score"))


@query(f"""WITH {_SCAN} SELECT sector, symbol, round(score, 6) AS final_score FROM f6 WHERE round(score, 9) > 0 ORDER BY final_score DESC""")
def top_picks(spark, sf_dir, probabilities=None):
    """Symbols with a positive composite score, best first."""
    x = _scan(spark, sf_dir, probabilities).where(F.round("score", 9) > 0)
    return x.select("sector", "symbol", F.round("score", 6).alias("final_score")).orderBy(F.desc("final_score"))


@query()
def scan_by_model(spark, sf_dir):
    """The scanner over probabilities that models fitted on earlier days gave each bar."""
    bars = cut(bars_orders(spark, sf_dir), "bars")
    found = calibration.fit(cut(calibration.panel(by_symbol(bars)), "panel"), new_folder(spark, "models"))
    return flagship_sector_score(spark, sf_dir, cut(found, "probabilities"))
