"""Model queries: regimes, volatility, stationarity and the walk-forward signal of each symbol."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.operators import models, signal
from tapeloom.plans import factors
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders


def _returns(spark, sf_dir):
    return bars_orders(spark, sf_dir).withColumn("lr", w.log_return()).where("lr IS NOT NULL").select("symbol", "date", "close", "lr")


@query()
def gmm_regime(spark, sf_dir):
    x = _returns(spark, sf_dir).withColumn("vol", w.std("lr", 60) * math.sqrt(240))
    return models.by_symbol(x, lambda r: dict(zip(("regime", "confidence"), models.regime(r["vol"].to_numpy(float)))), "regime string, confidence double")


@query()
def garch_volatility(spark, sf_dir):
    """Most likely GARCH(1,1) of each symbol's percent returns, and the next day's deviation; NULL under 60 returns."""
    names = ("mean", "omega", "alpha", "beta", "next_vol")

    def fit(rows):
        return dict(zip(names, models.garch(rows["lr"].to_numpy(float)) if len(rows) >= 60 else (None,) * len(names)))

    return models.by_symbol(_returns(spark, sf_dir), fit, ", ".join(f"{n} double" for n in names))


@query()
def frac_diff_order(spark, sf_dir):
    """Smallest stationary order of fractional differences of each symbol."""
    return models.by_symbol(_returns(spark, sf_dir), lambda r: {"d": models.least_order(r["close"].to_numpy(float))}, "d double")


@query()
def signal_model(spark, sf_dir):
    """Walk-forward model of each symbol over the base and sector factors."""
    frame = factors.factor_frame(bars_orders(spark, sf_dir))
    return signal.signal(frame, factors.BASE + factors.SECTOR, factors.HORIZON)


@query(f"""WITH {BARS}, a AS (SELECT symbol, date, {d.log_return()} AS lr FROM bars), b AS (SELECT symbol, lr, CASE WHEN lead(lr) OVER ({d.OVER}) > 0 THEN 1 ELSE 0 END AS y, year(date) AS yr FROM a WHERE lr IS NOT NULL),
c AS (SELECT *, count(*) OVER (PARTITION BY symbol) / (2.0 * count(*) OVER (PARTITION BY symbol, y)) AS cw FROM b)
SELECT symbol, y, count(*) AS n, round(avg(cw), 6) AS class_weight, round(avg(CASE WHEN yr < 2018 THEN 0.6 ELSE 1.0 END), 6) AS era_weight FROM c GROUP BY 1, 2""")
def sample_weights(spark, sf_dir):
    """Balanced class weights and era weights."""
    from pyspark.sql import Window

    x = _returns(spark, sf_dir).withColumn("y", F.when(F.lead("lr").over(w.W) > 0, 1).otherwise(0))
    x = x.withColumn("cw", F.count("*").over(w.BY) / (2.0 * F.count("*").over(Window.partitionBy("symbol", "y"))))
    return x.groupBy("symbol", "y").agg(F.count("*").alias("n"), F.round(F.avg("cw"), 6).alias("class_weight"), F.round(F.avg(models.era_weight()), 6).alias("era_weight"))
