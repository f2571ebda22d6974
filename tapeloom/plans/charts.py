"""The data behind charts of return distributions: quantile pairs against the normal law, and densities."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, normal, windows as w
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders

# Returns that a quantile chart needs, and bins of a density chart.
LEAST_RETURNS, BINS = 10, 50

_LR = f"{BARS}, r AS (SELECT symbol, {d.log_return()} AS lr FROM bars), x AS (SELECT symbol, lr FROM r WHERE lr IS NOT NULL)"


def _returns(spark, sf_dir):
    return bars_orders(spark, sf_dir).withColumn("lr", w.log_return()).where("lr IS NOT NULL").select("symbol", "lr")


def qq(x, value: str = "lr", by: str = "symbol", least: int = LEAST_RETURNS):
    """(symbol, position, theoretical, empirical): sorted values beside the normal quantiles of their places, by mean and deviation."""
    own = Window.partitionBy(by)
    x = x.withColumns({"n": F.count(value).over(own), "mean": F.avg(value).over(own), "sd": F.stddev_samp(value).over(own), "position": F.row_number().over(own.orderBy(value))})
    x = x.where(F.col("n") >= least)
    at = normal.quantile((F.col("position") - 0.5) / F.col("n"))
    return x.select(by, "position", (at * F.col("sd") + F.col("mean")).alias("theoretical"), F.col(value).alias("empirical"))


@query(f"""WITH {_LR}, n AS (SELECT symbol, lr, count(*) OVER s AS n, avg(lr) OVER s AS mean, stddev_samp(lr) OVER s AS sd, row_number() OVER (PARTITION BY symbol ORDER BY lr) AS position FROM x WINDOW s AS (PARTITION BY symbol)),
p AS (SELECT *, (position - 0.5)::DOUBLE / n AS p FROM n WHERE n >= {LEAST_RETURNS}), {normal.quantile_sql("p", "p", "z")}
SELECT symbol, position, round(z * sd + mean, 6) AS theoretical, round(lr, 6) AS empirical FROM q3""")
def qq_points(spark, sf_dir):
    """Quantile pairs of each symbol's returns."""
    x = qq(_returns(spark, sf_dir))
    return x.select("symbol", "position", F.round("theoretical", 6).alias("theoretical"), F.round("empirical", 6).alias("empirical"))


def densities(x, value: str = "lr", by: str = "symbol", bins: int = BINS):
    """(symbol, bin, middle, empirical, normal): shares of equal bins over their width, beside the normal density in their middle."""
    ends = x.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    ends = ends.where("n > 2 AND hi > lo").withColumn("width", (F.col("hi") - F.col("lo")) / bins)
    place = F.least(F.floor(F.round((F.col(value) - F.col("lo")) / F.col("width"), 9)), F.lit(bins - 1)).cast("int")
    held = x.join(ends.select(by, "lo", "width"), by).groupBy(by, place.alias("bin")).agg(F.count("*").alias("k"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    middle = F.col("lo") + (F.col("bin") + 0.5) * F.col("width")
    out = every.join(held, [by, "bin"], "left")
    return out.select(by, "bin", middle.alias("middle"), (F.coalesce("k", F.lit(0)) / F.col("n") / F.col("width")).alias("empirical"), normal.density(middle, F.col("mean"), F.col("sd")).alias("normal"))


@query(f"""WITH {_LR}, e AS (SELECT symbol, min(lr) AS lo, count(*) AS n, avg(lr) AS mean, stddev_samp(lr) AS sd, (max(lr) - min(lr)) / {BINS} AS width FROM x GROUP BY symbol HAVING count(*) > 2 AND max(lr) > min(lr)),
h AS (SELECT symbol, least(floor(round((lr - lo) / width, 9)), {BINS - 1})::INT AS bin, count(*) AS k FROM x JOIN e USING (symbol) GROUP BY 1, 2),
b AS (SELECT *, unnest(range(0, {BINS}))::INT AS bin FROM e), m AS (SELECT *, lo + (bin + 0.5::DOUBLE) * width AS mid FROM b)
SELECT m.symbol, m.bin, round(mid, 6) AS middle, round(coalesce(k, 0)::DOUBLE / n / width, 4) AS empirical, round(exp(-pow((mid - mean) / sd, 2) / 2) / (sd * sqrt(2 * pi())), 4) AS normal FROM m LEFT JOIN h ON h.symbol = m.symbol AND h.bin = m.bin""")
def return_density(spark, sf_dir):
    """Density of each symbol's returns and the normal density of the same mean and deviation."""
    x = densities(_returns(spark, sf_dir))
    return x.select("symbol", "bin", F.round("middle", 6).alias("middle"), F.round("empirical", 4).alias("empirical"), F.round("normal", 4).alias("normal"))
