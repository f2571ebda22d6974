"""Queries over paged feeds and the stored bar table. Their pages are made of the tables by Spark and read through the source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import duck as d, windows as w
from tapeloom.plans.registry import query
from tapeloom.sources import feeds
from tapeloom.sources.bars import BARS, bars_orders, table
from tapeloom.sources.connectors import parse_chart
from tapeloom.sources.shared import new_folder
from tapeloom.sources.tables import COLUMNS, BarTable


def chart_pages(bars, extra=()):
    """A page a symbol and year: JSON arrays of the bars, marked with the last time stamp."""
    at = F.unix_seconds(F.col("date").cast("timestamp"))
    row = F.struct(at.alias("t"), *[F.col(c).alias(c[0]) for c in COLUMNS[2:]])
    x = bars.groupBy("symbol", F.year("date").alias("year")).agg(F.sort_array(F.collect_list(row)).alias("b"), F.max(at).alias("mark"))
    return x.select("symbol", "mark", F.to_json(F.struct(*[F.col("b")[k].alias(k) for k in "tohlcv"])).alias("body"), *extra)


def _broken(pages):
    """Every symbol's last page once more, cut off in the middle, under a later mark."""
    last = pages.groupBy("symbol").agg((F.max("mark") + 1).alias("mark"), F.max_by("body", "mark").alias("body"))
    return last.withColumn("body", F.expr("left(body, cast(length(body) / 2 AS int))"))


@query(f"WITH {BARS} SELECT symbol, date, open, high, low, close, volume FROM bars")
def feed_chart(spark, sf_dir):
    """Bars read back from chart pages, a partition a page; broken pages give no row."""
    path, pages = new_folder(spark, "charts"), chart_pages(bars_orders(spark, sf_dir))
    feeds.store_pages(pages.unionByName(_broken(pages)), path)
    return parse_chart(feeds.read_feed(spark, path))


@query("""WITH q AS (SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS buy, max(o_totalprice) AS sell, count(*) AS n FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY 1)
SELECT date, round((buy + sell) / 2, 6) AS rate FROM q WHERE n > 1""")
def feed_rates(spark, sf_dir):
    """The mid price of one currency from nested rate pages, a page a month; a side that is no number gives no rate."""
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", F.concat(F.lit("c"), F.substring("o_orderpriority", 1, 1), F.lit("x")).alias("iso3"))
    side = lambda f: f("o_totalprice").cast("string")
    q = o.groupBy("date", "iso3").agg(side(F.min).alias("buy"), F.when(F.count("*") > 1, side(F.max)).otherwise(F.lit("N/A")).alias("sell"))
    rate = F.struct(F.struct("iso3").alias("currency"), "buy", "sell")
    days = q.groupBy("date").agg(F.collect_list(rate).alias("rates"))
    month = (F.year("date") * 12 + F.month("date")).cast("long")
    entry = F.collect_list(F.struct(F.col("date").cast("string").alias("date"), "rates"))
    pages = days.groupBy(month.alias("mark")).agg(F.to_json(F.struct(F.struct(entry.alias("payload")).alias("data"))).alias("body")).select(F.lit("rates").alias("symbol"), "mark", "body")
    path = new_folder(spark, "rates")
    feeds.store_pages(pages.unionByName(_broken(pages)), path)
    return feeds.mid_rates(feeds.read_feed(spark, path), "C1X").select("date", F.round("rate", 6).alias("rate"))


@query(f"""WITH {BARS}, l AS (SELECT symbol, max(date) AS last, arg_max(high, date) AS price FROM bars GROUP BY symbol)
SELECT symbol, date, CASE WHEN date = last THEN price ELSE open END AS open, CASE WHEN date = last THEN price ELSE high END AS high,
    CASE WHEN date = last THEN price ELSE low END AS low, CASE WHEN date = last THEN price ELSE close END AS close, CASE WHEN date = last THEN 0 ELSE volume END AS volume FROM bars JOIN l USING (symbol)""")
def feed_sync(spark, sf_dir):
    """A bar table brought up to date twice: the second pull reads only pages beyond the mark; live candles replace the last day."""
    bars = bars_orders(spark, sf_dir)
    path, state, stored = new_folder(spark, "charts"), new_folder(spark, "state"), BarTable(spark)
    feeds.store_pages(chart_pages(bars.where(F.year("date") < 1996)), path)
    feeds.sync(stored, path, checkpoint=state)
    feeds.store_pages(chart_pages(bars.where(F.year("date") >= 1996)), path)
    live = bars.groupBy("symbol").agg(F.max("date").alias("date"), F.max_by("high", "date").alias("price"))
    return feeds.sync(stored, path, live, state)


def _stored(spark, sf_dir):
    """The bars in a table, those of 1997 put in again with their highest price as close."""
    bars, stored = bars_orders(spark, sf_dir), BarTable(spark)
    stored.upsert(bars)
    stored.upsert(bars.where(F.year("date") == 1997).withColumn("close", F.col("high")))
    return stored


_REVISED = f"{BARS}, stored AS (SELECT symbol, date, open, high, low, CASE WHEN year(date) = 1997 THEN high ELSE close END AS close, volume FROM bars)"


@query(f"WITH {_REVISED} SELECT * FROM stored")
def stored_bars(spark, sf_dir):
    """All rows of the table after an upsert that rewrites one year."""
    return _stored(spark, sf_dir).bars()


@query(f"WITH {_REVISED} SELECT * FROM stored WHERE symbol = 'NATION_3' AND date >= DATE '1997-06-01'")
def stored_lookup(spark, sf_dir):
    """A symbol's rows since a date: one bucket of the years since then."""
    return _stored(spark, sf_dir).lookup("NATION_3", "1997-06-01")


@query(f"WITH {_REVISED}, r AS (SELECT symbol, date, {d.log_return()} AS lr FROM stored) SELECT symbol, count(lr) AS n, round(avg(lr), 9) AS mean, round(stddev_samp(lr), 9) AS sigma, max(date) AS latest FROM r GROUP BY symbol")
def stored_returns(spark, sf_dir):
    """Return figures of each symbol by windows over the table, without a shuffle."""
    x = _stored(spark, sf_dir).bars().withColumn("lr", w.log_return())
    return x.groupBy("symbol").agg(F.count("lr").alias("n"), F.round(F.avg("lr"), 9).alias("mean"), F.round(F.stddev_samp("lr"), 9).alias("sigma"), F.max("date").alias("latest"))
