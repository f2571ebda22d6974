"""Queries over the scans, unions and upserts."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tapeloom.functions import duck as d, scans, windows as w
from tapeloom.plans.portfolio import weekly
from tapeloom.plans.registry import query
from tapeloom.sources import connectors
from tapeloom.sources.bars import BARS, BRAND_BARS, EVENT_BARS, bars_brand, bars_events, bars_orders, table


def _rounded(x, digits, *cols):
    return x.select("symbol", "date", *[F.round(c, digits).alias(c) for c in cols], "volume")


@query(f"WITH {BARS} SELECT symbol, sector, date, open, high, low, close, volume FROM bars")
def bars_daily(spark, sf_dir):
    return bars_orders(spark, sf_dir).select("symbol", "sector", "date", "open", "high", "low", "close", "volume")


@query(f"WITH {BRAND_BARS} SELECT symbol, date, round(high, 9) AS high, round(low, 9) AS low, round(close, 9) AS close, volume FROM bars")
def bars_by_brand(spark, sf_dir):
    return _rounded(bars_brand(spark, sf_dir), 9, "high", "low", "close")


@query(f"WITH {EVENT_BARS} SELECT symbol, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM bars")
def bars_by_event(spark, sf_dir):
    return _rounded(bars_events(spark, sf_dir), 4, "open", "high", "low", "close")


@query(f"WITH {BARS} SELECT symbol, max(date) AS latest FROM bars GROUP BY symbol")
def high_water_mark(spark, sf_dir):
    return connectors.high_water_mark(bars_orders(spark, sf_dir))


@query(f"WITH {BARS} SELECT date, open, high, low, close, volume FROM bars WHERE symbol = 'NATION_3' AND date >= DATE '1997-01-01' ORDER BY date")
def key_lookup(spark, sf_dir):
    x = bars_orders(spark, sf_dir).where("symbol = 'NATION_3' AND date >= '1997-01-01'")
    return x.select("date", "open", "high", "low", "close", "volume").orderBy("date")


@query("""WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, value, event_id, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS side FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY side DESC, event_id DESC) AS k FROM o) SELECT user_id, day, round(value, 6) AS value, event_id FROM r WHERE k = 1""")
def upsert_latest(spark, sf_dir):
    """Events keyed by user and day: clicks replace the others, the last click wins."""
    e = table(spark, sf_dir, "events").select("user_id", F.to_date(F.col("ts").cast("timestamp")).alias("day"), "value", "event_id", "event_type")
    first = Window.partitionBy("user_id", "day").orderBy(F.desc("event_id"))
    old = e.where("event_type <> 'click'").withColumn("k", F.row_number().over(first)).where("k = 1").drop("k", "event_type")
    new = e.where("event_type = 'click'").drop("event_type").withColumn("_seq", F.col("event_id"))
    return connectors.upsert(old, new, ["user_id", "day"]).select("user_id", "day", F.round("value", 6).alias("value"), "event_id")


@query("""WITH a AS (SELECT year(o_orderdate) AS year, round(avg(CASE WHEN o_orderpriority LIKE '1%' THEN o_totalprice END), 4) AS urgent FROM orders WHERE year(o_orderdate) < 2000 GROUP BY 1),
b AS (SELECT year(l_shipdate) AS year, round(avg(l_extendedprice), 4) AS shipped FROM lineitem WHERE year(l_shipdate) > 1995 GROUP BY 1) SELECT year::INT AS year, urgent, shipped FROM a FULL JOIN b USING (year)""")
def indicator_merge(spark, sf_dir):
    """Two yearly indicators of different coverage, full outer joined on the year."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = o.where(F.year("o_orderdate") < 2000).groupBy(F.year("o_orderdate").alias("year")).agg(F.round(F.avg(F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice"))), 4).alias("urgent"))
    b = l.where(F.year("l_shipdate") > 1995).groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.avg("l_extendedprice"), 4).alias("shipped"))
    return a.join(b, "year", "full_outer")


@query("""SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def json_props(spark, sf_dir):
    """Nested JSON fields as columns."""
    e = table(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k bigint")["k"])
    return e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(r"""SELECT page_id, regexp_extract(url, '//([^/]+)/', 1) AS host, regexp_extract(html, 'lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, TRY_CAST(regexp_extract(url, '/([0-9]+)[?]', 1) AS DOUBLE) AS price FROM pages""")
def page_quote(spark, sf_dir):
    """Fields scraped from page markup by pattern; a number that is missing is NULL."""
    r = lambda c, p: F.regexp_extract(c, p, 1)
    x = table(spark, sf_dir, "pages")
    return x.select("page_id", r("url", "//([^/]+)/").alias("host"), r("html", 'lang="([a-z]+)"').alias("lang"), r("html", "<title>([^<]*)</title>").alias("title"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)[?]', 1) AS double)").alias("price"))


@query("""WITH s AS (SELECT c_mktsegment AS symbol, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer WHERE c_acctbal > 0 GROUP BY 1)
SELECT symbol, 'ok' AS status, n, total FROM s UNION ALL SELECT c_mktsegment, 'negative', count(*), NULL FROM customer WHERE c_acctbal < 0 GROUP BY 1 UNION ALL SELECT 'TOTAL', 'summary', count(*), NULL FROM customer""")
def summary_union(spark, sf_dir):
    """Success, failure and total rows of different columns in one summary."""
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_mktsegment", "symbol")
    ok = c.where("c_acctbal > 0").groupBy("symbol").agg(F.lit("ok").alias("status"), F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))
    bad = c.where("c_acctbal < 0").groupBy("symbol").agg(F.lit("negative").alias("status"), F.count("*").alias("n"))
    total = c.agg(F.lit("TOTAL").alias("symbol"), F.lit("summary").alias("status"), F.count("*").alias("n"))
    return ok.unionByName(bad, allowMissingColumns=True).unionByName(total, allowMissingColumns=True)


_REGIONS = {"AFRICA": "africa", "AMERICA": "america", "ASIA": "asia", "EUROPE": "europe", "MIDDLE EAST": "middle_east"}


@query(f"""WITH {BARS}, m AS (SELECT date, {', '.join(f"avg(CASE WHEN sector = '{s}' THEN close END) AS {c}" for s, c in _REGIONS.items())} FROM bars GROUP BY date),
f AS (SELECT date, {', '.join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY date) AS {c}" for c in _REGIONS.values())} FROM m)
SELECT date, {', '.join(f"round({c}, 4) AS {c}" for c in _REGIONS.values())} FROM f WHERE {' AND '.join(f"{c} IS NOT NULL" for c in _REGIONS.values())}""")
def price_matrix(spark, sf_dir):
    """A date x sector matrix, gaps filled forward over ranges of dates, leading incomplete dates dropped."""
    m = bars_orders(spark, sf_dir).groupBy("date").pivot("sector", list(_REGIONS)).agg(F.avg("close"))
    m = m.select("date", *[F.col(s).alias(c) for s, c in _REGIONS.items()])
    f = scans.fill_forward(m, [], ["date"], list(_REGIONS.values())).na.drop()
    return f.select("date", *[F.round(c, 4).alias(c) for c in _REGIONS.values()])


# Deviations that make a bar an event, by kind of sector; bars of the look-back; events that a symbol must have.
EVENT_SIGMA, OTHER_SIGMA = {"banks and insurers": 0.8, "hydropower and microfinance": 0.5}, 0.6
LOOK_BACK, LEAST_EVENTS = 30, 120
#: The kinds of these tables' sectors.
_KINDS = {"AFRICA": "banks and insurers", "AMERICA": "banks and insurers", "ASIA": "hydropower and microfinance"}
_SIGMA = " ".join(f"WHEN sector = '{s}' THEN {EVENT_SIGMA[k]}" for s, k in _KINDS.items())


def event_or_weekly(bars, sigma):
    """(symbol, date, close, volume, kind): bars of large moves or volumes; weekly bars of symbols with too few of them."""
    x = bars.withColumn("lr", F.abs(w.log_return()))
    whole = F.stddev_samp("lr").over(w.BY)
    sd = F.coalesce(F.nullif(w.std("lr", LOOK_BACK), F.lit(0.0)), whole)
    high = w.mean("volume", LOOK_BACK) + sigma * F.nullif(w.std("volume", LOOK_BACK), F.lit(0.0))
    moved = F.coalesce(F.round("lr", 9) >= F.round(F.coalesce(sigma * sd, F.lit(0.0)), 9), F.lit(False))
    traded = F.coalesce(F.round("volume", 6) >= F.round(high, 6), F.lit(False))
    x = x.withColumn("event", moved | traded).withColumn("n", F.sum(F.col("event").cast("int")).over(w.BY))
    events = x.where(F.col("event") & (F.col("n") >= LEAST_EVENTS)).select("symbol", "date", "close", "volume", F.lit("event").alias("kind"))
    few = weekly(x.where(F.col("n") < LEAST_EVENTS))
    return events.unionByName(few.select("symbol", F.col("week").alias("date"), "close", "volume", F.lit("weekly").alias("kind")))


@query(f"""WITH {BARS}, a AS (SELECT *, abs({d.log_return()}) AS lr, CASE {_SIGMA} ELSE {OTHER_SIGMA} END AS sigma FROM bars),
b AS (SELECT *, coalesce(nullif(({d.std('lr', LOOK_BACK)}), 0), stddev_samp(lr) OVER (PARTITION BY symbol)) AS sd, ({d.mean('volume', LOOK_BACK)}) + sigma * nullif(({d.std('volume', LOOK_BACK)}), 0) AS vlim FROM a),
c AS (SELECT *, coalesce(round(lr, 9) >= round(coalesce(sigma * sd, 0.0), 9), false) OR coalesce(round(volume, 6) >= round(vlim, 6), false) AS event FROM b),
e AS (SELECT *, sum(event::INT) OVER (PARTITION BY symbol) AS n FROM c)
SELECT symbol, date, round(close, 2) AS close, volume, 'event' AS kind FROM e WHERE event AND n >= {LEAST_EVENTS}
UNION ALL SELECT symbol, date + ((5 - dayofweek(date) + 7) % 7)::INT, round(arg_max(close, date), 2), sum(volume), 'weekly' FROM e WHERE n < {LEAST_EVENTS} GROUP BY 1, 2""")
def event_bars(spark, sf_dir):
    """Event bars by the sigma of the symbol's sector, weekly bars where there are too few."""
    sigma = F.lit(OTHER_SIGMA)
    for sector, kind in _KINDS.items():
        sigma = F.when(F.col("sector") == sector, EVENT_SIGMA[kind]).otherwise(sigma)
    x = event_or_weekly(bars_orders(spark, sf_dir).withColumn("sigma", sigma), F.col("sigma"))
    return x.select("symbol", "date", F.round("close", 2).alias("close"), "volume", "kind")


@query("""WITH r AS (SELECT event_type AS namespace, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H-%M') ELSE strftime(ts, '%Y%m%dT%H%M%SZ') END AS run_id, CASE WHEN event_id % 2 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END AS t, event_id FROM events)
SELECT namespace, arg_max(run_id, epoch(t) * 1e6 + event_id) AS latest_run, count(*) AS runs FROM r GROUP BY namespace""")
def latest_run(spark, sf_dir):
    """Run ids in two formats, the latest by its parsed time."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    x = e.select(F.col("event_type").alias("namespace"), "event_id", F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH-mm")).otherwise(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'")).alias("run_id"))
    x = x.withColumn("at", connectors.parse_run_id(F.col("run_id")))
    return x.groupBy("namespace").agg(F.max_by("run_id", F.struct("at", "event_id")).alias("latest_run"), F.count("*").alias("runs"))
