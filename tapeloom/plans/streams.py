"""Streaming queries, each checked against its batch equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.registry import query
from tapeloom.sources.shared import new_folder
from tapeloom.sources.tables import BarTable
from tapeloom.streaming import bars as s, state

#: Share below the peak that stops a position: these events' values jump, so a narrow stop would act at once.
STOP = 0.98


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS date, round(arg_min(value, ts), 4) AS open, round(max(value), 4) AS high, round(min(value), 4) AS low, round(arg_max(value, ts), 4) AS close, count(*) AS volume FROM events GROUP BY 1, 2""")
def stream_ohlc(spark, sf_dir):
    x = s.run_once(s.ohlc(s.ticks(spark, sf_dir)), "complete")
    return x.select("symbol", F.to_date("w.start").alias("date"), *[F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")], "volume")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    return s.run_once(s.distinct_users(s.ticks(spark, sf_dir)), "append").select("user_id", "event_type")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS first FROM events), k AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts) AS sess FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM k GROUP BY user_id, sess""")
def stream_session(spark, sf_dir):
    x = s.run_once(s.sessions(s.ticks(spark, sf_dir)), "complete")
    return x.select("user_id", F.col("s.start").cast("timestamp_ntz").alias("start"), "n", F.round("total", 4).alias("total"))


@query("""WITH l AS (SELECT event_type AS symbol, list(value ORDER BY ts) AS v FROM events GROUP BY 1) SELECT symbol, len(v)::BIGINT AS n, round(list_reduce(v, lambda a, x: a * 0.9 + x * 0.1), 6) AS ewma FROM l""")
def stream_ewma(spark, sf_dir):
    x = s.run_once(state.ewma(s.ticks(spark, sf_dir)), "update", ["symbol"], idle=False)
    return x.select("symbol", "n", F.round("ewma", 6).alias("ewma"))


@query(f"""WITH m AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR AS mark FROM events),
t AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, ts, event_id, value FROM events, m WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark),
p AS (SELECT *, max(value) OVER o AS peak, first_value(value) OVER o AS entry, row_number() OVER o AS k, count(*) OVER (PARTITION BY symbol, day) AS n FROM t WINDOW o AS (PARTITION BY symbol, day ORDER BY ts, event_id)),
x AS (SELECT *, value <= peak * {1 - STOP!r} AS stopped FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY k) AS first FROM x, m WHERE stopped OR k = n AND day + INTERVAL 1 DAY <= mark)
SELECT symbol, day, entry, peak, ts AS exit_at, value AS exit, k AS ticks, CASE WHEN stopped THEN 'stop' ELSE 'close' END AS reason FROM r WHERE first = 1""")
def stream_trailing_stop(spark, sf_dir):
    """Positions of each type and day, stopped below their peak or closed by the day's timer, as far as the watermark has come."""
    x = s.run_once(state.trailing_stops(s.ticks(spark, sf_dir), STOP), "append")
    return x.withColumn("exit_at", F.col("exit_at").cast("timestamp_ntz"))


@query("""WITH w AS (SELECT *, unnest(generate_series(0, 3)) AS back FROM events), b AS (SELECT event_type AS symbol, value, time_bucket(INTERVAL 6 HOUR, ts) - back * INTERVAL 6 HOUR AS start FROM w)
SELECT symbol, start, round(stddev_samp(value), 6) AS vol, round(sum(value), 4) AS total, count(*) AS n FROM b GROUP BY 1, 2""")
def stream_sliding(spark, sf_dir):
    """Volatility in windows of a day that begin every six hours."""
    x = s.run_once(state.sliding(s.ticks(spark, sf_dir)), "complete")
    return x.select("symbol", F.col("w.start").cast("timestamp_ntz").alias("start"), F.round("vol", 6).alias("vol"), F.round("total", 4).alias("total"), "n")


@query("""SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2""")
def stream_upsert(spark, sf_dir):
    """Daily bars of a stream, upserted batch by batch into a keyed table."""
    table = BarTable(spark, buckets=4)
    s.upsert_bars(s.ohlc(s.ticks(spark, sf_dir)), table, new_folder(spark, "state"))
    return table.bars()
