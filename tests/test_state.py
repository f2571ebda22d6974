"""Streams with state, the keyed table and paged feeds: late and out-of-order rows, repeated batches, rewritten partitions, plans."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.sources import connectors, feeds
from tapeloom.sources.shared import files, new_folder, settings
from tapeloom.sources.tables import BarTable
from tapeloom.streaming import bars as s, state

DATA = "/root/testdata/sf0.001"
BAR = "symbol string, date date, open double, high double, low double, close double, volume double"


def stream_of(spark, parts, schema):
    """A stream whose batches are the given row lists, in this order."""
    path = new_folder(spark, "parts")
    for i, rows in enumerate(parts):
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
        spark.createDataFrame(frame, schema).coalesce(1).write.mode("append").parquet(path)
        if i < len(parts) - 1:
            import time

            time.sleep(1.1)  # files are taken by their time of change
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def plain_stops(ticks, stop, mark):
    out = []
    x = ticks[(ticks["ts"].dt.floor("h") + pd.Timedelta(hours=1)) <= mark].sort_values(["event_type", "ts", "event_id"])
    for (symbol, day), own in x.groupby(["event_type", x["ts"].dt.date]):
        peak = own["value"].cummax()
        hit = own[own["value"] <= peak * (1 - stop)]
        if len(hit):
            out.append((symbol, day, hit.iloc[0]["ts"].to_pydatetime(), "stop"))
        elif pd.Timestamp(day) + pd.Timedelta(days=1) <= mark:
            out.append((symbol, day, own.iloc[-1]["ts"].to_pydatetime(), "close"))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4])
def test_trailing_stops_do_not_depend_on_batches(spark, batches):
    """Rows out of order within the lateness, cut into batches: the stops of all rows in order."""
    ticks = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "event_type", "value").toPandas()
    ticks = ticks[ticks["ts"] < "2024-01-07"]
    ticks["arrives"] = ticks["ts"] + pd.to_timedelta((ticks["event_id"] * 37 % 40), unit="min")
    ticks = ticks.sort_values("arrives").drop(columns="arrives")
    size = -(-len(ticks) // batches)
    parts = [ticks.iloc[i : i + size].values.tolist() for i in range(0, len(ticks), size)]
    stream = stream_of(spark, parts, "event_id long, ts timestamp, event_type string, value double")
    got = s.run_once(state.trailing_stops(stream, 0.9, "1 hour"), "append").collect()
    mark = (ticks["ts"].max() - pd.Timedelta(hours=1)).floor("ms")
    want = plain_stops(ticks, 0.9, mark)
    assert sorted((r.symbol, r.day, r.exit_at, r.reason) for r in got) == want and {r[3] for r in want} == {"stop", "close"}


def test_late_ticks_are_dropped(spark):
    t = pd.Timestamp("2024-01-01")
    first = [(i, t + pd.Timedelta(hours=i), "a", 10.0) for i in range(0, 60, 2)]
    late = [(99, t + pd.Timedelta(hours=3), "a", 0.01), (100, t + pd.Timedelta(hours=74), "a", 10.0)]
    stream = stream_of(spark, [first, late], "event_id long, ts timestamp, event_type string, value double")
    got = s.run_once(state.trailing_stops(stream, 0.5, "1 hour"), "append").collect()
    assert {r.reason for r in got} == {"close"} and {r.ticks for r in got} == {12, 6}


def test_mean_goes_on_over_batches(spark):
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), "ab"[i % 2], float(i)) for i in range(40)]
    stream = stream_of(spark, [rows[:15], rows[15:]], "event_id long, ts timestamp, event_type string, value double")
    got = {r.symbol: (r.n, r.ewma) for r in s.run_once(state.ewma(stream), "update", ["symbol"], idle=False).collect()}
    for k in "ab":
        own = pd.Series([r[3] for r in rows if r[2] == k])
        assert got[k][0] == 20 and abs(got[k][1] - own.ewm(alpha=0.1, adjust=False).mean().iloc[-1]) < 1e-9


def bars(spark, rows):
    return spark.createDataFrame([(a, pd.Timestamp(d).date(), float(c), float(c), float(c), float(c), 1.0) for a, d, c in rows], BAR)


def closes(table):
    return sorted((r.symbol, str(r.date), r.close) for r in table.bars().collect())


def test_upsert_rewrites_touched_years_only(spark):
    table = BarTable(spark, buckets=4)
    table.upsert(bars(spark, [(x, f"{y}-03-0{d}", y + d) for x in "abc" for y in (2020, 2021, 2022) for d in (1, 2)]))
    before = files(spark, table.path)
    assert table.upsert(bars(spark, [("a", "2021-03-01", -1), ("a", "2021-03-09", -2), ("d", "2021-01-01", -3)])) == [2021]
    after = files(spark, table.path)
    assert {f.split("year=")[1][:4] for f in set(before) ^ set(after)} == {"2021"}
    got = closes(table)
    assert ("a", "2021-03-01", -1.0) in got and ("b", "2021-03-01", 2022.0) in got and len(got) == 18 + 2
    again = BarTable(spark, table.path, buckets=4)  # the same files under another name
    assert closes(again) == got and table.upsert(bars(spark, [])) == []
    assert table.upsert(spark.createDataFrame([(None, None, 1.0, 1.0, 1.0, 1.0, 1.0)], BAR)) == []


def test_the_last_of_equal_keys_stays(spark):
    table = BarTable(spark, buckets=2)
    x = bars(spark, [("a", "2021-01-01", 1), ("a", "2021-01-01", 2), ("a", "2021-01-01", 3)])
    table.upsert(x.withColumn("seq", 10 - F.col("close")), order="seq")
    assert closes(table) == [("a", "2021-01-01", 1.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_over_the_table(spark):
    table = BarTable(spark, buckets=8)
    table.upsert(bars(spark, [(f"s{i}", f"{y}-01-0{d}", i + 1) for i in range(40) for y in (2020, 2021) for d in range(1, 6)]))
    looked = table.lookup("s7", "2021-01-02")
    with settings(spark, spark__sql__sources__bucketing__autoBucketedScan__enabled="false"):  # else the plan hides which buckets are read
        assert "SelectedBucketsCount: 1 out of 8" in plan(table.lookup("s7", "2021-01-02"))
    assert "year" in plan(looked).split("PartitionFilters")[1][:200]
    assert len(looked.collect()) == 4
    x = table.bars().withColumn("lr", w.log_return())
    assert "Exchange" not in plan(x) and "Exchange" not in plan(table.high_water_mark())
    assert x.where("lr IS NOT NULL").count() == 40 * 9


def test_a_repeated_batch_leaves_the_table_as_it_was(spark):
    """The sink fails after it has put a batch; the stream runs that batch again."""
    ticks = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "event_type", "value").toPandas().sort_values("ts")
    parts = [ticks.iloc[i::3].values.tolist() for i in range(3)]
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = stream_of(spark, parts, schema)
    table, check, failed = BarTable(spark, buckets=4), new_folder(spark, "state"), []
    put = table.upsert

    def fails_once(rows, order=None):
        out = put(rows, order)
        if len(files(spark, f"{check}/offsets")) == 2 and not failed:
            failed.append(closes(table))
            raise RuntimeError("lost after the write")
        return out

    table.upsert = fails_once
    with pytest.raises(Exception, match="lost after the write"):
        s.upsert_bars(s.ohlc(stream, late="60 days"), table, check)
    s.upsert_bars(s.ohlc(stream, late="60 days"), table, check)
    want = spark.read.parquet(f"{DATA}/events.parquet").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.max_by("value", "ts").alias("c")).collect()
    assert failed and closes(table) == sorted((r.event_type, str(r.d), r.c) for r in want)


def chart(rows):
    return json.dumps({"t": [int(pd.Timestamp(d, tz="UTC").timestamp()) for d, _ in rows]} | {k: [float(c) for _, c in rows] for k in "ohlcv"})


def put_page(spark, path, symbol, mark, body):
    feeds.store_pages(spark.createDataFrame([(symbol, mark, body)], "symbol string, mark long, body string"), path)


def test_feed_in_batch_and_as_a_stream(spark):
    path = new_folder(spark, "feed")
    assert feeds.read_feed(spark, path).count() == 0
    put_page(spark, path, "A B/c", 1, chart([("2024-01-01", 1), ("2024-01-02", 2)]))
    put_page(spark, path, "x", 2, chart([("2024-01-01", 5)])[:40])
    put_page(spark, path, "x", 3, "")
    got = feeds.read_feed(spark, path)
    assert got.rdd.getNumPartitions() == 3 and sorted((r.symbol, r.mark) for r in got.collect())[0] == ("A B/c", 1)
    assert feeds.parse_chart(got).count() == 2
    seen, check = [], new_folder(spark, "state")

    def run():
        feeds.stream_feed(spark, path).writeStream.foreachBatch(lambda b, n: seen.append(sorted(r.mark for r in b.collect()))).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    run()
    put_page(spark, path, "y", 7, chart([("2024-01-05", 9)]))
    run()
    run()
    assert [x for x in seen if x] == [[1, 2, 3], [7]]


def test_sync_from_the_mark_with_live_candles(spark):
    path, check, table = new_folder(spark, "feed"), new_folder(spark, "state"), BarTable(spark, buckets=2)
    put_page(spark, path, "a", 10, chart([("2024-01-01", 1), ("2024-01-02", 2)]))
    feeds.sync(table, path, checkpoint=check)
    put_page(spark, path, "a", 20, chart([("2024-01-02", 22), ("2024-01-03", 3)]))
    put_page(spark, path, "b", 21, chart([("2024-01-03", 7)]))
    live = spark.createDataFrame([("a", pd.Timestamp("2024-01-03").date(), 33.0), ("b", pd.Timestamp("2024-01-04").date(), 8.0), ("c", pd.Timestamp("2024-01-04").date(), None)], "symbol string, date date, price double")
    got = feeds.sync(table, path, live, check)
    assert sorted((r.symbol, str(r.date), r.close, r.volume) for r in got.collect()) == [("a", "2024-01-01", 1, 1), ("a", "2024-01-02", 22, 22), ("a", "2024-01-03", 33, 0), ("b", "2024-01-03", 7, 7), ("b", "2024-01-04", 8, 0)]


def test_rates_of_odd_pages(spark):
    def page(*days):
        return json.dumps({"data": {"payload": [{"date": d, "rates": r} for d, r in days]}})

    def rate(iso, buy, sell):
        return {"currency": {"iso3": iso}, "buy": buy, "sell": sell}

    pages = [
        (1, page(("2024-01-01", [rate("EUR", "1", "3"), rate("USD", "100", "102")]), ("2024-01-02", [rate("usd", "x", "1")]), ("2024-01-03", None))),
        (2, page(("2024-01-01", [rate("USD", "110", 112)]), ("never", [rate("USD", "1", "1")]), ("2024-01-04", [{"currency": None, "buy": "1", "sell": "1"}, rate("USD", "1.5", "2.5")]))),
        (3, '{"data": {"payload": []}}'), (4, "<html>"), (5, None),
    ]
    got = feeds.mid_rates(spark.createDataFrame(pages, "mark long, body string"), "usd").collect()
    assert sorted((str(r.date), r.rate) for r in got) == [("2024-01-01", 111.0), ("2024-01-04", 2.0)]


def test_a_repeated_run_is_logged_once(spark):
    path = new_folder(spark, "log")
    day = lambda rows: spark.createDataFrame(rows, "symbol string, pnl double").repartition(3)
    connectors.append_log(day([("a", 1.0), ("b", 2.0)]), path, "2024-01-01")
    connectors.append_log(day([("a", 3.0)]), path, "2024-01-02")
    connectors.append_log(day([("a", 4.0)]), path, "2024-01-02")
    got = connectors.read_log(spark, path, "symbol string, pnl double").collect()
    assert sorted((r.run, r.symbol, r.pnl) for r in got) == [("2024-01-01", "a", 1.0), ("2024-01-01", "b", 2.0), ("2024-01-02", "a", 4.0)]
