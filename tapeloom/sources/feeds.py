"""Paged feeds as a data source: stored payload pages in, parsed rows out, in batches or as a stream.

A page is a file <folder>/symbol=<symbol>/mark=<mark>/<any name>; the mark grows with time, as the last time stamp of a chart or
a page's number does. The source reads one page in each input partition and gives its text; the JSON is parsed by Spark. As a
stream its offset is the high-water mark: the greatest mark that has been read.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tapeloom.sources.connectors import parse_chart
from tapeloom.sources.tables import BarTable

FORMAT = "paged_feed"
_PAGE = re.compile(r"symbol=([^/]+)/mark=(-?\d+)/[^/_.][^/]*$")


def _files(uri: str):
    """(file system, path) of a folder on any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else re.sub(r"^(file:)?/+", "file:///", uri))


class Page(InputPartition):
    def __init__(self, path: str, symbol: str, mark: int):
        self.path, self.symbol, self.mark = path, symbol, mark


def pages(uri: str) -> list[Page]:
    """All pages below a folder, by mark."""
    from pyarrow import fs

    store, root = _files(uri)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    named = [(f.path, m) for f in found if f.type == fs.FileType.File and (m := _PAGE.search(f.path))]
    return sorted((Page(p, unquote(m[1]), int(m[2])) for p, m in named), key=lambda p: (p.mark, p.symbol, p.path))


def _read(uri: str, page: Page):
    store, _ = _files(uri)
    with store.open_input_stream(page.path) as f:
        yield page.symbol, page.mark, f.read().decode("utf-8", "replace")


class _Reader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self):
        return pages(self.uri)

    def read(self, partition):
        if isinstance(partition, Page):  # without pages Spark asks for one partition that is none
            yield from _read(self.uri, partition)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, uri: str, since: int | None):
        self.uri, self.since = uri, since

    def initialOffset(self) -> dict:
        return {"mark": self.since}

    def latestOffset(self) -> dict:
        return {"mark": max((p.mark for p in pages(self.uri)), default=self.since)}

    def partitions(self, start: dict, end: dict):
        low, high = start["mark"], end["mark"]
        return [p for p in pages(self.uri) if (low is None or p.mark > low) and high is not None and p.mark <= high]

    def read(self, partition):
        if isinstance(partition, Page):
            yield from _read(self.uri, partition)

    def commit(self, end: dict) -> None:
        pass


class PagedFeed(DataSource):
    """Options: path; `since`, a mark after which a stream starts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "symbol string, mark long, body string"

    def reader(self, schema):
        return _Reader(self.options["path"])

    def streamReader(self, schema):
        since = self.options.get("since")
        return _StreamReader(self.options["path"], None if since is None else int(since))


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, mark, body) of all pages."""
    spark.dataSource.register(PagedFeed)
    return spark.read.format(FORMAT).load(path)


def stream_feed(spark: SparkSession, path: str, since: int | None = None) -> DataFrame:
    """The same as a stream, from the pages after mark `since` on."""
    spark.dataSource.register(PagedFeed)
    x = spark.readStream.format(FORMAT)
    return (x if since is None else x.option("since", since)).load(path)


def store_pages(pages: DataFrame, path: str) -> None:
    """Pages (symbol, mark, body) as files of the layout above, one file a page."""
    pages.repartition("symbol", "mark").write.mode("append").partitionBy("symbol", "mark").text(path)


RATES = "data struct<payload: array<struct<date: string, rates: array<struct<currency: struct<iso3: string>, buy: string, sell: string>>>>>"


def mid_rates(pages: DataFrame, iso3: str) -> DataFrame:
    """(date, rate): mid price of a currency from nested rate pages. A page that does not parse gives no row, a date without the
    currency or without two numbers none either; of several pages with one date the last counts."""
    x = pages.select("mark", F.inline(F.from_json("body", RATES)["data"]["payload"]))
    match = F.filter("rates", lambda r: F.upper(r["currency"]["iso3"]) == iso3.upper())
    x = x.select("mark", F.try_to_timestamp("date").cast("date").alias("date"), F.get(match, F.lit(0)).alias("r"))
    x = x.withColumn("rate", F.expr("(try_cast(r.buy AS double) + try_cast(r.sell AS double)) / 2")).where("date IS NOT NULL AND rate IS NOT NULL")
    return x.groupBy("date").agg(F.max_by("rate", "mark").alias("rate"))


def sync(table: BarTable, path: str, live: DataFrame | None = None, checkpoint: str | None = None) -> DataFrame:
    """Bring a bar table up to date: the feed's pages after what the checkpoint has seen, then the live candles, then reread.

    Each batch of pages is upserted under its number; a batch that is repeated after a failure gives the same table. Of bars of
    one date the later page counts, and a live candle (symbol, date, price) replaces the feed's bar of its day.
    """
    spark = table.spark

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(parse_chart(batch, keep=("mark",)), order="mark")

    q = stream_feed(spark, path).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint or f"{table.path}-feed").trigger(availableNow=True).start()
    q.awaitTermination()
    if live is not None:
        price = [F.col("price").alias(c) for c in ("open", "high", "low", "close")]
        table.upsert(live.where("price IS NOT NULL").select("symbol", "date", *price, F.lit(0.0).alias("volume")))
    return table.bars()
