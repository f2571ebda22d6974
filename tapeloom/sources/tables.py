"""A stored bar table with a key: one row a symbol and date, bucketed by symbol, partitioned by year.

Lookups of a symbol read one bucket; windows and aggregates by symbol need no shuffle; an upsert rewrites the years that it
touches and no others. A repeated upsert of the same rows gives the same table, so a stream may repeat a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeloom.sources.shared import files, new_folder, settings

COLUMNS = ("symbol", "date", "open", "high", "low", "close", "volume")
BUCKETS = 16


class BarTable:
    """The table at `path`, made there if it is missing."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path, self.name = path or new_folder(spark, "bars"), f"bars_{uuid.uuid4().hex}"
        prices = ", ".join(f"{c} DOUBLE" for c in COLUMNS[2:])
        spark.sql(
            f"CREATE TABLE {self.name} (symbol STRING, date DATE, {prices}, year INT) USING parquet PARTITIONED BY (year) "
            f"CLUSTERED BY (symbol) SORTED BY (date) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )
        if files(spark, self.path):
            spark.sql(f"ALTER TABLE {self.name} RECOVER PARTITIONS")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def bars(self) -> DataFrame:
        return self.rows().select(*COLUMNS)

    def lookup(self, symbol: str, since=None) -> DataFrame:
        """A symbol's bars in date order: one bucket, and the years from `since` on."""
        x = self.rows().where(F.col("symbol") == symbol)
        if since is not None:
            at = F.lit(since).cast("date")
            x = x.where((F.col("date") >= at) & (F.col("year") >= F.year(at)))
        return x.select(*COLUMNS).orderBy("date")

    def high_water_mark(self) -> DataFrame:
        """(symbol, latest), without a shuffle."""
        return self.rows().groupBy("symbol").agg(F.max("date").alias("latest"))

    def upsert(self, new: DataFrame, order: str | None = None) -> list[int]:
        """Put rows into the table; where keys meet, the new row stays, the last of them by `order`. Gives the years rewritten.

        Rows without a symbol or date have no key and are left out.
        """
        new = new.where("symbol IS NOT NULL AND date IS NOT NULL")
        seq = F.col(order).cast("double") if order else F.lit(0.0)
        new = new.select(*COLUMNS, F.year("date").alias("year"), F.lit(1).alias("_side"), seq.alias("_seq"))
        years = sorted(r.year for r in new.select("year").distinct().collect())
        if not years:
            return []
        old = self.rows().where(F.col("year").isin(years)).select(*COLUMNS, "year", F.lit(0).alias("_side"), F.lit(0.0).alias("_seq"))
        both = old.unionByName(new).repartition(self.buckets, "symbol")  # the table's own buckets: the write shuffles no more
        last = Window.partitionBy("symbol", "date").orderBy(F.desc("_side"), F.desc("_seq"), *[F.desc(c) for c in COLUMNS[2:]])
        merged = both.withColumn("_k", F.row_number().over(last)).where("_k = 1").select(*COLUMNS, "year")
        with settings(self.spark, spark__sql__sources__partitionOverwriteMode="dynamic"):
            merged.write.mode("overwrite").insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return years
