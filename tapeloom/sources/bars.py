"""Bar panels (symbol, sector, date, open, high, low, close, volume) over the star-schema tables, and a macro series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_symbol(bars: DataFrame) -> DataFrame:
    """bars dealt by symbol, as every window over them needs. Windows cost far more than their rows' bytes tell, so the number
    of partitions is given: adaptive execution would merge them by bytes."""
    return bars.repartition(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of nations: prices are order totals, the first and last order of a day open and close it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bars = joined.groupBy(F.col("n_name").alias("symbol"), F.col("r_name").alias("sector"), "date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"),
        F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.count("*").cast("double").alias("volume"),
    )
    return by_symbol(bars)


def bars_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of part brands: unit prices, closing at the volume-weighted mean."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    item = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", F.to_date("l_shipdate").alias("date"))
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return item.join(part, item.l_partkey == part.p_partkey).groupBy("symbol", "date").agg(
        F.max(price).alias("high"), F.min(price).alias("low"), (F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )


def bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of event types."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("symbol", F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").cast("double").alias("volume")
    )


def macro_yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order value of each year, dated at the year's last day."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("value")).select(F.make_date("year", F.lit(12), F.lit(31)).alias("date"), "value")


BARS = """bars AS (
    SELECT n_name AS symbol, r_name AS sector, CAST(o_orderdate AS DATE) AS date, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
        min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY 1, 2, 3)"""
BRAND_BARS = """bars AS (
    SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        sum(l_extendedprice) / sum(l_quantity) AS close, sum(l_quantity) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
EVENT_BARS = """bars AS (
    SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*)::DOUBLE AS volume
    FROM events GROUP BY 1, 2)"""
MACRO = "macro AS (SELECT make_date(year(o_orderdate)::INT, 12, 31) AS date, avg(o_totalprice) AS value FROM orders GROUP BY 1)"
