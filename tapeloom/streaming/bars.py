"""Streaming forms: bars from ticks, deduplication, sessions, upserts of batches into a keyed bar table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tapeloom.sources.shared import new_folder, settings
from tapeloom.sources.tables import BarTable

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"

ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files; event time is a plain timestamp, which watermarks need."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def ohlc(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Tumbling bars by event type."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume")
    )


def sessions(stream: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def distinct_users(stream: DataFrame, late: str = "40 days") -> DataFrame:
    """First event of each user and type, with duplicates dropped while the watermark keeps their state."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "event_type"])


def upsert_bars(stream: DataFrame, table: BarTable, checkpoint: str) -> None:
    """Bring the bars (symbol, w, open ...) of a stream in update mode into a keyed table, batch by batch: the latest state of a
    bar stays. A batch that is repeated after a failure puts the same rows again, so the table does not change."""

    def put(batch: DataFrame, number: int) -> None:
        table.upsert(batch.select("symbol", F.to_date("w.start").alias("date"), "open", "high", "low", "close", F.col("volume").cast("double").alias("volume")))

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_once(stream: DataFrame, mode: str, keys: list[str] | None = None, idle: bool = True) -> DataFrame:
    """Run a stream over what is there now and return its table: every batch is written by its number, so a repeated batch
    replaces itself. For complete mode the last batch is the table; else the last row of each key, or all rows. `idle`: whether
    batches without rows run too, as event-time timers need; a stream on processing time would go on with them for ever."""
    spark = stream.sparkSession
    root = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS_DB, spark__sql__streaming__noDataMicroBatches__enabled=str(idle).lower()):  # states with timers need this store
        q = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/out")
    if mode == "complete":
        last = out.agg(F.max("batch").alias("batch"))
        return out.join(F.broadcast(last), "batch").drop("batch")
    if keys:
        rest = [c for c in out.columns if c not in (*keys, "batch")]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    return out.drop("batch")
