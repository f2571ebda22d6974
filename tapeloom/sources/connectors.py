"""Readers and writers: CSV and JSON bars, feeds, upserts, artifacts, and a file-drop job queue."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

BAR_SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume double"


def read_bars_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bars from CSV with a header; what does not parse is NULL."""
    return spark.read.csv(path, header=True, schema=BAR_SCHEMA, mode="PERMISSIVE")


def price_matrix(raw: DataFrame, order: str | None = None) -> DataFrame:
    """Long (date, asset, price) from a wide table whose columns may hold anything.

    The date column is `Date`, else the first whose name holds "date", else the first. Of rows with one date the last (by
    `order`, else by file order) counts. Columns without a number are no assets. Gaps take the asset's last price.
    """
    names = raw.columns
    date = next((c for c in names if c.strip() == "Date"), next((c for c in names if "date" in c.lower()), names[0]))
    row = F.col(order) if order else F.monotonically_increasing_id()
    x = raw.select(F.try_to_timestamp(F.col(date).cast("string")).cast("date").alias("date"), row.alias("_row"), *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in names if c not in (date, order)]).where("date IS NOT NULL")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("_row")))).where("_k = 1").drop("_k", "_row")
    assets = [c for c in x.columns if c != "date"]
    long = x.select("date", F.inline(F.array(*[F.struct(F.lit(c.strip()).alias("asset"), F.col(c).alias("price")) for c in assets])))
    w = Window.partitionBy("asset").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn("price", F.last("price", ignorenulls=True).over(w)).where("price IS NOT NULL")


def parse_chart(payloads: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Bars from a feed's JSON arrays t, o, h, l, c, v, with columns to keep; a payload that does not parse gives none."""
    x = payloads.withColumn("j", F.from_json(body, "t array<bigint>, o array<double>, h array<double>, l array<double>, c array<double>, v array<double>"))
    x = x.select("symbol", *keep, F.explode(F.arrays_zip("j.t", "j.o", "j.h", "j.l", "j.c", "j.v")).alias("b"))
    return x.select("symbol", F.to_date(F.timestamp_seconds("b.t")).alias("date"), F.col("b.o").alias("open"), F.col("b.h").alias("high"), F.col("b.l").alias("low"), F.col("b.c").alias("close"), F.col("b.v").alias("volume"), *keep)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; where keys meet, the new row stays. Later rows of `new` are told by its `_seq` column, if it has one."""
    seq = F.col("_seq") if "_seq" in new.columns else F.lit(0)
    both = old.withColumns({"_side": F.lit(0), "_seq": F.lit(0)}).unionByName(new.withColumns({"_side": F.lit(1), "_seq": seq}), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_side"), F.desc("_seq"))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_side", "_seq")


def high_water_mark(bars: DataFrame, by: str = "symbol", at: str = "date") -> DataFrame:
    return bars.groupBy(by).agg(F.max(at).alias("latest"))


def write_artifacts(rows: DataFrame, root: str, namespace: str, run_id: str) -> str:
    """One JSON record a symbol under namespace/run/symbol."""
    path = f"{root}/{namespace}/{run_id}/symbols"
    rows.select("symbol", F.to_json(F.struct(*sorted(c for c in rows.columns if c != "symbol"))).alias("value")).write.partitionBy("symbol").mode("overwrite").text(path)
    return path


def read_artifacts(spark: SparkSession, path: str, schema: str, symbols: list[str] | None = None) -> DataFrame:
    x = spark.read.text(path)
    if symbols:
        x = x.where(F.col("symbol").isin(symbols))  # prunes partitions
    return x.select("symbol", F.from_json("value", schema).alias("record")).select("symbol", "record.*")


def read_macro_csv(spark: SparkSession, path: str) -> DataFrame:
    """(date, value) from a CSV's first two columns; rows without a date or a number go."""
    raw = spark.read.csv(path, header=True)
    date, value = raw.columns[:2]
    x = raw.select(F.try_to_timestamp(F.col(date)).cast("date").alias("date"), F.expr(f"try_cast(`{value}` AS double)").alias("value"))
    return x.where("date IS NOT NULL AND value IS NOT NULL")


def cached_series(spark: SparkSession, path: str, fetch, today: str, days: int = 3) -> DataFrame:
    """A stored (date, value) series, fetched from its last date on when that is more than `days` old; later values stay.

    Each state is a folder of its own, so that one that is being read is never changed.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    states = sorted(int(s.getPath().getName()) for s in fs.listStatus(root)) if fs.exists(root) else []
    old = spark.read.parquet(f"{path}/{states[-1]}") if states else None
    last = old.agg(F.max("date")).first()[0] if old is not None else None
    if last is not None and spark.range(1).select(F.datediff(F.lit(today).cast("date"), F.lit(last))).first()[0] <= days:
        return old
    new = fetch(last)
    merged = upsert(old, new, ["date"]) if old is not None else new.dropDuplicates(["date"])
    state = f"{path}/{(states[-1] + 1) if states else 0}"
    merged.write.parquet(state)
    return spark.read.parquet(state)


def write_summary(rows: DataFrame, root: str, namespace: str, run_id: str, kind: str = "parquet") -> str:
    """A run's summary table as Parquet or CSV."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"no summary format: {kind}")
    path = f"{root}/{namespace}/{run_id}/summary.{kind}"
    rows.write.mode("overwrite").option("header", True).format(kind).save(path)
    return path


def read_summary(spark: SparkSession, root: str, namespace: str, run_id: str) -> DataFrame | None:
    """A run's summary, whichever format it has; None without one."""
    for kind in ("parquet", "csv"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{namespace}/{run_id}/summary.{kind}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.option("header", True).option("inferSchema", True).format(kind).load(path.toString())
    return None


def write_metadata(spark: SparkSession, root: str, namespace: str, run_id: str, payload: dict) -> None:
    """A run's metadata as one sorted JSON record."""
    text = json.dumps(payload, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/{namespace}/{run_id}/meta")


def read_metadata(spark: SparkSession, root: str, namespace: str, run_id: str) -> dict:
    return json.loads(spark.read.text(f"{root}/{namespace}/{run_id}/meta").first()[0])


def append_log(rows: DataFrame, path: str, run_id: str | None = None) -> None:
    """Rows added to a CSV log; every part has its header. With a run's id they are that run's part of the log, and a run that is
    repeated replaces its own rows instead of adding them again."""
    if run_id is None:
        rows.write.mode("append").option("header", True).csv(path)
    else:
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/run={run_id}")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A log kept by runs: its rows with the column run."""
    return spark.read.option("header", True).schema(f"{schema}, run string").csv(path)


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Distinct symbols of a CSV's symbol or ticker column, else of its first column; a file without a comma is a list."""
    head = spark.read.text(path).head(1)
    names = [c.strip() for c in head[0][0].split(",")] if head else []
    known = [c for c in names if c.lower() in ("symbol", "ticker")]
    if known or len(names) > 1:
        x = spark.read.csv(path, header=True).select(F.col(known[0] if known else names[0]).alias("symbol"))
    else:
        x = spark.read.text(path).select(F.col("value").alias("symbol"))
    return x.select(F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()


def pick_symbols(symbols: DataFrame, limit: int | None = None, sample: int | None = None, seed: int = 7) -> DataFrame:
    """All symbols, a seeded random choice of `sample`, or the first `limit`."""
    if sample is not None:
        symbols = symbols.orderBy(F.xxhash64("symbol", F.lit(seed))).limit(sample)
    return symbols.orderBy("symbol").limit(limit) if limit is not None else symbols


def parse_run_id(run_id) -> F.Column:
    """Time of a run id in either of its two formats."""
    return F.coalesce(F.try_to_timestamp(run_id, F.lit("yyyy-MM-dd'T'HH-mm")), F.try_to_timestamp(run_id, F.lit("yyyyMMdd'T'HHmmss'Z'")))


class JobQueue:
    """A folder of JSON requests that move from pending to completed or failed; a lock file keeps runs apart."""

    def __init__(self, root: str):
        self.root = Path(root)
        for d in ("pending", "active", "completed", "failed"):
            (self.root / d).mkdir(parents=True, exist_ok=True)

    def submit(self, name: str, payload: dict) -> Path:
        path = self.root / "pending" / f"{name}.json"
        path.write_text(json.dumps(payload, sort_keys=True))
        return path

    def finish(self, name: str, ok: bool, **result) -> Path:
        src, to = self.root / "pending" / f"{name}.json", self.root / ("completed" if ok else "failed") / f"{name}.json"
        to.write_text(json.dumps((json.loads(src.read_text()) if src.exists() else {}) | result | {"finished": time.time()}, sort_keys=True))
        src.unlink(missing_ok=True)
        return to

    def lock(self) -> bool:
        """Whether the lock is now ours."""
        try:
            os.close(os.open(self.root / "lock", os.O_CREAT | os.O_EXCL))
            return True
        except FileExistsError:
            return False

    def unlock(self) -> None:
        (self.root / "lock").unlink(missing_ok=True)
