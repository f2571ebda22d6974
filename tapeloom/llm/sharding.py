"""Sharding by fixed virtual slots: records hash into slots, slots are dealt to shards by a stored, versioned map.

The map has one row for each slot (a fixed number, whatever the data), so it alone passes through the driver. A version is
a folder of its own and is never changed: rebalancing reads the latest version, edits it and writes the next one. Only the
slots that must move get another shard.

Defined cases: a null text counts 0 bytes and has the checksum of the empty text; null or repeated ids are spread by
their text's checksum; equal rows take neighbouring places; slots of equal size move in the order of their number; an
empty table has a map and no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tapeloom.llm.common import cut, shared_dir

SLOTS = 16384
#: Parts over which equal rows are dealt.
SALTS = 256
MAP_SCHEMA = "slot int, shard int, bytes long, rows long, base long"


def records(docs: DataFrame, *, text: str = "text", key: str = "doc_id", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual slot of each row, and a part (salt) that spreads equal rows."""
    body = F.coalesce(docs[text], F.lit("")).cast("binary")
    out = docs.select(docs[key].alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = out.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(slots)).cast("int"))
    return out.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))


def slot_loads(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows of every slot: `slots` numbers each, whatever the data."""
    size, count = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for v, b, n in rows.groupBy("vslot").agg(F.sum("size"), F.count("*")).collect():
        size[v], count[v] = b, n
    return size, count


def rebalance(shard: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """An edited map: full shards give up slots, which go to the emptiest; then single moves and swaps even out the rest."""
    shard = shard.copy()
    load = np.bincount(shard, size, shards).astype(np.int64)
    mean = load.sum() / shards
    loose = []
    for s in np.flatnonzero(load > mean):
        own = np.flatnonzero((shard == s) & (size > 0))
        for v in own[np.argsort(-size[own], kind="stable")]:
            if load[s] <= mean:
                break
            if load[s] - size[v] >= mean * 0.98 or size[v] > mean:
                loose.append(v)
                load[s] -= size[v]
    for v in sorted(loose, key=lambda v: (-size[v], v)):
        s = int(load.argmin())
        shard[v] = s
        load[s] += size[v]
    for _ in range(64 * shards):
        hi, lo = int(load.argmax()), int(load.argmin())
        gap = load[hi] - load[lo]
        mine, theirs = np.flatnonzero((shard == hi) & (size > 0)), np.flatnonzero((shard == lo) & (size > 0))
        if gap < 2 or not len(mine):
            break
        give = np.concatenate([[0], np.sort(size[theirs])])
        at = np.clip(np.searchsorted(give, size[mine] - gap / 2), 0, len(give) - 1)
        net = size[mine] - give[at]
        best = int(np.abs(net - gap / 2).argmin())
        if not 0 < net[best] < gap:
            break
        moved, back = mine[best], give[at[best]]
        if back:
            shard[theirs[np.flatnonzero(size[theirs] == back)[0]]] = hi
        shard[moved] = lo
        load[hi] -= net[best]
        load[lo] += net[best]
    return shard


def versions(spark: SparkSession, path: str) -> list[int]:
    """Stored versions of the map at `path`."""
    jvm, sc = spark._jvm, spark.sparkContext
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(folder)]
    done = [n for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in done)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest by default."""
    version = versions(spark, path)[-1] if version is None else version
    return spark.read.schema(MAP_SCHEMA).parquet(f"{path}/version={version}").withColumn("version", F.lit(version))


def write_map(spark: SparkSession, path: str, shard: np.ndarray, size: np.ndarray, count: np.ndarray) -> int:
    """Store the next version; base: rows of earlier slots of the same shard."""
    base = np.zeros(len(shard), np.int64)
    for s in np.unique(shard):
        own = np.flatnonzero(shard == s)
        base[own] = np.cumsum(count[own]) - count[own]
    version = max(versions(spark, path), default=0) + 1
    rows = [(v, *map(int, x)) for v, x in enumerate(zip(shard, size, count, base))]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.parquet(f"{path}/version={version}")
    return version


def edit_map(spark: SparkSession, path: str, size: np.ndarray, count: np.ndarray, shards: int) -> int:
    """Rebalance the latest version by these loads; the number of the version written."""
    known = read_map(spark, path).orderBy("slot").toPandas()
    return write_map(spark, path, rebalance(known["shard"].to_numpy(), size, shards), size, count)


def place(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """shard and gapless place of each record. The map has a fixed number of rows, so it is broadcast.

    Equal rows share a slot, however many they are, so they are counted in SALTS parts first; a slot's order is taken over
    the parts alone, and each row is numbered inside its part.
    """
    kind = ["vslot", "doc_id", "text_crc32", "size", "salt"]
    parts = rows.groupBy(*kind).agg(F.count("*").alias("n"))
    before = Window.partitionBy("vslot").orderBy(*kind[1:]).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"part_{k}") for k in kind), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    nth = Window.partitionBy(*kind).orderBy(F.lit(0))
    at = rows.withColumn("nth", F.row_number().over(nth)).join(parts, [F.col(k).eqNullSafe(F.col(f"part_{k}")) for k in kind])
    m = F.broadcast(placed.select(F.col("slot").alias("vslot"), "shard", "base", F.col("version").alias("map_version")))
    slot = F.col("base") + F.col("before") + F.col("nth") - 1
    return at.join(m, "vslot").withColumn("slot", slot).drop("salt", "nth", "before", *(f"part_{k}" for k in kind))


def shard_rows(docs: DataFrame, shards: int = 16, *, text: str = "text", key: str = "doc_id", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Every record with its shard and place, by the next version of the map at `path`: the latest one rebalanced by bytes.

    Where there is no map yet (by default, one is kept for this call), version 1 deals the slots evenly.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = cut(records(docs, text=text, key=key, slots=slots), "slot-rows")
    size, count = slot_loads(rows, slots)
    if not versions(spark, path):
        write_map(spark, path, np.arange(slots) % shards, np.zeros(slots, np.int64), np.zeros(slots, np.int64))
    return place(rows, read_map(spark, path, edit_map(spark, path, size, count, shards)))
