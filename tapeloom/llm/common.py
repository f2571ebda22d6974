"""Small helpers shared by the operators: tables, lineage cuts, text arrays and rolling hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Text bytes that one vectorised step handles; a longer text stands alone and is hashed in blocks of as many bytes.
SLICE_BYTES = 1 << 20
#: Bytes of a batch of rows that Spark sends to a Python worker at most (a longer row stands alone).
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may go without that setting."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = sc.getConf().get("spark.checkpoint.dir")
        if not path and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tapeloom-"))
    return sc.getCheckpointDir()


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow in batches of at most BATCH_BYTES, so that no worker holds more of the rows than that."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key).rstrip("b") == str(64 << 20):  # Spark's default; a setting of the user's stays
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table that `cut` wrote for df; nothing may read it afterwards."""
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def held_out(doc_id, modulus: int, rest: int):
    """Whether crc32(doc_id as text) mod modulus is rest."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == rest, F.lit(False))


def text_slices(batches, column: str = "text", limit: int = SLICE_BYTES, nulls: str | None = None):
    """Rows of Arrow batches in slices of about `limit` text bytes; null texts become empty (`nulls` names a mark of them)."""
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if nulls:
            t = t.append_column(nulls, t.column(column).is_null())
        col = pc.fill_null(t.column(column).combine_chunks().cast(pa.large_string()), "")
        t = t.set_column(t.schema.get_field_index(column), column, col)
        n = t.num_rows
        if not n:
            continue
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield t.slice(at, to - at)
            at = to


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and bytes of a large_string array without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.empty(0, np.uint8)
    return offs - offs[0], data


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection, so it adds no collisions)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = 0x9E3779B97F4A7C13
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: int) -> np.ndarray:
    """base ** 0 .. base ** SLICE_BYTES."""
    if base not in _powers:
        x = np.full(SLICE_BYTES + 1, base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base]


def _power(base: int, at: np.ndarray) -> np.ndarray:
    """base ** at; the table has as many entries as a block has bytes, however long the text is."""
    table = _powers_of(base)
    if not len(at) or at.max() < len(table):
        return table[at]
    blocks = at // SLICE_BYTES
    step = np.cumprod(np.r_[np.uint64(1), np.full(int(blocks.max()), table[SLICE_BYTES])])
    return table[at % SLICE_BYTES] * step[blocks]


class RangeHash:
    """Hashes of any byte ranges of one array, equal for equal bytes wherever they stand.

    The running sums of an array of up to SLICE_BYTES are kept; those of a longer one are made anew block by block for the
    points that are asked for, so memory follows the points and not the bytes.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = self._block(0, np.uint64(0)) if len(data) <= SLICE_BYTES else None

    def _block(self, start: int, total: np.uint64) -> np.ndarray:
        part = self.data[start : start + SLICE_BYTES]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _powers_of(_BASE)[: len(part)], out=sums[1:])
        return total + sums * _power(_BASE, np.array([start]))[0] if start else sums

    def _at(self, points: np.ndarray) -> np.ndarray:
        if self.sums is not None:
            return self.sums[points]
        order = np.argsort(points, kind="stable")
        points, out, total = points[order], np.empty(len(points), np.uint64), np.uint64(0)
        for start in range(0, len(self.data), SLICE_BYTES):
            sums = self._block(start, total)
            a, b = np.searchsorted(points, [start, start + len(sums) - 1], "left")
            if start + len(sums) > len(self.data):
                b = len(points)
            out[order[a:b]] = sums[points[a:b] - start]
            total = sums[-1]
        return out

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self._at(end) - self._at(start)) * _power(_INVERSE, start))


_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True


def words(offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each word: a run of ASCII letters or digits and of bytes of other characters."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    w = np.zeros(len(data) + 2, bool)
    w[1:-1] = _WORD[data]
    full = offs[:-1][np.diff(offs) > 0]
    first = w[1:-1] & ~w[:-2]
    first[full] = w[1:-1][full]
    last = w[1:-1] & ~w[2:]
    ends = offs[1:][np.diff(offs) > 0] - 1
    last[ends] = w[1:-1][ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(start, offs))
    return start, end, np.repeat(np.arange(len(offs) - 1), counts)


def word_hashes(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word of the lower-cased texts."""
    offs, data = utf8(pc.utf8_lower(col))
    start, end, row = words(offs, data)
    return (RangeHash(data).of(start, end) if len(start) else np.empty(0, np.uint64)), row


def shingles(hashes: np.ndarray, row: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of n words; a text of 1 to n - 1 words is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes, row
    m = len(hashes)
    total = np.zeros(m, np.uint64)
    factor = 1
    for j in range(n):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
        same = row[j:] == row[: m - j] if j < m else np.empty(0, bool)
        total[: max(0, m - j)] += np.where(same, (hashes[j:] + np.uint64(1)) * np.uint64(factor), np.uint64(0))
    whole = np.zeros(m, bool)
    if m >= n:
        whole[: m - n + 1] = row[n - 1 :] == row[: m - n + 1]
    first = np.ones(m, bool)
    first[1:] = row[1:] != row[:-1]
    keep = whole | (first & ~whole)
    return mix(total[keep]), row[keep]


def counts_by_row(row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, minlength=n).astype(np.int64)
