"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Documents are partitioned by their number of shingles (powers of two). A document's signature is a one-permutation
MinHash: shingle hashes fall into bins and each bin keeps its least hash. The bins of a partition follow from its upper
size, so a bin holds at most LOAD shingles on average and a shared shingle is a bin's minimum with a known probability, in
long documents as in short ones. An item is a candidate of a document when they agree in a bin. Items with so few shingles
that the chance of a miss would exceed MISS are looked up shingle by shingle instead. Candidates are verified by the
exact share of the item's shingles that the document holds.

Documents are never shuffled: the items come in blocks of at most `block_bytes` of text, each of them broadcast.

Defined cases: null or empty texts and items match nothing; a text of 1 to 4 words is one shingle; equal documents and
equal items match alike, each in its own row; an empty table on either side gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import counts_by_row, map_arrow, mix, shingles, text_slices, word_hashes

WORDS = 5
THRESHOLD = 0.8
LOAD = 1.0
MISS = 1e-6
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, item_shingles int, shared_shingles int, containment double"


def bins_of(size: np.ndarray) -> np.ndarray:
    """Bins of the partition that holds documents of this many shingles: its upper size over LOAD."""
    return np.maximum(8, (2 ** (np.floor(np.log2(np.maximum(size, 1))) + 1) / LOAD)).astype(np.int64)


def _bin_keys(hashes: np.ndarray, bins: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, owner) of each bin's least hash, owners' bins apart; equal keys: the same partition, bin and least hash."""
    size = bins[np.r_[True, owner[1:] != owner[:-1]]] if len(owner) else bins[:0]
    base = np.repeat(np.cumsum(size) - size, np.diff(np.r_[np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]), len(owner)])) if len(owner) else bins
    bin_ = ((hashes >> np.uint64(40)) * bins.astype(np.uint64)) >> np.uint64(24)
    order = np.lexsort((hashes, base + bin_.astype(np.int64)))
    place = (base + bin_.astype(np.int64))[order]
    least = order[np.r_[True, place[1:] != place[:-1]]] if len(order) else order
    return mix(hashes[least] ^ mix(bins[least].astype(np.uint64))), owner[least]


class Index:
    """The lookup tables of one block of items."""

    def __init__(self, ids: list, texts: list, threshold: float):
        h, row = shingles(*word_hashes(pa.array(texts, pa.large_string())), WORDS)
        self.ids = np.array(ids, np.int64)
        pairs = np.unique(np.column_stack([row.astype(np.uint64), h]), axis=0) if len(h) else np.empty((0, 2), np.uint64)
        self.row, self.hash = pairs[:, 0].astype(np.int64), pairs[:, 1].copy()
        self.size = np.bincount(self.row, minlength=len(ids))
        self.ends = np.cumsum(self.size)
        self.need = np.ceil(self.size * threshold - 1e-9)
        chance = (1 - math.exp(-LOAD)) / LOAD
        self.short = self.need * math.log(1 - chance) > math.log(MISS)
        self._tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        own = self.short[self.row]
        self.direct = self._sorted(self.hash[own], self.row[own])

    @staticmethod
    def _sorted(key, row):
        order = np.argsort(key, kind="stable")
        return key[order], row[order]

    def bins(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sorted bin keys of the longer items for a partition of n bins."""
        if n not in self._tables:
            own = ~self.short[self.row]
            self._tables[n] = self._sorted(*_bin_keys(self.hash[own], np.full(own.sum(), n), self.row[own]))
        return self._tables[n]

    def shingles_of(self, item: int) -> np.ndarray:
        return self.hash[self.ends[item] - self.size[item] : self.ends[item]]


def _hits(keys: np.ndarray, owner: np.ndarray, table) -> np.ndarray:
    """Distinct (owner, item) pairs where a key stands in the table."""
    left, right = np.searchsorted(table[0], keys, "left"), np.searchsorted(table[0], keys, "right")
    n = right - left
    at = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.unique(np.column_stack([np.repeat(owner, n), table[1][at]]), axis=0)


def search(docs: DataFrame, items: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document and item whose shingles stand in the document to at least `threshold`."""
    spark = docs.sparkSession
    wanted = items.select(items[item_key].cast("long").alias("id"), items[item_text].alias("text")).where(F.col("text").isNotNull())
    total = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // block_bytes)

    def block(number: int) -> DataFrame:
        rows = wanted.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == number) if blocks > 1 else wanted
        held = rows.toPandas()  # about block_bytes of text
        shared = spark.sparkContext.broadcast(Index(held["id"].tolist(), held["text"].tolist(), threshold))

        def run(batches):
            index = shared.value
            for part in text_slices(batches):
                h, row = shingles(*word_hashes(part.column("text")), WORDS)
                size = counts_by_row(row, part.num_rows)
                found = [_hits(h, row, index.direct)] if len(index.direct[0]) else []
                bins = bins_of(size)
                for n in np.unique(bins[size > 0]):
                    own = bins[row] == n
                    found.append(_hits(*_bin_keys(h[own], bins[row[own]], row[own]), index.bins(int(n))))
                pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
                ends = np.cumsum(size)
                shared_n = np.array([np.isin(index.shingles_of(i), h[ends[d] - size[d] : ends[d]]).sum() for d, i in pairs.tolist()], np.int64)
                ok = shared_n >= index.need[pairs[:, 1]] if len(pairs) else np.empty(0, bool)
                pairs, shared_n = pairs[ok], shared_n[ok]
                of = index.size[pairs[:, 1]]
                yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks().take(pa.array(pairs[:, 0])), pa.array(index.ids[pairs[:, 1]]), pa.array(of, pa.int32()), pa.array(shared_n, pa.int32()), pa.array(shared_n / np.maximum(of, 1))], ["doc_id", "item_id", "item_shingles", "shared_shingles", "containment"])

        return map_arrow(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")), run, SCHEMA)

    out = spark.createDataFrame([], SCHEMA)
    for number in range(blocks):
        out = out.unionByName(block(number)) if number else block(number)
    return out
