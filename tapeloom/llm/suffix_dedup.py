"""Exact substring dedup: suffixes are sorted bucket by bucket, long ties are settled by ranks of a cover sample.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or same document and earlier start)
goes. Of all suffixes, only the sample stands for a shuffle row. The sample has the property of a difference cover that
the sort needs: whenever two suffixes agree for LENGTH bytes, both have a sample position at the same distance. Positions
modulo a cover would give that with 0.12 to 0.22 rows a byte; here the sample is chosen by content (the least COVER-byte
hash of each LENGTH-byte window), which gives it with about 0.03 rows a byte.

1. Each window belongs to the sample position of its least hash, so all suffixes of a window's content are in one bucket
   (the hash). Positions whose whole context is equal are settled at once: within a task before they are sent, and then
   among all tasks. Only first contexts of buckets with several contexts go on.
2. A context's windows are dealt anew, each SPAN of starts by the bytes that its windows share. Again equal parts are
   settled, parts that share theirs with no other are done, and only ambiguous ones go on.
3. A task sorts what is left of its texts, CHUNK parts of contexts at a time: the bytes after the sample positions and the
   bytes before them are each ranked once, and suffix i positions before the sample is settled by the two ranks' common
   prefixes, so no tie is compared again. The first suffixes of all chunks meet by their content.

The same steps hold at every size. A bucket may be as frequent as it likes: a task deals two contexts of a bucket by the
bucket and the rest by their content, so that no bucket gathers in one task. Texts are read in parts of SLICE_BYTES.

Defined cases: a null text is empty; texts shorter than LENGTH lose nothing; identical repeated rows get the same result
and are no source for each other; rows of one doc_id with different texts count as one document's texts; rows without a
doc_id stay whole and are nobody's source; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import SLICE_BYTES, RangeHash, cut, map_arrow, mix, text_slices, utf8

LENGTH = 100
COVER = 24
#: Windows whose starts before their sample position differ by less than this are dealt together, by what they share.
SPAN = 10
#: Sample positions that a task compares among themselves before it sends them on.
LOCAL_ROWS = 1_000_000
#: Parts of contexts that a task sorts at a time.
CHUNK = 20_000
_POSITION_BITS = 20
#: Kinds of sample rows: dealt by their bucket; one of a bucket that is known to have several contexts; settled.
OPEN, SURE, KNOWN = range(3)
_SAMPLE = ["h", "ctx", "doc_id", "start", "n", "off", "kind"]
_SAMPLE_SCHEMA = "h long, ctx long, doc_id long, start long, n int, off int, kind int"
_SETTLED_SCHEMA = "doc_id long, ask boolean, h long, start long, n int, off int"


def _segments(offs: np.ndarray, data: np.ndarray):
    """(first byte, offsets, bytes) of parts of at most SLICE_BYTES; parts of a long text overlap."""
    size = min(SLICE_BYTES, 1 << _POSITION_BITS)
    if len(data) <= size:
        yield 0, offs, data
        return
    for k in range(0, len(data), size // 2):
        part = data[k : k + size // 2 + LENGTH - 1]
        yield k, np.clip(offs - k, 0, len(part)), part


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x


def _sample(offs: np.ndarray, data: np.ndarray):
    """(hash, context hash, row, first and last window start, position) of each sample position, all from 0 in `data`."""
    n = len(data)
    if n < LENGTH:
        return None
    ranges = RangeHash(data)
    at = np.arange(n - COVER + 1)
    h = ranges.of(at, at + COVER)
    low = np.uint64((1 << _POSITION_BITS) - 1)
    least = _sliding_min((h & ~low) | at.astype(np.uint64), LENGTH - COVER + 1)
    ends = np.repeat(offs[1:], np.diff(offs))[: len(least)]
    window = np.flatnonzero(np.arange(LENGTH, LENGTH + len(least)) <= ends)
    if not len(window):
        return None
    p = (least[window] & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    s0, s1 = window[first], window[np.r_[first[1:], len(p)] - 1]
    p = p[first]
    return h[p], mix(ranges.of(s0, s1 + LENGTH) + mix((p - s0).astype(np.uint64))), np.searchsorted(offs, s0, "right") - 1, s0, s1, p


def _local(h, ctx, doc, start, n, off):
    """Rows to send: the first of each (h, ctx), and the others as settled, merged where they adjoin."""
    order = np.lexsort((start, doc, ctx, h))
    h, ctx, doc, start, n, off = (x[order] for x in (h, ctx, doc, start, n, off))
    lead = np.maximum.accumulate(np.where(np.r_[True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])], np.arange(len(h)), 0))
    first = (doc == doc[lead]) & (start == start[lead])
    cols = [x[first] for x in (h, ctx, doc, start, n, off)]
    kd, ks, kn = doc[~first], start[~first], n[~first].astype(np.int64)
    order = np.lexsort((ks, kd))
    kd, ks, kn = kd[order], ks[order], kn[order]
    if len(kd):
        begin = np.flatnonzero(np.r_[True, (kd[1:] != kd[:-1]) | (ks[1:] > ks[:-1] + kn[:-1] + 1)])
        end = np.maximum.reduceat(ks + kn, begin)
        kd, ks, kn = kd[begin], ks[begin], end - ks[begin]
    zero = np.zeros(len(kd), np.int64)
    more = [mix(kd.astype(np.uint64) + ks.astype(np.uint64)), zero.astype(np.uint64), kd, ks, kn, zero]
    # The first two contexts of a bucket tell the others' tasks that it has several.
    bucket = np.maximum.accumulate(np.where(np.r_[True, cols[0][1:] != cols[0][:-1]], np.arange(len(cols[0])), 0))
    kind = np.r_[np.where(np.arange(len(cols[0])) - bucket >= 2, SURE, OPEN), np.full(len(kd), KNOWN)]
    return _rows(*(np.concatenate([a, b.astype(a.dtype)]) for a, b in zip(cols, more)), kind)


def _rows(h, ctx, doc, start, n, off, kind):
    arrays = [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc), pa.array(start), *(pa.array(x, pa.int32()) for x in (n, off, kind))]
    return pa.RecordBatch.from_arrays(arrays, _SAMPLE)


def _send(parts):
    """_local over (h, ctx, doc, start, n, off) arrays as they come, LOCAL_ROWS at a time."""
    held, rows = [], 0
    for x in parts:
        held.append(x)
        rows += len(x[0])
        if rows >= LOCAL_ROWS:
            yield _local(*map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if rows:
        yield _local(*map(np.concatenate, zip(*held)))


def _anchors(batches):
    def parts():
        for part in text_slices(batches):
            doc = part.column("doc_id").to_numpy()
            offs, data = utf8(part.column("text"))
            for base, o, d in _segments(offs, data):
                if (found := _sample(o, d)) is not None:
                    h, ctx, row, s0, s1, p = found
                    yield h, ctx, doc[row], s0 + base - offs[row], s1 - s0, p - s0

    return _send(parts())


def _settle(batches):
    """Sorted sample rows to settled ones and to first contexts of buckets with several. Holds one row of a bucket."""
    h0 = c0 = d0 = s0 = pending = None

    def out(doc, ask, h, start, n, off):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(ask, pa.bool_()), pa.array(h, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32()), pa.array(off, pa.int32())], ["doc_id", "ask", "h", "start", "n", "off"])

    for batch in batches:
        h, ctx, doc, start, n, off, kind = (batch.column(k).to_numpy(zero_copy_only=False) for k in _SAMPLE)
        known = kind == KNOWN
        if known.any():
            k = known
            yield out(doc[k], np.zeros(k.sum(), bool), h[k], start[k], n[k], off[k])
            h, ctx, doc, start, n, off, kind = (x[~k] for x in (h, ctx, doc, start, n, off, kind))
        if not len(h):
            continue
        goes_on = h0 is not None and h[0] == h0
        new_h = np.r_[not goes_on, h[1:] != h[:-1]]
        new_c = new_h | np.r_[not (goes_on and ctx[0] == c0), ctx[1:] != ctx[:-1]]
        lead = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        lead_doc, lead_start = (np.where(lead >= 0, x[lead], y if y is not None else -1) for x, y in ((doc, d0), (start, s0)))
        first = (doc == lead_doc) & (start == lead_start)
        run = np.cumsum(new_h)
        contexts = np.bincount(run, new_c)
        # A context may come in several kinds; its first row speaks for all of them.
        sure = np.maximum.reduceat(kind == SURE, np.flatnonzero(np.r_[True, new_c[1:]]))[np.cumsum(np.r_[True, new_c[1:]]) - 1]
        ask = new_c & ((contexts[run] > 1) | (run == 0) | sure)
        if run[0] == 0 and contexts[0] and pending:
            yield out(*[[x] for x in pending])
        if run[-1] or contexts[0]:
            i = int(np.flatnonzero(new_h)[-1]) if run[-1] else 0
            pending = (doc[i], True, h[i], start[i], n[i], off[i]) if run[-1] and contexts[-1] == 1 and not ask[i] else None
        keep = ask | ~first
        yield out(doc[keep], ask[keep], h[keep], start[keep], n[keep], off[keep])
        h0, c0, d0, s0 = h[-1], ctx[-1], lead_doc[-1], lead_start[-1]


def _asked(part):
    """(text slice, asks) to (document, h, start, n, off, first byte of the context in the slice's bytes, the bytes)."""
    lists = part.column("asks").combine_chunks()
    flat = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    h, start, n, off = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("h", "start", "n", "off"))
    offs, data = utf8(part.column("text"))
    inside = start + n + LENGTH <= np.diff(offs)[row]  # rows of one doc_id may have other texts
    row, h, start, n, off = (x[inside] for x in (row, h, start, n, off))
    return part.column("doc_id").to_numpy()[row], h, start, n, off, offs[row] + start, data


def _spans(batches):
    """The asked contexts in parts: the windows that start `low` to `high` bytes before the sample position, for each SPAN."""

    def parts():
        for part in text_slices(batches):
            doc, h, start, n, off, at, data = _asked(part)
            if not len(h):
                continue
            ranges, p = RangeHash(data), at + off
            for low in range(0, LENGTH - COVER + 1, SPAN):
                high = min(low + SPAN - 1, LENGTH - COVER)
                lo, hi = np.maximum(off - n, low), np.minimum(off, high)
                k = lo <= hi
                if not k.any():
                    continue
                q, lo, hi = p[k], lo[k], hi[k]
                shared, body = ranges.of(q - low, q + LENGTH - high), ranges.of(q - hi, q - lo + LENGTH)
                yield mix(h[k].astype(np.uint64) ^ mix(shared + np.uint64(low))), mix(body + mix(hi.astype(np.uint64))), doc[k], (start + off)[k] - hi, hi - lo, hi

    return _send(parts())


def _sorted_chunks(batches):
    """Parts of contexts to settled runs and, as sample rows of their own, the windows that are first in their chunk."""
    held, rows = [], 0

    def out():
        h, doc, start, n, off = (np.concatenate([x[k] for x in held]) for k in range(5))
        bodies = [b for x in held for b in x[5]]
        (kd, ks, kn), (row, a) = resolve(h, doc, start, n, off, bodies)
        data, ends = np.frombuffer(b"".join(bodies), np.uint8), np.cumsum([0, *map(len, bodies)])
        at = ends[row] + off[row] - a
        body = RangeHash(data).of(at, at + LENGTH)
        first = [body, mix(h[row].astype(np.uint64) + a.astype(np.uint64)), doc[row], start[row] + off[row] - a, np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)]
        more = [mix(kd.astype(np.uint64) + ks.astype(np.uint64)), np.zeros(len(kd), np.uint64), kd, ks, kn, np.zeros(len(kd), np.int64)]
        return _rows(*(np.concatenate(x) for x in zip(first, more)), np.r_[np.full(len(row), OPEN), np.full(len(kd), KNOWN)])

    for part in text_slices(batches):
        doc, h, start, n, off, at, data = _asked(part)
        for x in range(0, len(h), CHUNK):
            own = slice(x, x + CHUNK)
            body = [data[a : a + k + LENGTH].tobytes() for a, k in zip(at[own].tolist(), n[own].tolist())]
            held.append((h[own], doc[own], start[own], n[own], off[own], body))
            rows += len(body)
            if rows >= CHUNK:
                yield out()
                held, rows = [], 0
    if rows:
        yield out()


def _lcp(m: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (key, bytes) and, for each, the bytes that it shares with the one before (-1: another key)."""
    width = -(-m.shape[1] // 8) * 8
    wide = np.zeros((len(m), width), np.uint8)
    wide[:, : m.shape[1]] = m
    cols = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*cols.T[::-1], key))
    x, k = m[order], key[order]
    lcp = np.full(len(m), -1)
    if len(m) > 1:
        differs = x[1:] != x[:-1]
        lcp[1:] = np.where(k[1:] == k[:-1], np.where(differs.any(1), differs.argmax(1), m.shape[1]), -1)
    return order, lcp


def resolve(h, doc, start, n, off, bodies: list[bytes]):
    """Of rows of any buckets: ((doc, start, n) of runs of windows that an earlier row holds too, (row, bytes before the
    sample position) of the other windows)."""
    order = np.lexsort((start + off, doc))
    h, doc, start, n, off = (x[order] for x in (h, doc, start, n, off))
    size, reach = len(h), LENGTH - COVER
    grid = np.zeros((size, reach + LENGTH), np.uint8)
    for i, k in enumerate(order.tolist()):
        b = np.frombuffer(bodies[k], np.uint8)
        grid[i, reach - off[i] : reach - off[i] + len(b)] = b
    right, lcp_right = _lcp(grid[:, reach:], h)
    left, lcp_left = _lcp(np.ascontiguousarray(grid[:, :reach][:, ::-1]), h)
    p, again, own_window = start + off, np.zeros((size, reach + 3), bool), np.zeros((size, reach + 1), bool)
    group_right, group_left = np.empty(size, np.int64), np.empty(size, np.int64)
    for a in range(reach + 1):
        own = np.flatnonzero((a <= off) & (a >= off - n))
        if not len(own):
            continue
        own_window[own, a] = True
        group_right[right] = np.cumsum(lcp_right < LENGTH - a)
        group_left[left] = np.cumsum(lcp_left < a)
        key = group_right[own] * (size + 1) + group_left[own]
        by = np.argsort(key, kind="stable")
        rows, key = own[by], key[by]
        lead = rows[np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(by)), 0))]
        again[rows, a + 1] = (doc[rows] != doc[lead]) | (p[rows] != p[lead])
    row, begin = np.nonzero(again[:, 1:] & ~again[:, :-1])
    _, end = np.nonzero(again[:, :-1] & ~again[:, 1:])  # runs of a from begin to end - 1
    first, a = np.nonzero(own_window & ~again[:, 1:-1])
    return (doc[row], p[row] - (end - 1), end - 1 - begin), (order[first], a)


def _cut_out(batches, whole: bool = False):
    """doc_id, n_bytes, removed runs and what is kept of each text; whole: a character that loses a byte goes whole."""
    for part in text_slices(batches):
        offs, data = utf8(part.column("text"))
        size = np.diff(offs)
        runs = part.column("runs").combine_chunks()
        lens = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
        flat = runs.flatten()
        row = np.repeat(np.arange(part.num_rows), lens)
        start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.minimum(start + flat.field("n").to_numpy(zero_copy_only=False) + LENGTH, size[row])
        start, end = offs[row] + np.minimum(start, end), offs[row] + end
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, start, 1)
        np.add.at(edge, end, -1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        before = np.r_[False, gone[:-1]]
        full = np.flatnonzero(size)
        before[offs[full]] = False
        after = np.r_[gone[1:], False]
        after[offs[full + 1] - 1] = False
        begin, stop = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
        owner = np.searchsorted(offs, begin, "right") - 1
        spans = pa.StructArray.from_arrays([pa.array(begin - offs[owner]), pa.array(stop - offs[owner])], ["start", "end"])
        to = np.r_[0, np.cumsum(np.bincount(owner, minlength=part.num_rows))]
        if whole and len(data):
            char = np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)
            gone |= (np.bincount(char, gone) > 0)[char]
        kept_ends = np.searchsorted(np.flatnonzero(~gone), offs)
        kept = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(kept_ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[~gone]))])
        cols = [part.column("doc_id").combine_chunks(), pa.array(size), pa.ListArray.from_arrays(pa.array(to, pa.int32()), spans), kept.cast(pa.binary()), part.column("row").combine_chunks()]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "spans", "kept", "row"])


def _settled(sample: DataFrame) -> DataFrame:
    """Settled rows and asks of sample rows. Rows of a bucket meet, but for those that are known to be asked anyway."""
    dealt = sample.repartition(F.when(F.col("kind") == SURE, F.xxhash64("h", "ctx")).otherwise(F.col("h")))
    return map_arrow(dealt.sortWithinPartitions("h", "ctx", "doc_id", "start"), _settle, _SETTLED_SCHEMA)


def _with_asks(named: DataFrame, settled: DataFrame) -> DataFrame:
    """The texts that are asked for, each with its asks. The texts are dealt by doc_id: all such joins read one exchange."""
    asks = settled.where("ask").groupBy("doc_id").agg(F.collect_list(F.struct("h", "start", "n", "off")).alias("asks"))
    return named.join(asks, "doc_id").select("doc_id", "text", "asks")


def dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), whole_characters: bool = False) -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges), kept (remaining bytes) and row (the columns in carry) of every row.

    With whole_characters, kept is valid UTF-8: a character that loses one of its bytes goes whole.
    """
    row = F.struct(F.lit(0).alias("_"), *[docs[c] for c in carry]).alias("row")
    own = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"), row)
    named, nameless = own.where("doc_id IS NOT NULL"), own.where("doc_id IS NULL")
    contexts = cut(_settled(map_arrow(named.select("doc_id", "text"), _anchors, _SAMPLE_SCHEMA)), "settled")
    parts = _settled(map_arrow(_with_asks(named, contexts), _spans, _SAMPLE_SCHEMA))
    windows = _settled(map_arrow(_with_asks(named, parts), _sorted_chunks, _SAMPLE_SCHEMA))
    runs = functools.reduce(DataFrame.unionByName, [x.where("NOT ask").select("doc_id", "start", "n") for x in (contexts, parts, windows)])
    runs = runs.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    found = named.join(runs, "doc_id", "left").select("doc_id", "text", "row", "runs")
    whole = nameless.select("doc_id", "text", "row", F.lit(None).cast("array<struct<start:long,n:int>>").alias("runs"))
    schema = f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary, row {own.schema['row'].dataType.simpleString()}"
    return map_arrow(found.unionByName(whole), functools.partial(_cut_out, whole=whole_characters), schema)
