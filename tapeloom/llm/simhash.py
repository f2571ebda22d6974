"""SimHash near-dedup: 64-bit fingerprints, linked at few differing bits through vantage-point trees over shards.

1. Whole texts, A-Z lower-cased, are cut at white space into words; a fingerprint bit is set if over half of the XXH64 hashes
   (seed 42) of the WORDS-word shingles, repeats included, have it. A long text goes through block by block.
2. Equal fingerprints are one class; only classes go on.
3. A vantage-point tree over a bounded sample of fingerprints parts the Hamming space: a node sends what lies within its radius
   of its vantage point to one side and the rest to the other. The leaves are the shards. By the triangle inequality only
   fingerprints whose distance exceeds radius - BITS can be linked to one beyond the radius; those are sent to the far side
   too, as queries. So each linked pair meets in the shard of the one of them that lies farther out where their ways part.
4. A shard of more than BLOCK fingerprints is dealt in blocks, and its fingerprints visit the blocks after their own. Inside a
   task a tree of the same kind splits its block until LEAF fingerprints are left, which are compared exactly. A task sends on
   a spanning forest of its links, so rows grow with the fingerprints and not with the pairs of a dense group.
5. Components of the links are the groups, named after their least doc_id; every row takes its fingerprint's.

Defined cases: a null text, or one without a word, has fingerprint 0, linked like any other; a text of fewer than WORDS words
is one shingle; each row is a text of its own, so repeated rows of one doc_id stay, and a doc_id with different texts has a row
in each one's component; a row without a doc_id links like others, and a component in which no row has one is named null; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import SLICE_BYTES, cut, map_arrow, text_slices, utf8
from tapeloom.llm.graph import components
from tapeloom.llm.slices import Bytes, byte_table, lower_ascii, runs, xxh64

WORDS, BITS, SEED = 3, 2, 42
#: Fingerprints of the sample that builds the tree: at most so many, and at most one of SAMPLE_PART.
SAMPLE, SAMPLE_PART = 1 << 15, 16
#: Fingerprints of a shard aimed at, and sampled ones that a leaf of the tree needs.
SHARD, LEAST_SAMPLED = 8192, 16
#: Stored fingerprints of a task, and those of a leaf that are compared with each other.
BLOCK, LEAF = 1 << 17, 512
#: Queries that are compared with a leaf at once, and links that a task holds before it thins them out.
QUERIES, HELD = 8192, 1 << 20
SPACE = byte_table((9, 13), (32, 32))
_ONES = np.uint64(0x0101010101010101)


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[Bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with one space between words, start, end, row of each word)."""
    space = SPACE[data]
    start, end, row = runs(~space, offs)
    keep = ~space
    keep[1:] |= ~space[:-1]  # a word and the first white space after it
    moved = np.cumsum(keep)
    at = moved[start] - 1 if len(start) else start
    return Bytes(np.where(space, np.uint8(32), lower_ascii(data))[keep]), at, at + (end - start), row


def _shingles(data: Bytes, start, end, row, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, row) of each run of `size` words; a text of fewer words is one shingle."""
    n = len(start)
    if not n:
        return np.empty(0, np.uint64), row
    last = np.minimum(np.arange(n) + size - 1, n - 1)
    whole = (np.arange(n) + size - 1 < n) & (row[last] == row)
    first = np.r_[True, row[1:] != row[:-1]]
    stop = np.searchsorted(row, row, "right") - 1
    last = np.where(whole, last, stop)
    keep = whole | (first & ~whole)
    return xxh64(data, start[keep], end[last[keep]], SEED), row[keep]


def votes(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, hashes with each of the 64 bits set) of each of n rows. Eight bits are counted at once, a byte each."""
    out = np.zeros((n, 64), np.int64)
    count = np.bincount(row, minlength=n).astype(np.int64)
    if len(h):
        lead = np.searchsorted(row, row, "left")
        part = np.flatnonzero((np.arange(len(h)) - lead) % 255 == 0)  # a byte counts to 255
        new = np.flatnonzero(np.r_[True, row[part][1:] != row[part][:-1]])
        for k in range(8):
            sums = np.add.reduceat((h >> np.uint64(k)) & _ONES, part).view(np.uint8).reshape(-1, 8)
            out[row[part][new], k::8] = np.add.reduceat(sums.astype(np.int64), new)
    return count, out


def _bits(count: np.ndarray, out: np.ndarray) -> np.ndarray:
    return ((2 * out > count[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


def _long_text(data: np.ndarray, limit: int) -> np.ndarray:
    """The fingerprint of one long text, counted block by block; a block begins with the last words of the one before."""
    count, out, at = np.zeros(1, np.int64), np.zeros((1, 64), np.int64), 0
    size = limit
    while True:
        to = min(len(data), at + size)
        if to < len(data):  # end at white space
            spaces = np.flatnonzero(SPACE[data[at:to]])
            words = runs(~SPACE[data[at : at + int(spaces[-1])]], np.array([0, int(spaces[-1])]))[0] if len(spaces) else spaces
            if len(words) < WORDS:
                size *= 2
                continue
            stop, after = at + int(spaces[-1]), at + int(words[-(WORDS - 1)])
        else:
            stop = after = to
        part = data[at:stop]
        h, row = _shingles(*_words(part, np.array([0, len(part)])))
        # What a rest of fewer words gives is no shingle of the text, unless it is all of it.
        if stop < len(data) or not at or len(runs(~SPACE[part], np.array([0, len(part)]))[0]) >= WORDS:
            c, v = votes(h, row, 1)
            count, out = count + c, out + v
        if stop == len(data):
            return _bits(count, out)
        at, size = after, limit


def _fingerprints(batches):
    for part in text_slices(batches):
        offs, data = utf8(part.column("text"))
        if len(data) > SLICE_BYTES:  # then it is a single text
            found = _long_text(data, SLICE_BYTES)
        else:
            h, row = _shingles(*_words(data, offs))
            found = _bits(*votes(h, row, part.num_rows))
        yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return map_arrow(own, _fingerprints, "doc_id long, fp long")


def _apart(fp: np.ndarray, one) -> np.ndarray:
    return np.bitwise_count(fp ^ one)


def _split(fp: np.ndarray, bits: int, tries: int = 8, least: float = 0) -> tuple[np.uint64, int] | None:
    """(vantage point, radius) that sends the fewest to both sides, with a quarter on either if possible; None without a split."""
    best = None
    for v in fp[np.unique(np.linspace(0, len(fp) - 1, tries).astype(int))]:
        far = np.bincount(_apart(fp, v), minlength=65)
        inside = np.cumsum(far)
        for r in range(64):
            small = min(inside[r], len(fp) - inside[r])
            uneven = small * 4 < len(fp)
            cost = (uneven, -small if uneven else far[max(0, r - bits + 1) : r + 1].sum())
            if small > least * len(fp) and (best is None or cost < best[0]):
                best = cost, (v, r)
    return best and best[1]


def build(sample: np.ndarray, shards: int, bits: int) -> list[tuple]:
    """A tree over the sample with about as many leaves: nodes (vantage, radius, near, far), leaves (shard,); node 0 is the root."""
    nodes: list[tuple] = [()]
    work, leaves = [(0, sample, shards)], 0
    while work:
        at, own, want = work.pop()
        found = _split(own, bits) if want > 1 and len(own) >= 2 * LEAST_SAMPLED else None
        if found is None:
            nodes[at] = (leaves,)
            leaves += 1
            continue
        v, r = found
        inside = _apart(own, v) <= r
        part = min(want - 1, max(1, round(want * inside.mean())))
        nodes += [(), ()]
        nodes[at] = (v, r, len(nodes) - 2, len(nodes) - 1)
        work += [(len(nodes) - 1, own[~inside], want - part), (len(nodes) - 2, own[inside], part)]
    return nodes


def routes(fp: np.ndarray, nodes: list[tuple], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, index, whether it is stored there) of every visit of the fingerprints."""
    out, work = [], [(0, np.arange(len(fp)), np.ones(len(fp), bool))]
    while work:
        at, who, own = work.pop()
        if not len(who):
            continue
        if len(nodes[at]) == 1:
            out.append((np.full(len(who), nodes[at][0]), who, own))
            continue
        v, r, near, far = nodes[at]
        d = _apart(fp[who], v)
        inside = np.where(own, d <= r, d <= r + bits)
        outside = d > r - bits
        work.append((near, who[inside], own[inside]))
        work.append((far, who[outside], own[outside] & (d[outside] > r)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links to as few that join the same members: each with the least member of its component."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = at[: len(a)], at[len(a) :], np.arange(len(names))
    while True:
        old, low = root, np.minimum(root[a], root[b])
        root = root.copy()
        for x in (a, b):
            np.minimum.at(root, x, low)
            np.minimum.at(root, old[x], low)
        root = root[root]
        if (root == old).all():
            break
    other = root != np.arange(len(names))
    return names[other], names[root[other]]


def linked(fp: np.ndarray, more: np.ndarray, bits: int):
    """(i, j) index arrays of links among fp (j < i), and of fp with `more` (numbered on from len(fp))."""
    every = np.concatenate([fp, more])
    work = [(np.arange(len(fp)), np.arange(len(fp), len(every)))]
    while work:
        own, visit = work.pop()
        found = _split(every[own], bits, 2, 0.125) if len(own) > LEAF else None
        if found is None:
            for x in range(0, len(own), LEAF):
                mine = own[x : x + LEAF]
                rest = np.concatenate([own[x:], visit])
                for y in range(0, len(rest), QUERIES):
                    them = rest[y : y + QUERIES]
                    i, j = np.nonzero(np.bitwise_count(every[mine][:, None] ^ every[them][None]) <= bits)
                    i, j = mine[i], them[j]
                    real = i != j
                    if real.any():
                        yield i[real], j[real]
            continue
        v, r = found
        d, e = _apart(every[own], v), _apart(every[visit], v)
        inside = d <= r
        work.append((own[inside], visit[e <= r + bits]))
        work.append((own[~inside], np.concatenate([visit[e > r - bits], own[inside & (d > r - bits)]])))


def _links(bits: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, own = table.column("fp").to_numpy(), table.column("own").to_numpy()
        ids, stored = ids[np.argsort(~own, kind="stable")], int(own.sum())
        fp = ids.view(np.uint64)
        a, b, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for i, j in linked(fp[:stored], fp[stored:], bits):
            a, b, held = [*a, ids[i]], [*b, ids[j]], held + len(i)
            if held > HELD:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, held = [x], [y], 0
        x, y = forest(np.concatenate(a), np.concatenate(b))
        return pa.table([x, y], ["a", "b"])

    return run


def links(classes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that join the same fingerprints as all pairs of at most `bits` differing bits do."""
    total = classes.count()
    part = max(SAMPLE_PART, -(-total // SAMPLE))
    sample = classes.where(F.pmod(F.xxhash64("fp"), F.lit(part)) == 0).select("fp").toPandas()["fp"].to_numpy(np.int64)
    nodes = build(np.sort(sample.view(np.uint64)), max(1, total // SHARD), bits)

    def route(batches):
        for batch in batches:
            shard, who, own = routes(batch.column("fp").to_numpy().view(np.uint64), nodes, bits)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(own, pa.bool_()), batch.column("fp").take(pa.array(who))], ["shard", "own", "fp"])

    placed = cut(classes.select("fp").mapInArrow(route, "shard int, own boolean, fp long"), "shards")
    sizes = placed.where("own").groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(sizes, "shard").withColumn("home", F.when(F.col("own"), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(0))
    dealt = dealt.select("shard", "own", "home", "fp", F.explode(F.sequence("home", F.col("blocks") - 1)).alias("block"))
    dealt = dealt.withColumn("own", F.col("own") & (F.col("home") == F.col("block")))
    return dealt.groupBy("shard", "block").applyInArrow(_links(bits), "a long, b long")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", bits: int = BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    signed = cut(fingerprints(docs, text, key), "fingerprints")
    classes = cut(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    roots = components(cut(links(classes, bits), "links")).withColumnRenamed("id", "fp")
    classes = cut(classes.join(roots, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "rooted")
    least = cut(classes.groupBy("root").agg(F.min("doc_id").alias("component_id")), "components")  # read anew, so that a large component can be split
    named = classes.join(least, "root").select("fp", "component_id")
    out = signed.join(cut(named, "named"), "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
