"""Substring dedup by collinear chaining: shared word k-mer seeds, chained with gap costs, aligned to fuzzy passages.

1. Seeds are k-mers sampled by content: the least hash of each WINDOW short k-mers in a row, and the least of each
   LONG_WINDOW k-mers of MIN_WORDS words. So equal passages have equal seeds, and an equal passage of LONG_WORDS words
   holds a sampled k-mer of MIN_WORDS words. All places of a seed meet by its hash. A short seed of at most FEW places
   matches all its earlier holders; a more frequent one, and a long one, matches the first holder of all. So each place of
   an equal passage of LONG_WORDS words is linked to the first document that holds MIN_WORDS words of it, and rows grow with
   the text, not with the square of a seed's places. A task deals FEW + 1 places of a seed; the others are joined with the
   seed's first holder once that is known, so that no seed gathers in one task. Matches depend on the rows alone.
2. Matches of a document with one source document that keep their distance are merged into segments; ordered segments
   are chained by Fenwick trees of maxima over source positions, a pair for each block within reach (score: seed words less
   GAP_COST for each word skipped). Chains are traced best first over segments that are still free.
3. Chains are aligned: both passages' words are fetched from the texts, gaps between segments are aligned by edit distance,
   the ends are extended across unequal words up to the best score. A passage stays if it is long and similar enough.

Defined cases: null or empty texts and texts shorter than a seed match nothing; equal texts are one passage each with the
first of them; a passage within another of the same document is not reported again (of equal ones the one with the least
source stays); repeats inside one document are not reported; rows of one doc_id are one document, and where their texts
differ, the words that sort first stand for a place; rows without a doc_id match nothing; an empty table gives no row;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tapeloom.llm.common import cut, map_arrow, mix, text_slices, word_hashes

SEED_WORDS, WINDOW = 6, 10
GAP_COST, MAX_GAP = 0.2, 48
#: Words from the last seed of a segment to the first of the next one of its chain.
REACH = MAX_GAP + SEED_WORDS
#: Words between the ends of a chain's seeds that make it worth aligning.
CHAIN_WORDS = 16
#: Words and share of equal words of a reported passage.
MIN_WORDS, MIN_IDENTITY = 40, 0.8
#: Long seeds in a row of which one is sampled, and words of an equal passage that holds one for certain.
LONG_WINDOW = 11
LONG_WORDS = MIN_WORDS + LONG_WINDOW - 1
#: Passages are fetched from the texts in whole blocks of so many words, and with so many words around them.
BLOCK, AROUND = 32, 64
#: What an unequal word costs where an equal one counts 1, and the fall from the best score at which an extension ends.
UNEQUAL, DROP = 2.0, 12.0
LOCAL_ROWS = 1_000_000
#: A short seed of at most so many places matches all its earlier holders.
FEW = 32
#: A dealt place, one of a seed of which its task has more, and one that waits for the seed's first holder.
OPEN, MORE, REST = range(3)
#: Rows of matched seeds: a match, a place that waits, a seed's first holder.
MATCH, WAITS, FIRST = range(3)
_SEED = "seed long, doc long, place int"
_MATCHED = "kind int, seed long, doc long, pos int, src long, src_pos int"
_CHAIN = "doc long, src long, a0 int, a1 int, b0 int, b1 int, segments binary"
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def seeds(h: np.ndarray, row: np.ndarray, size: int = SEED_WORDS, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of the sampled k-mers of `size` words."""
    m = len(h) - size + 1
    if m < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    total, factor = np.zeros(m, np.uint64), 1
    for j in range(size):
        factor = factor * 0xC2B2AE3D27D4EB4F % (1 << 64)
        total += (h[j : j + m] + np.uint64(1)) * np.uint64(factor)
    whole = row[:m] == row[size - 1 :]
    k, at = mix(total)[whole], np.flatnonzero(whole)
    if not len(k):
        return k, at
    # Rows stand apart by a window, so that a row's sample does not depend on its neighbours.
    place = np.arange(len(k)) + (np.cumsum(np.r_[True, row[at][1:] != row[at][:-1]])) * (window - 1)
    wide = np.full(int(place[-1]) + window, _LAST)
    wide[place] = k
    least = np.lib.stride_tricks.sliding_window_view(wide, window).min(1)
    most = np.lib.stride_tricks.sliding_window_view(least, window).max(1)  # of the windows that hold a k-mer
    sampled = most[place - window + 1] == k
    return k[sampled], at[sampled]


def _is_long(seed: np.ndarray) -> np.ndarray:
    return (seed & seed.dtype.type(1)).astype(bool)


def _firsts(seed):
    """Of sorted seeds: index of the first row of each."""
    return np.maximum.accumulate(np.where(np.r_[True, seed[1:] != seed[:-1]], np.arange(len(seed)), 0))


def _local(seed, doc, pos):
    """A task's places: as many of a seed as show that it is frequent are dealt, the others wait."""
    order = np.lexsort((pos, doc, seed))
    seed, doc, pos = seed[order], doc[order], pos[order]
    lead = _firsts(seed)
    nth, count = np.arange(len(seed)) - lead, np.bincount(lead, minlength=len(seed))[lead]
    dealt = np.where(_is_long(seed), 1, FEW + 1)
    kind = np.where(nth >= dealt, REST, np.where(count > dealt, MORE, OPEN))
    return pa.RecordBatch.from_arrays([pa.array(seed.view(np.int64)), pa.array(doc), pa.array(pos * 4 + kind, pa.int32())], ["seed", "doc", "place"])


def _sample(batches):
    held, rows = [], 0
    for part in text_slices(batches):
        doc = part.column("doc").to_numpy()
        h, row = word_hashes(part.column("text"))
        for long, size, window in ((0, SEED_WORDS, WINDOW), (1, MIN_WORDS, LONG_WINDOW)):
            k, at = seeds(h, row, size, window)
            held.append((k & ~np.uint64(1) | np.uint64(long), doc[row[at]], at - np.searchsorted(row, row[at], "left")))
            rows += len(k)
        if rows >= LOCAL_ROWS:
            yield _local(*map(np.concatenate, zip(*held)))
            held, rows = [], 0
    if rows:
        yield _local(*map(np.concatenate, zip(*held)))


def _matched(kind, seed, doc, pos, src, src_pos):
    n = len(doc)
    cols = [np.full(n, kind), seed, doc, pos, np.zeros(n, np.int64) if src is None else src, np.zeros(n, np.int32) if src_pos is None else src_pos]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], ["kind", "seed", "doc", "pos", "src", "src_pos"])


def _groups(batches):
    """Sorted rows to (waiting rows, places of whole seeds). Holds one seed's places: a few for each task that dealt them."""
    held = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32))
    for batch in batches:
        seed, doc, place = (batch.column(k).to_numpy() for k in ("seed", "doc", "place"))
        waits = place % 4 == REST
        held = tuple(np.r_[h, x[~waits]] for h, x in zip(held, (seed, doc, place)))
        stop = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        yield tuple(x[waits] for x in (seed, doc, place)), tuple(x[:stop] for x in held)
        held = tuple(x[stop:] for x in held)
    yield None, held


def _match(batches):
    """Places to matches; a seed of which places wait gives its first holder."""
    for waits, (seed, doc, place) in _groups(batches):
        if waits is not None and len(waits[0]):
            yield _matched(WAITS, waits[0], waits[1], waits[2] // 4, None, None)
        if not len(seed):
            continue
        pos, lead, more = place // 4, _firsts(seed), place % 4 == MORE
        few = (np.bincount(lead, minlength=len(seed))[lead] <= FEW) & ~_is_long(seed)
        for k in range(1, FEW):
            i = np.flatnonzero((seed[k:] == seed[:-k]) & (doc[k:] != doc[:-k]) & few[k:]) + k
            if not len(i):
                break
            yield _matched(MATCH, seed[i], doc[i], pos[i], doc[i - k], pos[i - k])
        i = np.flatnonzero(~few & (doc != doc[lead]))
        yield _matched(MATCH, seed[i], doc[i], pos[i], doc[lead[i]], pos[lead[i]])
        i = np.unique(lead[more])
        yield _matched(FIRST, seed[i], doc[i], pos[i], None, None)


def matches(own: DataFrame) -> DataFrame:
    """(doc, pos, src, src_pos, long): places of a seed and of an earlier holder."""
    sample = map_arrow(own.select(F.col("doc_id").alias("doc"), "text"), _sample, _SEED)
    dealt = sample.repartition(F.when(F.pmod("place", F.lit(4)) == REST, F.xxhash64("seed", "doc")).otherwise(F.col("seed")))
    found = cut(map_arrow(dealt.sortWithinPartitions("seed", "doc", "place"), _match, _MATCHED), "matched")
    first = found.where(F.col("kind") == FIRST).select("seed", F.col("doc").alias("src"), F.col("pos").alias("src_pos"))
    waiting = found.where(F.col("kind") == WAITS).select("seed", "doc", "pos").join(first, "seed").where("doc <> src")
    cols = ["doc", "pos", "src", "src_pos", (F.col("seed").bitwiseAND(F.lit(1)) == 1).alias("long")]
    return found.where(F.col("kind") == MATCH).select(*cols).unionByName(waiting.select(*cols))


_NONE = (float("-inf"), -1)


class Fenwick:
    """Greatest (value, item) of the places before a given one, of REACH places."""

    def __init__(self):
        self.best = [_NONE] * (REACH + 1)

    def put(self, place: int, value: tuple) -> None:
        best, place = self.best, place + 1
        while place <= REACH:
            if best[place] < value:
                best[place] = value
            place += place & -place

    def before(self, place: int) -> tuple:
        best, out = self.best, _NONE
        while place:
            if best[place] > out:
                out = best[place]
            place -= place & -place
        return out


class Reach:
    """Greatest (value, item) put within REACH words before a source position.

    Each block of REACH positions has two Fenwick trees, one from its begin and one from its end, so that the window is the end
    of one block and the beginning of the next.
    """

    def __init__(self):
        self.trees: dict[int, tuple[Fenwick, Fenwick]] = {}

    def put(self, at: int, value: tuple) -> None:
        block, place = divmod(at, REACH)
        trees = self.trees.get(block)
        if trees is None:
            trees = self.trees[block] = Fenwick(), Fenwick()
        trees[0].put(place, value)
        trees[1].put(REACH - 1 - place, value)

    def before(self, at: int) -> tuple:
        block, place = divmod(at, REACH)
        now, last = self.trees.get(block), self.trees.get(block - 1)
        out = now[0].before(place) if now else _NONE
        return max(out, last[1].before(REACH - place)) if last else out


def chain(segments: list[tuple[int, int, int]]) -> list[list[int]]:
    """Chains (lists of indexes in order) over segments (a, b, words between its first and last seed), best first.

    Fenwick trees score every segment as a chain's end, over the segments that end within REACH words before it in both
    documents; chains are then traced best first, each as far as its segments are free. The sweep goes by blocks of REACH
    words of the document. What a segment can follow ends in its own block, and is put as the sweep passes it, or in the last
    block, whose scores are final: there the block's segments ask from last to first while ends are put from last to first. So
    trees only take in, and those of a block are dropped whole.
    """
    score, back = [0.0] * len(segments), [-1] * len(segments)
    blocks: dict[int, list[int]] = {}
    for i in sorted(range(len(segments)), key=lambda i: segments[i][:2]):
        blocks.setdefault(segments[i][0] // REACH, []).append(i)
    ended: dict[int, list[int]] = {}  # by block of the end
    for i in sorted(range(len(segments)), key=lambda i: segments[i][0] + segments[i][2]):
        ended.setdefault((segments[i][0] + segments[i][2]) // REACH, []).append(i)

    def put(tree, j):
        aj, bj, nj = segments[j]
        tree.put(bj + nj, (score[j] + GAP_COST * (aj + nj + bj + nj), j))

    for block, members in sorted(blocks.items()):
        tree, earlier, best = Reach(), ended.get(block - 1, []), {}
        e = len(earlier)
        for i in reversed(members):
            a, b, _ = segments[i]
            while e and segments[earlier[e - 1]][0] + segments[earlier[e - 1]][2] >= a - REACH:
                e -= 1
                put(tree, earlier[e])
            best[i] = tree.before(b)
        tree, own_ends, e = Reach(), ended.get(block, []), 0
        for i in members:
            a, b, n = segments[i]
            while e < len(own_ends) and segments[own_ends[e]][0] + segments[own_ends[e]][2] < a:
                put(tree, own_ends[e])
                e += 1
            value, j = max(best[i], tree.before(b))
            own = n + SEED_WORDS
            linked = value - GAP_COST * (a + b) + own
            score[i], back[i] = (linked, j) if linked > own else (own, -1)
    out, free = [], [True] * len(segments)
    for i in sorted(range(len(segments)), key=lambda i: (-score[i], i)):
        found = []
        while i >= 0 and free[i]:
            free[i] = False
            found.append(i)
            i = back[i]
        if found:
            out.append(found[::-1])
    return out


def _chains(batches):
    """Matches sorted by (doc, src, pos) to chains; whole documents at a time."""
    held: list = []
    rows = 0

    def out(t, last):
        doc, pos, src, src_pos, long = (t.column(k).to_numpy().astype(np.int64) for k in ("doc", "pos", "src", "src_pos", "long"))
        stop = len(doc) if last else int(np.searchsorted(doc, doc[-1], "left"))
        rest = t.slice(stop)
        doc, pos, src, src_pos, long = (x[:stop] for x in (doc, pos, src, src_pos, long))
        made = []
        if stop:
            order = np.lexsort((pos, src_pos - pos, src, doc))
            doc, pos, src, src_pos, long = (x[order] for x in (doc, pos, src, src_pos, long))
            line = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (src_pos[1:] - pos[1:] != src_pos[:-1] - pos[:-1])])
            # the last seed so far of each line; lines are kept apart by a step that no text is as long as
            last_seed = np.maximum.accumulate(pos + long * (MIN_WORDS - SEED_WORDS) + (line << 32)) - (line << 32)
            new = np.r_[True, (line[1:] != line[:-1]) | (pos[1:] - last_seed[:-1] > MAX_GAP)]
            begin = np.flatnonzero(new)
            end = np.r_[begin[1:], len(doc)] - 1
            a, b, n = pos[begin], src_pos[begin], last_seed[end] - pos[begin]
            pair = np.r_[True, ~((doc[begin][1:] == doc[begin][:-1]) & (src[begin][1:] == src[begin][:-1]))]
            at = np.r_[np.flatnonzero(pair), len(begin)]
            # A pair whose matches lie within fewer words than a chain needs has none.
            wide = np.maximum.reduceat(a + n, at[:-1]) - np.minimum.reduceat(a, at[:-1]) + SEED_WORDS >= CHAIN_WORDS
            for x, y in zip(at[:-1][wide].tolist(), at[1:][wide].tolist()):
                seg = list(zip(a[x:y].tolist(), b[x:y].tolist(), n[x:y].tolist()))
                for c in chain(seg) if y - x > 1 else [[0]]:
                    s = [seg[i] for i in c]
                    a0, a1 = s[0][0], s[-1][0] + s[-1][2] + SEED_WORDS
                    if a1 - a0 >= CHAIN_WORDS:
                        made.append((int(doc[begin[x]]), int(src[begin[x]]), a0, a1, s[0][1], s[-1][1] + s[-1][2] + SEED_WORDS, np.array(s, np.int32).tobytes()))
        cols = list(zip(*made)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        return rest, pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "src", "a0", "a1", "b0", "b1", "segments"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 100_000:
            rest, made = out(pa.Table.from_batches(held).combine_chunks(), False)
            held, rows = rest.to_batches(), rest.num_rows
            yield made
    if rows:
        yield out(pa.Table.from_batches(held).combine_chunks(), True)[1]


def _passages(batches):
    """Words (32-bit hashes) of the asked ranges of each text."""
    for part in text_slices(batches):
        doc = part.column("doc_id").to_pylist()
        h, row = word_hashes(part.column("text"))
        h, ends = (h >> np.uint64(32)).astype(np.uint32), np.searchsorted(row, np.arange(part.num_rows), "right")
        starts = np.searchsorted(row, np.arange(part.num_rows), "left")
        out = [(d, r["w0"], r["w1"], h[s + r["w0"] : min(e, s + r["w1"])].tobytes()) for d, s, e, rs in zip(doc, starts.tolist(), ends.tolist(), part.column("ranges").to_pylist()) for r in rs]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["id", "w0", "w1", "words"])


def _gap(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words of the best alignment of two short runs (longest common subsequence)."""
    if not len(a) or not len(b):
        return 0
    last = np.zeros(len(b) + 1, np.int32)
    for w in a:
        now = np.maximum(last[1:], last[:-1] + (b == w))
        last = np.r_[0, np.maximum.accumulate(now)]
    return int(last[-1])


def extend(a: list, b: list) -> tuple[int, int, int]:
    """(words of a, words of b, equal ones) by which an alignment goes on beyond its end, up to its best score.

    The furthest points with 0, 1, 2 ... differences are kept for each shift of a against b; a point whose score has fallen
    DROP below the best is given up. So unequal, missing and added words are crossed where enough equal ones follow.
    """

    n, m = len(a), len(b)
    i = 0
    while i < n and i < m and a[i] == b[i]:
        i += 1
    near = i + int(DROP / UNEQUAL) + 2  # the first equal words lie before that, or there are none
    if set(a[i:near]).isdisjoint(b[i:near]):
        return i, i, i
    best, top, none = (i, i, i), float(i), (-1, 0)
    reached = {0: (i, i)}  # by shift: words of a, equal ones
    while reached:
        found: dict[int, tuple[int, int]] = {}
        at = found.get
        for shift, (i, equal) in reached.items():
            if i < n:
                if i - shift < m and at(shift, none)[0] <= i:
                    found[shift] = i + 1, equal
                if at(shift + 1, none)[0] <= i:
                    found[shift + 1] = i + 1, equal
            if i - shift < m and at(shift - 1, none)[0] < i:
                found[shift - 1] = i, equal
        reached = {}
        for shift, (i, equal) in found.items():
            j = begin = i - shift
            while i < n and j < m and a[i] == b[j]:
                i, j = i + 1, j + 1
            equal += j - begin
            # Words of both sides that are not equal ones, a pair of them counting like a word that one side lacks.
            score = equal - UNEQUAL * ((i if i > j else j) - equal)
            if score > top:
                best, top = (i, j, equal), score
            if score >= top - DROP:
                reached[shift] = i, equal
    return best


def align(a: np.ndarray, b: np.ndarray, segments: np.ndarray, a_at: int, b_at: int) -> tuple[int, int, int, int, int]:
    """(a0, a1, b0, b1, equal words) of a chain's passage: a and b hold the words from a_at and b_at on."""
    a0, b0 = int(segments[0, 0]) - a_at, int(segments[0, 1]) - b_at
    equal, x, y = 0, a0, b0
    for sa, sb, n in segments.tolist():
        sa, sb = sa - a_at, sb - b_at
        skip = max(0, x - sa, y - sb)  # seeds of neighbouring segments may overlap
        equal += _gap(a[x : sa + skip], b[y : sb + skip])
        stop = n + SEED_WORDS
        if skip < stop:
            equal += int((a[sa + skip : sa + stop] == b[sb + skip : sb + stop]).sum())
            x, y = sa + stop, sb + stop
    da, db, more = extend(a[:a0][::-1].tolist(), b[:b0][::-1].tolist())
    ea, eb, rest = extend(a[x:].tolist(), b[y:].tolist())
    return a0 - da + a_at, x + ea + a_at, b0 - db + b_at, y + eb + b_at, equal + more + rest


def _aligned(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            a, b = np.frombuffer(r["a_words"], np.uint32), np.frombuffer(r["b_words"], np.uint32)
            a0, a1, b0, b1, equal = align(a, b, np.frombuffer(r["segments"], np.int32).reshape(-1, 3), r["aw0"], r["bw0"])
            share = equal / max(a1 - a0, b1 - b0, 1)
            if a1 - a0 >= MIN_WORDS and share >= MIN_IDENTITY:
                out.append((r["doc"], r["src"], a0, a1, b0, b1, equal, share))
        cols = list(zip(*out)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 7 + [pa.float64()])], ["doc_id", "source_id", "start_word", "end_word", "source_start", "source_end", "equal_words", "identity"])


def passages(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each passage of a document that an earlier-sorted document holds too, in words, ends excluded."""
    own = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id IS NOT NULL")
    chains = cut(map_arrow(matches(own).repartition("doc").sortWithinPartitions("doc", "src", "pos"), _chains, _CHAIN), "chains")

    def down(c):
        return (F.floor(F.greatest(F.col(c) - AROUND, F.lit(0)) / BLOCK) * BLOCK).cast("int")

    def up(c):
        return (F.ceil((F.col(c) + AROUND) / BLOCK) * BLOCK).cast("int")

    chains = chains.select("*", down("a0").alias("aw0"), up("a1").alias("aw1"), down("b0").alias("bw0"), up("b1").alias("bw1"))
    ends = [F.struct(F.col(d).alias("id"), F.col(x).alias("w0"), F.col(y).alias("w1")) for d, x, y in (("doc", "aw0", "aw1"), ("src", "bw0", "bw1"))]
    asked = chains.select(F.inline(F.array(*ends))).distinct()
    ranges = asked.groupBy(F.col("id").alias("doc_id")).agg(F.collect_list(F.struct("w0", "w1")).alias("ranges"))
    texts = own.join(ranges, "doc_id").select("doc_id", "text", "ranges")
    got = map_arrow(texts, _passages, "id long, w0 int, w1 int, words binary")
    got = cut(got.groupBy("id", "w0", "w1").agg(F.min("words").alias("words")), "passages")
    a = got.select(F.col("id").alias("doc"), F.col("w0").alias("aw0"), F.col("w1").alias("aw1"), F.col("words").alias("a_words"))
    b = got.select(F.col("id").alias("src"), F.col("w0").alias("bw0"), F.col("w1").alias("bw1"), F.col("words").alias("b_words"))
    both = chains.join(a, ["doc", "aw0", "aw1"]).join(b, ["src", "bw0", "bw1"])
    schema = "doc_id long, source_id long, start_word long, end_word long, source_start long, source_end long, equal_words long, identity double"
    found = map_arrow(both.select("doc", "src", "segments", "aw0", "bw0", "a_words", "b_words"), _aligned, schema)
    w = Window.partitionBy("doc_id").orderBy("start_word", F.desc("end_word"), "source_id", "source_start", "source_end", F.desc("equal_words")).rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("to", F.max("end_word").over(w)).where("to IS NULL OR to < end_word").drop("to")
