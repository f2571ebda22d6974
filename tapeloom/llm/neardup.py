"""N-gram Jaccard join: a MinHash LSH forest for candidates, exact Jaccard on word shingles for links.

1. Texts with the same sequence of words are one class; its representative is the least doc_id. Only representatives go on.
2. A representative has a TREES x DEPTH MinHash signature; each tree is a prefix trie of its part of the signature, stored
   in the order of its prefixes. Two representatives match at the longest prefix that they share in some tree.
3. Prefixes are matched at full depth first and verified by the exact Jaccard similarity of the shingle sets. From its
   verified links, each weighted by the chance of being found at this depth, a member's recall is estimated; members below
   the target (those without a link too) shorten their prefixes by one. The shortest prefix has the target recall for a
   pair at the threshold itself, so the descent ends there.
4. A node of at most SMALL members gives all its pairs. Larger nodes are merged where they share members; such a family is
   measured against its least member first: members so near to it that any two of them must be similar are its core, which
   links by proof and is only counted. Only the others are compared, with all members, in blocks bounded in members and
   bytes. A task counts each member's links and sends on a spanning forest of them, so rows grow with the members.
5. Components of the links are the groups.

Defined cases: a null text, or one without a word, is a class and group of its own with no link; a text of 1 to 4 words
is one shingle; equal texts share a class; repeated rows of one doc_id have the same class; of one doc_id's different
texts, each has its class, and the shingle set that sorts first stands for the id in comparisons; equal minima match like
others; a row without a doc_id joins the class of its text, if there is one; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import RangeHash, counts_by_row, cut, map_arrow, mix, shingles, text_slices, word_hashes
from tapeloom.llm.graph import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 6
RECALL = 0.999
#: Members of a trie node up to which all its pairs are compared.
SMALL = 16
#: Members and bytes of shingle sets of a block of a family.
FAMILY_BLOCK, BLOCK_BYTES = 512, 16 << 20

_rng = np.random.default_rng(7)
_FACTOR = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shortest_prefix(threshold: float, recall: float = RECALL) -> int:
    """The longest prefix at which the forest finds a pair of this similarity with the target recall."""
    return next((d for d in range(DEPTH, 0, -1) if 1 - (1 - threshold**d) ** TREES >= recall), 1)


def signatures(docs: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id, two 64-bit hashes of the word sequence (null without words) and the signature, 4 bytes a minimum."""

    def run(batches):
        for part in text_slices(batches):
            n = part.num_rows
            wh, wrow = word_hashes(part.column("text"))
            count = counts_by_row(wrow, n)
            full, ends = np.flatnonzero(count), np.cumsum(count)
            lo = RangeHash(np.ascontiguousarray(wh).view(np.uint8)).of((ends - count) * 8, ends * 8)
            hi = np.zeros(n, np.uint64)
            sig = np.zeros((TREES * DEPTH, n), np.uint32)
            if len(full):
                nth = np.arange(len(wh)) - (ends - count)[wrow]
                hi[full] = np.add.reduceat(mix(wh + mix(nth.astype(np.uint64))), (ends - count)[full])
                h, row = shingles(wh, wrow, WORDS)
                starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                for k in range(TREES * DEPTH):
                    sig[k, full] = np.minimum.reduceat(((h * _FACTOR[k] + _TERM[k]) >> np.uint64(32)).astype(np.uint32), starts)
            raw = np.ascontiguousarray(sig.T)
            none = count == 0
            yield pa.RecordBatch.from_arrays(
                [part.column("key").combine_chunks(), pa.array(lo.view(np.int64), mask=none), pa.array(hi.view(np.int64), mask=none), pa.array([None if e else x.tobytes() for x, e in zip(raw, none)], pa.binary())],
                ["doc_id", "lo", "hi", "sig"],
            )

    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    return map_arrow(own, run, "doc_id long, lo long, hi long, sig binary")


def tries(reps: DataFrame, depth: int) -> DataFrame:
    """doc_id and its prefixes p<depth> .. p<DEPTH> in each tree, a row for each tree."""

    def prefix(t: int, d: int):
        return F.xxhash64(F.lit(t), F.lit(d), F.substring("sig", t * DEPTH * 4 + 1, d * 4)).alias(f"p{d}")

    rows = F.array(*[F.struct(*[prefix(t, d) for d in range(depth, DEPTH + 1)]) for t in range(TREES)])
    return reps.select("doc_id", F.inline(rows))


def forest(reps: DataFrame, depth: int) -> DataFrame:
    """The tries' rows that share a prefix of this depth with another: stored in the order of their prefixes."""
    rows, p = tries(reps, depth), f"p{depth}"
    shared = rows.groupBy(p).agg(F.count("*").alias("n")).where("n > 1").select(p)
    return cut(rows.join(shared, p).sortWithinPartitions(*[f"p{d}" for d in range(depth, DEPTH + 1)], "doc_id"), "forest")


def nodes(trie: DataFrame, settled: DataFrame | None, p: str) -> DataFrame:
    """Rows (p, doc_id, open, n, low) of nodes with two members, one of them open: size and least member of the node."""
    at = trie.select(p, "doc_id")
    at = at.withColumn("open", F.lit(True)) if settled is None else at.join(settled, "doc_id", "left").select(p, "doc_id", F.col("done").isNull().alias("open"))
    size = at.groupBy(p).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("open").alias("any")).where("n > 1 AND any").drop("any")
    return cut(at.join(size, p), "nodes")


def candidates(rows: DataFrame, p: str) -> DataFrame:
    """(a, b): all pairs of small nodes of which one is open."""
    small = rows.where(F.col("n") <= SMALL)
    a, b = (small.select(p, F.col("doc_id").alias(c), F.col("open").alias(f"open_{c}")) for c in "ab")
    return a.join(b, p).where("a < b AND (open_a OR open_b)").select("a", "b").distinct()


def recalled(links: DataFrame, depth: int, target: float = RECALL) -> DataFrame:
    """(doc_id, done) of members whose links are found with the target recall at this depth, as far as their links tell."""
    each = links.select(F.explode(F.array("a", "b")).alias("doc_id"), (1 - F.pow(1 - F.pow("jaccard", F.lit(depth)), F.lit(TREES))).alias("chance"))
    return each.groupBy("doc_id").agg((F.count("*") / F.sum(1 / F.col("chance"))).alias("recall")).where(F.col("recall") >= target).select("doc_id", F.lit(True).alias("done"))


def families(large: DataFrame) -> DataFrame:
    """(doc_id, family): members of large nodes; nodes that share a member are one family, named after its least member."""
    of = components(large.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    return cut(of.select(F.col("id").alias("doc_id"), F.col("root").alias("family")), "families")


def shingle_sets(docs: DataFrame, ids: DataFrame, text: str, key: str) -> DataFrame:
    """doc_id and sorted distinct shingle hashes of the documents in ids."""

    def run(batches):
        for part in text_slices(batches):
            h, row = shingles(*word_hashes(part.column("text")), WORDS)
            ends = np.cumsum(counts_by_row(row, part.num_rows))
            sets = [np.unique(x).tobytes() for x in np.split(h, ends[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(sets, pa.binary())], ["doc_id", "sh"])

    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"))
    own = own.join(ids.withColumnRenamed("id", "key"), "key", "left_semi")
    return map_arrow(own, run, "doc_id long, sh binary").groupBy("doc_id").agg(F.min("sh").alias("sh"))


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs whose shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(k) for k in ("a", "b", "x", "y"))
            j = np.zeros(len(a))
            for k in range(len(a)):
                s, t = np.frombuffer(x[k].as_buffer(), np.uint64), np.frombuffer(y[k].as_buffer(), np.uint64)
                if min(len(s), len(t)) >= threshold * max(len(s), len(t)) - 1e-9 and len(s):
                    z = np.concatenate([s, t])
                    z.sort()
                    same = int((z[1:] == z[:-1]).sum())
                    j[k] = same / (len(z) - same)
            ok = pa.array(j >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok), pa.array(j).filter(ok)], ["a", "b", "jaccard"])

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("sh").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("sh").alias("y")), "b")
    return map_arrow(both.select("a", "b", "x", "y"), run, "a long, b long, jaccard double")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared elements of every two sets: a product of member x element matrices, some thousand elements at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    owner, at = owner[shared], at[shared]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    new = np.r_[True, at[1:] != at[:-1]][: len(at)]
    at = np.cumsum(new) - 1
    out = np.zeros((len(sets), len(sets)), np.float32)
    ends = np.r_[np.flatnonzero(new)[::4096], len(at)] if len(at) else np.array([0])
    for x, y in zip(ends[:-1], ends[1:]):
        m = np.zeros((len(sets), int(at[y - 1] - at[x]) + 1), np.float32)
        m[owner[x:y], at[x:y] - at[x]] = 1
        out += m @ m.T
    return out


def compare_blocks(rows, threshold: float):
    """Links of one pair of blocks: (doc_id, n, root) with the number of a member's links and a root of its component."""
    import pandas as pd

    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    ids, block = rows["doc_id"].to_numpy(), rows["block"].to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in rows["sh"]]
    size = np.array([len(x) for x in sets], float)
    shared = _overlaps(sets)
    similar = shared / np.maximum(size[:, None] + size[None] - shared, 1) >= threshold - 1e-9
    np.fill_diagonal(similar, False)
    # Pairs inside a block belong to the task of that block with itself.
    if rows["first"].iloc[0] != rows["second"].iloc[0]:
        similar &= block[:, None] != block[None]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root, np.where(similar, root[None], len(ids)).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    n = similar.sum(1)
    return pd.DataFrame({"doc_id": ids, "n": n, "root": ids[root]})[n > 0]


def cores(of: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, family, sh, core): core members of a family are similar to each other whatever else is in their sets.

    With the family's least set C, r = |C - A| and t the threshold, A and B share |C| - r(A) - r(B) shingles at least. So
    they are similar if slack(A) + slack(B) >= 0 with slack(A) = (1 + t) (|C| / 2 - r(A)) - t |A|.
    """

    def run(batches):
        for batch in batches:
            core = []
            for x, c in zip(batch.column("sh"), batch.column("centre")):
                a, c = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(c.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([a, c]))
                missing = len(c) - int((both[1:] == both[:-1]).sum())
                core.append((1 + threshold) * (len(c) / 2 - missing) - threshold * len(a) >= 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("family"), batch.column("sh"), pa.array(core, pa.bool_())], ["doc_id", "family", "sh", "core"])

    centre = sets.select(F.col("doc_id").alias("family"), F.col("sh").alias("centre"))
    own = of.join(sets, "doc_id").join(centre, "family").select("doc_id", "family", "sh", "centre")
    return cut(map_arrow(own, run, "doc_id long, family long, sh binary, core boolean"), "cores")


def family_links(of: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, n, root) of the links inside families: cores are counted, other members compared in pairs of blocks."""
    own = cores(of, sets, threshold)
    blocks = F.ceil(F.greatest(F.count("*") / FAMILY_BLOCK, F.sum(F.octet_length("sh")) / BLOCK_BYTES)).cast("int")
    size = own.groupBy("family", "core").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), blocks.alias("blocks"))
    wide = size.groupBy("family").agg(
        *[F.coalesce(F.max(F.when(F.col("core") == c, F.col("blocks"))), F.lit(0)).alias(name) for c, name in ((True, "inner"), (False, "outer"))],
        F.max(F.when(F.col("core"), F.col("n"))).alias("n"),
        F.min(F.when(F.col("core"), F.col("low"))).alias("low"),
    )
    placed = own.join(wide.repartition("low", "family"), "family")  # both sides are dealt, so a large family can be split
    counted = placed.where("core AND n > 1").select("doc_id", (F.col("n") - 1).alias("n"), F.col("low").alias("root"))
    block = F.when(F.col("core"), F.pmod(F.xxhash64("doc_id"), F.col("inner"))).otherwise(F.col("inner") + F.pmod(F.xxhash64("doc_id"), F.col("outer")))
    other = F.explode(F.sequence(F.when(F.col("core"), F.col("inner")).otherwise(0), F.col("inner") + F.col("outer") - 1)).alias("other")
    dealt = placed.where("outer > 0").select("doc_id", "sh", "family", block.cast("int").alias("block"), other)
    dealt = dealt.select("doc_id", "sh", "family", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    dealt = dealt.repartition("family", "first", "second")
    compared = dealt.groupBy("family", "first", "second").applyInPandas(lambda rows: compare_blocks(rows, threshold), "doc_id long, n long, root long")
    return cut(counted.unionByName(compared), "family-links")


def outside(links: DataFrame, of: DataFrame) -> DataFrame:
    """The links whose ends are not in one family."""
    x, y = (of.select(F.col("doc_id").alias(c), F.col("family").alias(f"family_{c}")) for c in "ab")
    both = links.join(x, "a", "left").join(y, "b", "left")
    return both.where(~F.coalesce(F.col("family_a") == F.col("family_b"), F.lit(False))).select("a", "b", "jaccard")


def join(docs: DataFrame, *, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, class_id, n_links, group_id), and links (a, b, jaccard) of class representatives outside families."""
    floor = shortest_prefix(threshold)
    signed = cut(signatures(docs, text, key), "signatures")
    classes = signed.where("lo IS NOT NULL AND doc_id IS NOT NULL").groupBy("lo", "hi").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"))
    classes = cut(classes, "classes")
    trie = forest(classes, floor)
    sets = cut(shingle_sets(docs, trie.select(F.col("doc_id").alias("id")).distinct(), text, key), "shingles")
    settled = found = seen = large = None
    for depth in range(DEPTH, floor - 1, -1):
        p = f"p{depth}"
        rows = nodes(trie, settled, p)
        pairs = candidates(rows, p)
        pairs = cut(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
        new = cut(verify(pairs, sets, threshold), "links")
        found, seen = (new, pairs) if found is None else (found.unionByName(new), seen.unionByName(pairs))
        wide = rows.where(F.col("n") > SMALL).select("doc_id", "low")
        large = wide if large is None else large.unionByName(wide)
        settled = recalled(found, depth)
    of = families(large)
    links = cut(outside(found, of), "links")
    inner = family_links(of, sets, threshold)
    groups = components(links.select("a", "b").unionByName(inner.select(F.col("doc_id").alias("a"), F.col("root").alias("b"))))
    degree = links.select(F.explode(F.array("a", "b")).alias("id"), F.lit(1).alias("n")).unionByName(inner.select(F.col("doc_id").alias("id"), F.col("n").cast("int")))
    degree = degree.groupBy("id").agg(F.sum("n").alias("n_links"))
    named = groups.join(degree, "id", "full").withColumnRenamed("id", "class_id")
    named = cut(classes.select("lo", "hi", F.col("doc_id").alias("class_id")).join(named, "class_id", "left"), "groups")
    members = signed.select("doc_id", "lo", "hi").join(named, ["lo", "hi"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("root", "class_id", "doc_id").alias("group_id"),
    )
    return members, links
