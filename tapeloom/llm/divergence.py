"""Source divergence audit: how far the term shares of each (language, source) group lie from other sources and the language.

1. A byte-level tokenizer: a lookup table over the concatenated UTF-8 bytes of many texts finds the boundaries of terms; the
   slices are grouped by XXH64 and verified byte by byte. Each task sums occurrences and documents of its terms by group.
2. A language keeps the terms of at least MIN_DOCUMENTS of its documents. With N, the group's occurrences of kept terms, and V
   kept terms, a share is 1 + floor(SCALE (count + SMOOTH) / (N + SMOOTH V)), in decimal arithmetic, so exact.
3. Two sources differ by the sum of |p - q| over all kept terms. Kept terms are dealt in blocks; a block is a CSR matrix
   (source x term) of the counted shares, and reduceat over its rows sums what the counted terms add to V |p0 - q0|, where p0
   and q0 are the shares of terms that do not occur. Sums of blocks are added up.
4. Terms above their language's share are ranked inside each group; Spark limits the ranks in each task before it shuffles.

Defined cases: a null text, language or source is the empty string; a text without a term counts for its group all the same;
each row is a document of its own, whatever its doc_id; a language that keeps no term has divergence 0 between its sources;
ties of value are ordered by the item's UTF-8 bytes; an empty table gives no row; other columns are not read. Shares are exact
while SCALE x count has at most 38 digits; a sum of shares fits 64 bits while V is below 9 x 10^9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tapeloom.llm.common import SLICE_BYTES, cut, map_arrow, text_slices, utf8
from tapeloom.llm.slices import Bytes, blocks, byte_table, group, lower_ascii, runs

MIN_DOCUMENTS, TOP = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Text bytes that are tokenised at once, and rows that a task holds before it sends them on.
TOKEN_BYTES, HELD_ROWS = 2 * SLICE_BYTES, 200_000
#: Counted (source, term) shares of a block.
BLOCK_SHARES = 1 << 17
#: Letters A-Z and a-z and the bytes of all characters beyond ASCII.
TERM = byte_table((65, 90), (97, 122), (128, 255))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(lang: pa.Array, source: pa.Array, of: np.ndarray, terms: list, at: np.ndarray, n: np.ndarray, docs: np.ndarray) -> pa.Table:
    """Rows (lang, source, term, n, docs) for group numbers `of` and term numbers `at`."""
    return pa.table([lang.take(pa.array(of)), source.take(pa.array(of)), pa.array(terms, pa.string()).take(pa.array(at)), pa.array(n), pa.array(docs)], schema=_COUNTS)


def _terms(low: np.ndarray, offs: np.ndarray):
    """(terms, term number of each occurrence, text of each occurrence)."""
    start, end, row = runs(TERM[low], offs)
    data = Bytes(low)
    of, first = group(data, start, end)
    return [data.raw(start[i], end[i]).decode() for i in first], of, row


def _long_text(lang, source, code, data: np.ndarray) -> pa.Table:
    """The counts of one long text: block by block, each term's document counted once."""
    total: dict[str, int] = {}
    for a, b in blocks(data, TERM[data], TOKEN_BYTES):
        low = lower_ascii(data[a:b])
        terms, of, _ = _terms(low, np.array([0, len(low)]))
        for t, n in zip(terms, np.bincount(of, minlength=len(terms)).tolist()):
            total[t] = total.get(t, 0) + n
    n = np.fromiter(total.values(), np.int64, len(total))
    return _counted(lang, source, np.full(len(n), code), list(total), np.arange(len(n)), n, np.ones(len(n), np.int64))


def _count(batches):
    """Texts to counts of terms by group, summed over as many rows as a task may hold."""
    held, rows = [], 0

    def summed():
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names)

    for part in text_slices(batches, limit=TOKEN_BYTES):
        keys = pa.table({k: part.column(k).combine_chunks() for k in ("lang", "source")})
        found = keys.group_by(["lang", "source"], use_threads=False).aggregate([])
        lang, source = found.column("lang").combine_chunks(), found.column("source").combine_chunks()
        code = {k: i for i, k in enumerate(zip(lang.to_pylist(), source.to_pylist()))}
        own = np.array([code[k] for k in zip(keys.column("lang").to_pylist(), keys.column("source").to_pylist())], np.int64)
        offs, data = utf8(part.column("text"))
        if len(data) > TOKEN_BYTES:  # then it is a single text
            held.append(_long_text(lang, source, 0, data))
        else:
            terms, of, row = _terms(lower_ascii(data), offs)
            if len(of):
                # Texts in the order of their groups: the pairs (term, text) of a group stand together.
                order = np.argsort(own, kind="stable")
                place = np.empty(len(own), np.int64)
                place[order] = np.arange(len(own))
                pair, n = np.unique(of * len(own) + place[row], return_counts=True)
                term, at = pair // len(own), own[order][pair % len(own)]
                new = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (at[1:] != at[:-1])])
                held.append(_counted(lang, source, at[new], terms, term[new], np.add.reduceat(n, new), np.diff(np.r_[new, len(pair)])))
        rows = sum(t.num_rows for t in held)
        if rows > 2 * HELD_ROWS:
            held = [summed()]
            if held[0].num_rows > HELD_ROWS:
                yield from held[0].combine_chunks().to_batches()
                held = []
    if held:
        yield from summed().combine_chunks().to_batches()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term, of each group."""
    own = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))], docs[text].alias("text"))
    found = map_arrow(own, _count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, scale: int = SCALE, smooth: int = SMOOTH) -> Column:
    """1 + floor(scale (count + smooth) / (total + smooth kept)): decimals, since 64 bits do not hold the product."""
    wide = "decimal(20,0)"
    top = F.lit(scale).cast("decimal(18,0)") * (count + smooth).cast(wide)
    return F.try_divide(top - top % (total + smooth * kept).cast(wide), (total + smooth * kept).cast(wide)).cast("long") + 1


def _pairs(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """What the counted terms of a block add to V |p0 - q0|, for every two sources. Rows without a term carry each source's p0."""
    head = table.filter(pc.is_null(table.column("term")))
    names = head.column("source").to_pylist()
    code, p0 = {s: i for i, s in enumerate(names)}, head.column("p").to_numpy()
    body = table.filter(pc.is_valid(table.column("term")))
    row = np.array([code[s] for s in body.column("source").to_pylist()], np.int64)
    terms = body.column("term").combine_chunks().dictionary_encode()
    col, p = terms.indices.to_numpy().astype(np.int64), body.column("p").to_numpy()
    order = np.lexsort((col, row))
    row, col, p = row[order], col[order], p[order]
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    full = np.flatnonzero(np.diff(indptr))
    base, out = p0[row], np.zeros((len(names), len(names)), np.int64)
    for b in range(len(names)):
        q = np.full(len(terms.dictionary), p0[b])
        own = slice(indptr[b], indptr[b + 1])
        q[col[own]] = p[own]
        if len(full):
            out[full, b] = np.add.reduceat(np.abs(p - q[col]) - np.abs(base - q[col]), indptr[full])
        # The terms of b on top of the other row's p0: sums of |p0 - q| from the sorted q.
        s = np.sort(p[own])
        below, k = np.r_[0, np.cumsum(s)], np.searchsorted(s, p0)
        out[:, b] += p0 * k - below[k] + (below[-1] - below[k]) - p0 * (len(s) - k) - len(s) * np.abs(p0 - p0[b])
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = pa.array([key[0].as_py()] * len(a), pa.string())
    return pa.table([lang, pa.array(names, pa.string()).take(pa.array(a)), pa.array(names, pa.string()).take(pa.array(b)), pa.array(out[a, b])], ["lang", "source", "item", "value"])


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, q, value, rank): other sources (`pair`, all) and own terms (`term`, the first `top`)."""
    counts = cut(term_counts(docs, text, lang, source), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).where(F.col("docs") >= least)
    kept = cut(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-terms")
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(k) for c, k in ((lang, "lang"), (source, "source"))]).distinct()
    langs = kept.groupBy("lang", "term").agg(F.count("*").alias("shares"), F.first("all_n").alias("all_n")).groupBy("lang").agg(
        F.count("*").alias("v"), F.sum("all_n").alias("lang_n"), F.ceil(F.sum("shares") / BLOCK_SHARES).cast("int").alias("blocks")
    )
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    heads = groups.join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
    heads = heads.withColumns({"v": F.coalesce("v", F.lit(0)), "group_n": F.coalesce("group_n", F.lit(0)), "blocks": F.coalesce("blocks", F.lit(0))})
    heads = cut(heads.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("group_n"), F.col("v")))), "groups")
    rows = kept.join(heads.select("lang", "source", "v", "lang_n", "group_n", "blocks"), ["lang", "source"])
    rows = rows.withColumn("p", share(F.col("n"), F.col("group_n"), F.col("v")))

    body = rows.select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "source", "term", "p")
    lead = heads.where("blocks > 0").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"))
    added = body.unionByName(lead).groupBy("lang", "block").applyInArrow(_pairs, "lang string, source string, item string, value long")
    added = added.groupBy("lang", "source", "item").agg(F.sum("value").alias("added"))
    a, b = heads.select("lang", "source", "v", F.col("p0").alias("p")), heads.select("lang", F.col("source").alias("item"), F.col("p0").alias("q"))
    pairs = a.join(b, "lang").where("source <> item").join(added, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(None).cast("long").alias("q"), F.coalesce(F.col("v") * F.abs(F.col("p") - F.col("q")) + F.coalesce("added", F.lit(0)), F.lit(0)).alias("value"))

    terms = rows.withColumn("q", share(F.col("all_n"), F.col("lang_n"), F.col("v"))).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "q", (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(best)
