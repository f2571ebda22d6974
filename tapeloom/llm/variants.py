"""Spelling variant grouping: words one edit apart, found by equal bands of letter-parity masks.

1. Runs of letters are found in the bytes by a lookup table, grouped exactly inside each text and counted; the rule that deletes
   a letter of one run in DROP_EVERY depends on document and run alone, so it is applied once for each distinct run of a text.
2. A word's mask has a bit for each letter (letters beyond 26 share bits): set if the letter occurs an odd number of times. An
   inserted or deleted letter flips one bit, a replaced one two or none. So of the mask's three bands one at least is equal.
3. Two words one edit apart also share their first or last half: the halves of the shorter one's length. Words are joined on
   (band, half, length): words of one length with each other, and with those that are one longer. Each pair is taken at its
   first equal band and half alone, so it comes once, and is verified by the edit distance.
4. A word's form is its near word of largest count, if that is RATIO times its own; roots follow forms by pointer jumping.

Defined cases: a null or empty text has no run; a null doc_id counts as empty in the deletion rule; each row counts, repeated
ones too; equal counts are settled by code-point order; a word without near words has n_near 0 and is its own root; an empty
table gives no row; other columns are not read.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tapeloom.llm.common import SLICE_BYTES, cut, map_arrow, text_slices, utf8
from tapeloom.llm.slices import Bytes, blocks, byte_table, group, lower_ascii, runs

LEAST_LENGTH, LEAST_COUNT, RATIO, DROP_EVERY = 6, 5, 5, 199
#: Distinct words that a task holds before it sends their counts on.
HELD_WORDS = 200_000
BANDS, BITS = 3, 63
_ASCII = byte_table((65, 90), (97, 122))
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and another


def _inside(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF."""
    out = _ASCII[data] | (data == _LEAD)
    out[1:] |= data[:-1] == _LEAD
    return out


def _spelled(data: np.ndarray, offs: np.ndarray, keys: list[bytes], total: dict[bytes, int]) -> None:
    """Add the words of texts to the totals: words of LEAST_LENGTH letters after the deletion rule."""
    low = lower_ascii(data)
    start, end, row = runs(_inside(data), offs)
    if not len(start):
        return
    raw = Bytes(low)
    of, first = group(raw, start, end)
    leads = np.r_[0, np.cumsum(low == _LEAD)]
    letters = (end - start - (leads[end] - leads[start]))[first]
    words = [raw.raw(start[i], end[i]) for i in first]
    long = letters >= LEAST_LENGTH
    pair, n = np.unique(of[long[of]] * len(keys) + row[long[of]], return_counts=True)
    which, text = pair // len(keys), pair % len(keys)
    h = np.fromiter((zlib.crc32(words[w], keys[t]) for w, t in zip(which.tolist(), text.tolist())), np.int64, len(pair))
    drop = h % DROP_EVERY == 0
    count = np.bincount(which[~drop], n[~drop], len(words)).astype(np.int64)
    for w in np.flatnonzero(count).tolist():
        total[words[w]] = total.get(words[w], 0) + int(count[w])
    for w, x, k in zip(which[drop].tolist(), h[drop].tolist(), n[drop].tolist()):
        if letters[w] > LEAST_LENGTH:
            word = words[w].decode()
            at = x % len(word)
            word = (word[:at] + word[at + 1 :]).encode()
            total[word] = total.get(word, 0) + k


def _count(batches):
    total: dict[bytes, int] = {}

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(total)).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    for part in text_slices(batches):
        # crc32 of "<doc_id>:", from which that of "<doc_id>:<run>" goes on
        keys = [zlib.crc32(b"%s:" % (b"" if k is None else str(k).encode())) for k in part.column("key").to_pylist()]
        offs, data = utf8(part.column("text"))
        if len(data) > SLICE_BYTES:  # a single text
            for a, b in blocks(data, _inside(data), SLICE_BYTES):
                _spelled(data[a:b], np.array([0, b - a]), keys, total)
        else:
            _spelled(data, offs, keys, total)
        if len(total) > HELD_WORDS:
            yield out()
            total.clear()
    if total:
        yield out()


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of all words that occur often enough."""
    own = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_arrow(own, _count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def mask(word: Column) -> Column:
    """Letter parities: a bit flips with each occurrence of its letter."""
    letters = F.transform(F.split(word, ""), lambda c: F.pmod(F.ascii(c), F.lit(BITS)))
    return F.aggregate(letters, F.lit(0).cast("long"), lambda m, b: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))


def band(m: Column, k: int) -> Column:
    """Bits k, k + BANDS, k + 2 BANDS ... of a mask: neighbours in the alphabet, and so letters of like frequency, are dealt round."""
    return m.bitwiseAND(F.lit(sum(1 << b for b in range(k, BITS, BANDS))))


def _halves(word: Column, size: Column) -> tuple[Column, Column]:
    """First and last half, for edits of words of `size` letters (and of one more)."""
    half = F.floor(size / 2).cast("int")
    return F.left(word, half), F.right(word, size - half)


def _entries(words: DataFrame, size: Column) -> DataFrame:
    """A row for each band and half of a word: the key under which words of `size` letters (or one more) meet."""
    halves = _halves(F.col("word"), size)
    keys = [F.struct(F.xxhash64(F.lit(k * 2 + j), size, band(F.col("mask"), k), half).alias("key"), F.lit(k).alias("k"), F.lit(j).alias("j")) for k in range(BANDS) for j, half in enumerate(halves)]
    return words.select("word", "n", "size", "mask", F.inline(F.array(*keys)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all pairs one edit apart, both ways."""
    own = words.select("word", "n", F.char_length("word").alias("size"), mask(F.col("word")).alias("mask"))
    own = cut(own, "masks")
    short = _entries(own, F.col("size")).select("key", "k", "j", *[F.col(c).alias(f"a_{c}") for c in ("word", "n", "size", "mask")])
    long = _entries(own, F.col("size") - 1)
    met = _entries(own, F.col("size")).unionByName(long).select("key", *[F.col(c).alias(f"b_{c}") for c in ("word", "n", "size", "mask")])
    a, b = F.col("a_mask"), F.col("b_mask")
    flips = F.bit_count(a.bitwiseXOR(b))
    once = (F.col("b_size") > F.col("a_size")) | (F.col("a_word") < F.col("b_word"))
    earlier = reduce(lambda x, y: x | y, [(F.col("k") > k) & (band(a, k) == band(b, k)) for k in range(BANDS - 1)])
    first_half = (F.col("j") == 1) & (_halves(F.col("a_word"), F.col("a_size"))[0] == _halves(F.col("b_word"), F.col("a_size"))[0])
    one_edit = F.levenshtein("a_word", "b_word", 1) == 1
    pairs = short.join(met, "key").where(once & (flips <= 2) & ~earlier & ~first_half & one_edit)
    there = F.struct(F.col("a_word").alias("word"), F.col("b_word").alias("other"), F.col("b_n").alias("other_n"))
    back = F.struct(F.col("b_word").alias("word"), F.col("a_word").alias("other"), F.col("a_n").alias("other_n"))
    return pairs.select(F.inline(F.array(there, back)))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last. Each round doubles the steps that have been followed."""
    at = cut(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        at = new.select("word", "root")
        if new.where("moved").isEmpty():
            return at


def variants(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = cut(word_counts(docs, text, key), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))  # the largest count, then the least word
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    strong = F.col("form_n") >= RATIO * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")
    )
    found = cut(found, "variants")
    named = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return named.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
