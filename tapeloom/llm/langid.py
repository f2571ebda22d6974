"""Language identification: script ranges narrow each word's candidates, a Viterbi path over per-word scores labels spans.

A word scores the log-probability of its byte trigrams under each language; changing the language between two words
costs `penalty`. The best path is found exactly, in blocks of words: each block's best score from every entry language
to every exit language is computed for all blocks at once, the blocks of a text are chained, and the labels are where
forward plus backward scores are highest. Whole texts are read; memory is bounded by a slice of texts.

Defined cases: a null text, or one without a letter, is `und` with score 0; ties, also
those of a text that says nothing, go to the first language in sorted order; equal rows get
equal results; without training rows every text is `und`; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import _WORD, SLICE_BYTES, map_arrow, text_slices, utf8, words

BITS = 18
BLOCK = 32
SWITCH_PENALTY = 9.0
#: Documents that the per-word scores are learned from at most (expected number of a hash sample).
TRAIN_DOCS = 12_000
UNKNOWN = "und"
FAR = np.float32(-60.0)

# First bytes of UTF-8 characters by script, from the Unicode blocks.
LATIN, GREEK, CYRILLIC, ARMENIAN, HEBREW, ARABIC, INDIC, OTHER, KANA, HAN, HANGUL = range(1, 12)
SCRIPT_RANGES = [
    (0x41, 0x5B, LATIN), (0x61, 0x7B, LATIN), (0xC3, 0xCA, LATIN), (0xCA, 0xCE, OTHER), (0xCE, 0xD0, GREEK), (0xD0, 0xD4, CYRILLIC),
    (0xD4, 0xD6, ARMENIAN), (0xD6, 0xD8, HEBREW), (0xD8, 0xDC, ARABIC), (0xDC, 0xE0, OTHER), (0xE0, 0xE1, INDIC), (0xE1, 0xE2, OTHER),
    (0xE3, 0xE4, KANA), (0xE4, 0xEA, HAN), (0xEA, 0xEE, HANGUL), (0xEF, 0xF5, OTHER),
]
_SCRIPT = np.zeros(256, np.uint8)
for _a, _b, _s in SCRIPT_RANGES:
    _SCRIPT[_a:_b] = _s


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # bucket x language
    allowed: np.ndarray  # script x language


def _trigrams(offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes around each byte; what is no word byte counts as a space."""
    x = np.where(_WORD[data], data, np.uint8(32)).astype(np.uint32)
    before, after = np.empty_like(x), np.empty_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    full = np.flatnonzero(np.diff(offs) > 0)
    before[offs[full]] = 32
    after[offs[full + 1] - 1] = 32
    return ((before << np.uint32(16) | x << np.uint32(8) | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", max_docs: int = TRAIN_DOCS) -> Model:
    """Byte-trigram and script counts of each language from a hash sample of about `max_docs` rows."""
    rows = docs.where(docs[lang].isNotNull() & docs[text].isNotNull())
    n = rows.count()
    if n > max_docs:
        rows = rows.where(F.pmod(F.xxhash64(docs[key]), F.lit(1 << 20)) < int((1 << 20) * max_docs / n))

    def count(batches):
        for part in text_slices(batches):
            names = part.column("lang").to_pylist()
            offs, data = utf8(pc.utf8_lower(part.column("text")))
            if not len(data):
                continue
            bucket, row = _trigrams(offs, data), np.repeat(np.arange(len(names)), np.diff(offs))
            start, _, word_row = words(offs, data)
            script = np.maximum.reduceat(_SCRIPT[data] * _WORD[data], start) if len(start) else start
            for name in sorted(set(names)):
                own = np.array([x == name for x in names])
                n = np.bincount(bucket[own[row] & _WORD[data]], minlength=1 << BITS)
                s = np.bincount(script[own[word_row]], minlength=16)
                keys = np.concatenate([np.flatnonzero(n), -1 - np.flatnonzero(s)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys, pa.int64()), pa.array(np.concatenate([n[n > 0], s[s > 0]]), pa.int64())], ["lang", "k", "n"])

    out = map_arrow(rows.select(docs[lang].alias("lang"), docs[text].alias("text")), count, "lang string, k long, n long")
    found = out.groupBy("lang", "k").agg(F.sum("n").alias("n")).toPandas()  # at most 2 ** BITS + 16 numbers a language
    langs = sorted(found["lang"].unique())
    score, scripts = np.full((1 << BITS, len(langs)), 0.05), np.zeros((16, len(langs)))
    at = found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int)
    k, n = found["k"].to_numpy(int), found["n"].to_numpy(float)
    np.add.at(score, (k[k >= 0], at[k >= 0]), n[k >= 0])
    np.add.at(scripts, (-1 - k[k < 0], at[k < 0]), n[k < 0])
    score = np.log(score / np.maximum(score.sum(0), 1))
    allowed = scripts >= 0.01 * np.maximum(scripts.sum(0), 1)
    allowed |= ~allowed.any(1, keepdims=True)
    allowed[0] = True
    return Model(langs, score.astype(np.float32), allowed)


def _scores(model: Model, offs: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = len(model.langs)
    lp = np.zeros((len(data) + 1, m), np.float32)
    lp[:-1] = model.score[_trigrams(offs, data)]
    ends = np.ravel(np.column_stack([start, end]))
    e = np.add.reduceat(lp, ends, axis=0)[::2]
    lead = _SCRIPT[data]
    script = np.maximum.reduceat(np.append(lead, 0), ends)[::2]
    letters = np.add.reduceat(np.append(lead > 0, False).astype(np.int32), ends)[::2]
    e -= e.max(1, keepdims=True)
    e = np.where(model.allowed[script], e, FAR)
    e[script == 0] = 0
    return np.maximum(e, FAR), np.where(script > 0, letters, 0)


def word_scores(model: Model, offs: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Score of each word under each language (best 0), the word's letters (0: no letter), and its row.

    A long text is scored in runs of whole words of about SLICE_BYTES; a border between two runs is a space, as between words.
    """
    start, end, row = words(offs, data)
    if not len(start):
        return np.zeros((0, len(model.langs)), np.float32), start, row
    if len(data) <= SLICE_BYTES:
        return *_scores(model, offs, data, start, end), row
    out, at = [], 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE_BYTES, "right")))
        a, b = int(start[at]), int(end[to - 1])
        inner = np.unique(np.clip(offs, a, b)) - a
        out.append(_scores(model, np.unique(np.r_[0, inner, b - a]), data[a:b], start[at:to] - a, end[at:to] - a))
        at = to
    return np.concatenate([e for e, _ in out]), np.concatenate([n for _, n in out]), row


def viterbi(e: np.ndarray, row: np.ndarray, n_rows: int, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Language index of each word on the best path of its row."""
    m = e.shape[1]
    n = np.bincount(row, minlength=n_rows)
    blocks = -(-n // BLOCK)
    first = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    place = first[row] * BLOCK + (np.arange(len(row)) - (np.cumsum(n) - n)[row])
    x = np.zeros((total * BLOCK, m), np.float32)
    x[place] = e
    x = np.ascontiguousarray(x.reshape(total, BLOCK, m).transpose(1, 0, 2))
    pen = np.float32(penalty)
    step = np.where(np.eye(m, dtype=bool), np.float32(0), -pen)
    through = step[None] + x[0][:, None, :]
    for t in range(1, BLOCK):
        through = np.maximum(through, through.max(2, keepdims=True) - pen) + x[t][:, None, :]
    ahead, behind = np.zeros((total, m), np.float32), np.zeros((total, m), np.float32)
    longest = np.argsort(-blocks, kind="stable")
    longest = longest[blocks[longest] > 0]
    at, left = first[longest], blocks[longest]
    f, b = np.zeros((len(longest), m), np.float32), np.zeros((len(longest), m), np.float32)
    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, "left"))  # rows with more than k blocks
        ahead[at[:live] + k] = f[:live]
        f[:live] = (f[:live, :, None] + through[at[:live] + k]).max(1)
        f[:live] -= f[:live].max(1, keepdims=True)
        behind[at[:live] + left[:live] - 1 - k] = b[:live]
        b[:live] = (b[:live, None, :] + through[at[:live] + left[:live] - 1 - k]).max(2)
        b[:live] -= b[:live].max(1, keepdims=True)
    forward = np.empty_like(x)
    now = ahead
    for t in range(BLOCK):
        now = np.maximum(now, now.max(1, keepdims=True) - pen) + x[t]
        forward[t] = now
    label = np.empty((BLOCK, total), np.int16)
    now = behind
    for t in range(BLOCK - 1, -1, -1):
        label[t] = (forward[t] + now).argmax(1)
        now = now + x[t]
        now = np.maximum(now, now.max(1, keepdims=True) - pen)
    return label.T.reshape(-1)[place]


def predict(
    docs: DataFrame,
    model: Model,
    *,
    text: str = "text",
    key: str = "doc_id",
    penalty: float = SWITCH_PENALTY,
    spans: bool = True,
    carry: tuple[str, ...] = (),
    keep_text: bool = False,
) -> DataFrame:
    """doc_id, lang_pred and score of every row.

    More columns: spans (first word, words, language; if asked for), the text (with keep_text) and row (the columns in carry).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2 ** BITS numbers a language
    lettered = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False))
    row = F.struct(F.lit(0).alias("_"), *[docs[c] for c in carry]).alias("row")
    own = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text"), lettered.alias("lettered"), row)
    schema = "doc_id long, lang_pred string, score double"
    if spans:
        schema += ", spans array<struct<first_word:int,n_words:int,lang:string>>"
    if keep_text:
        schema += ", text string"
    schema += f", row {own.schema['row'].dataType.simpleString()}"

    def labelled(label, row, lettered, names, k):
        """Arrow lists of each row's spans: runs of words of one language."""
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
        new &= lettered[row]
        begin = np.flatnonzero(new)
        done = np.searchsorted(row, row[begin], "right")
        size = np.minimum(np.append(begin[1:], len(row)), done) - begin if len(begin) else begin
        inner = begin - np.searchsorted(row, row[begin], "left") if len(begin) else begin
        cols = [pa.array(inner, pa.int32()), pa.array(size, pa.int32()), pa.array(names[label[begin]], pa.string())]
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[begin], minlength=k))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(cols, ["first_word", "n_words", "lang"]))

    def run(batches):
        model = shared.value
        names = np.array([*model.langs, UNKNOWN], object)
        for part in text_slices(batches, nulls="absent"):
            k = part.num_rows
            lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool) & bool(model.langs)
            if model.langs:
                e, letters, row = word_scores(model, *utf8(pc.utf8_lower(part.column("text"))))
                label = viterbi(e, row, k, penalty)
                weight = np.bincount(row * len(model.langs) + label, letters, k * len(model.langs)).reshape(k, -1)
            else:
                weight, label, row = np.zeros((k, 1)), np.empty(0, int), np.empty(0, int)
            best = np.where(lettered, weight.argmax(1), len(model.langs))
            share = weight.max(1) / np.maximum(weight.sum(1), 1)
            cols = {"doc_id": part.column("key").combine_chunks(), "lang_pred": pa.array(names[best], pa.string()), "score": pa.array(np.where(lettered, share, 0.0))}
            if spans:
                cols["spans"] = labelled(label, row, lettered, names, k)
            if keep_text:
                body = part.column("text").combine_chunks().cast(pa.string())
                cols["text"] = pc.if_else(part.column("absent").combine_chunks(), pa.scalar(None, pa.string()), body)
            cols["row"] = part.column("row").combine_chunks()
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    return map_arrow(own, run, schema)
