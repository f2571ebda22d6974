"""Quality: a linear-chain conditional random field labels every line good or bad; marginals make the document's score.

A line's features are its own and its neighbours'. The field is fitted on documents' labels handed down to their lines; its
forward-backward marginals, weighted by line length, give a document a mean and a least share of good text, and a logistic
curve turns these into the score. Scoring reads whole texts, a slice at a time; all documents of a slice take a step of the
recursion together.

Defined cases: a null text is empty; an empty text is one empty line; a text of one line has no neighbours (zeros); equal
texts get equal scores; without rows of both labels the score is the labels' mean (0.5 without labels); an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import RangeHash, map_arrow, text_slices, utf8, words

#: Labelled rows, and lines of all of them, that a model is fitted on at most (expected numbers of a hash sample).
TRAIN_ROWS, TRAIN_LINES = 8_000, 400_000
BASE = ["capitals", "capital_words", "digits", "marks", "symbols", "clusters", "bars", "word_bytes", "repeats", "distinct", "log_words", "stop_end", "short", "again"]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of a line's features for `good`
    switch: np.ndarray  # 2 x 2 scores of neighbouring labels
    curve: np.ndarray  # logistic weights of (1, mean logit, least logit)
    base: float | None  # the score where there is nothing to learn from


def lines(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes, row) of every line."""
    offs, data = utf8(col)
    low = utf8(pc.ascii_lower(col))[1]
    n = len(offs) - 1
    row_of_break = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offs[:-1], row_of_break + 1], kind="stable")
    row = np.sort(np.r_[np.arange(n), np.searchsorted(offs, row_of_break, "right") - 1], kind="stable")
    end = np.empty_like(start)
    end[:-1] = start[1:]
    end[-1:] = len(data)
    last = np.r_[row[1:] != row[:-1], True][: len(row)]
    end[last] = offs[row[last] + 1]
    size = end - start
    # Words, with line breaks as borders: a break is no word byte, so words never span lines.
    ws, we, _ = words(offs, data)
    of_line = np.searchsorted(start, ws, "right") - 1
    count = np.bincount(of_line, minlength=len(start))
    total, body = np.maximum(count, 1), np.maximum(size, 1)
    sums = lambda mask: np.diff(np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)][np.column_stack([start, end])])[:, 0]
    in_word = lambda mask: np.diff(np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)][np.column_stack([ws, we])])[:, 0] if len(ws) else np.zeros(0)
    per_line = lambda x: np.bincount(of_line, x, len(start))
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    symbol = np.isin(data, np.frombuffer(b"#$%&*+<=>@^_~\\{}[]", np.uint8))
    cluster = np.zeros(len(data), bool)
    cluster[2:] = symbol[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    h = RangeHash(low).of(ws, we)
    same_line = np.r_[False, of_line[1:] == of_line[:-1]][: len(h)]
    repeat = same_line & np.r_[False, h[1:] == h[:-1]][: len(h)]
    distinct = np.zeros(len(start))
    if len(h):
        order = np.lexsort((h, of_line))
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (of_line[order][1:] != of_line[order][:-1])]
        distinct = np.bincount(of_line[order], fresh, len(start))
    tail = np.zeros(len(start), bool)
    full = size > 0
    tail[full] = np.isin(data[end[full] - 1], np.frombuffer(b".!?\"')", np.uint8))
    whole = RangeHash(low).of(start, end)
    again = np.r_[False, (whole[1:] == whole[:-1]) & (row[1:] == row[:-1])][: len(row)] & full
    x = np.column_stack([
        sums(upper) / body, per_line((in_word(upper) == we - ws) & (we - ws > 1)) / total, sums(digit) / body, sums((data == 33) | (data == 63)) / total, sums(symbol) / body, sums(cluster) / total,
        sums(data == 124) / total, np.minimum(per_line(we - ws) / total, 30) / 10, per_line(repeat) / total, distinct / total, np.log1p(count), tail, count < 3, again,
    ]).astype(np.float32)
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        joined = (row[1:] == row[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * joined, x[1:] * joined
    first = np.r_[True, row[1:] != row[:-1]][: len(row)]
    return np.column_stack([x, before, after, first, np.r_[first[1:], True][: len(row)], np.ones(len(x))]), size, row


def marginals(u: np.ndarray, row: np.ndarray, n: int, switch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chance of `good` of each line, of each pair of labels of it and the line before it, and each row's log total."""
    count = np.bincount(row, minlength=n)
    first = np.cumsum(count) - count
    by = np.argsort(-count, kind="stable")
    by = by[count[by] > 0]
    left, at = count[by], first[by]
    e = np.exp(np.clip(np.column_stack([np.zeros(len(u)), u]), -30, 30))
    t = np.exp(np.clip(switch, -30, 30))
    ahead, norm, behind = np.empty((len(u), 2)), np.empty(len(u)), np.ones((len(u), 2))
    for k in range(int(left[0]) if len(left) else 0):
        live = at[: np.searchsorted(-left, -k, "left")] + k
        now = (ahead[live - 1] @ t if k else 1.0) * e[live]
        norm[live] = now.sum(1)
        ahead[live] = now / norm[live, None]
    for k in range(int(left[0]) - 2 if len(left) else -1, -1, -1):
        live = at[: np.searchsorted(-left, -(k + 1), "left")] + k
        behind[live] = (behind[live + 1] * e[live + 1] / norm[live + 1, None]) @ t.T
    both = ahead * behind
    pair = np.zeros((len(u), 2, 2))
    inner = np.flatnonzero(np.r_[False, row[1:] == row[:-1]][: len(row)])
    pair[inner] = ahead[inner - 1][:, :, None] * t[None] * (e[inner] * behind[inner] / norm[inner, None])[:, None, :]
    return both[:, 1] / both.sum(1), pair, np.bincount(row, np.log(norm), n)


def document_features(good: np.ndarray, size: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(1, logit of the length-weighted mean chance, logit of the share of text in good lines) of each row."""
    w = size + 1.0
    total = np.bincount(row, w, n)
    logit = lambda p: np.log(np.clip(p, 1e-4, 1 - 1e-4) / (1 - np.clip(p, 1e-4, 1 - 1e-4)))
    return np.column_stack([np.ones(n), logit(np.bincount(row, w * good, n) / total), logit(np.bincount(row, w * (good > 0.5), n) / total) / 2])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        r = np.eye(len(w)) * ridge
        r[-1 if x.shape[1] > 3 else 0, -1 if x.shape[1] > 3 else 0] = 1e-6
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + r, x.T @ (p - y) + r @ w)
    return w


def fit_field(x: np.ndarray, row: np.ndarray, label: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Weights and label-pair scores that maximise the likelihood of the lines' labels: Adam from a logistic start."""
    n, y = len(label), label[row].astype(float)
    w, s = _logistic(x, y), np.zeros((2, 2))
    joined = np.r_[False, row[1:] == row[:-1]]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][joined[1:]].astype(int), y[1:][joined[1:]].astype(int)), 1)
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, steps + 1):
        good, pair, _ = marginals(x @ w, row, n, s)
        g = np.r_[x.T @ (good - y) + 0.5 * w, (pair.sum(0) - seen).ravel() + 5.0 * s.ravel()] / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, s = w - step[:-4], s - step[-4:].reshape(2, 2)
    return w, s


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS, max_lines: int = TRAIN_LINES) -> Model:
    """A model from a bounded sample of the labelled rows of docs, drawn without regard to their length.

    The lines' features of the sample pass the driver: about max_lines rows of 45 single-precision numbers.
    """
    marked = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label IS NOT NULL AND key IS NOT NULL")
    breaks = F.octet_length(docs[text]) - F.octet_length(F.translate(docs[text], "\n", ""))
    sizes = docs.select(docs[key].alias("key"), (1 + F.coalesce(breaks, F.lit(0))).alias("lines"))  # no text is dealt for its size
    n, total = sizes.join(marked, "key").agg(F.count("*"), F.sum("lines")).first()
    share = min(rows / max(n, 1), max_lines / max(total or 0, 1))
    if share < 1:
        marked = marked.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * share))
    found = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(marked, "key")

    def run(batches):
        for part in text_slices(batches):
            x, size, row = lines(part.column("text"))
            key, mark = (part.column(c).to_numpy()[row] for c in ("key", "label"))
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(np.arange(len(row)), pa.int64()), pa.array(mark, pa.int32()), pa.array(size, pa.int64()), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary())], ["key", "nth", "label", "size", "x"])

    got = map_arrow(found.select("key", "text", "label"), run, "key long, nth long, label int, size long, x binary").toPandas()
    width = 3 * len(BASE) + 3
    if got["label"].nunique() < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)), np.zeros(3), float(got["label"].mean()) if len(got) else 0.5)
    got = got.sort_values(["key", "nth"], kind="stable")
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), -1).astype(float)
    _, first, row = np.unique(got["key"].to_numpy(), return_index=True, return_inverse=True)
    y = got["label"].to_numpy()[first]
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    mean[-1], scale[-1] = 0, 1
    x = (x - mean) / scale
    fitted = np.arange(len(y)) % 4 != 0  # the curve is fitted on the documents that the field has not seen
    own = fitted[row]
    if len({*y[fitted]}) < 2 or len({*y[~fitted]}) < 2:
        fitted[:] = True
        own = fitted[row]
    names = np.cumsum(fitted) - 1
    w, s = fit_field(x[own], names[row[own]], y[fitted])
    good, _, _ = marginals(x @ w, row, len(y), s)
    d = document_features(good, got["size"].to_numpy(), row, len(y))
    rest = ~fitted if not fitted.all() else fitted
    return Model(mean, scale, w, s, _logistic(d[rest], y[rest]), None)


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, score, lines and bad lines of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred numbers

    def run(batches):
        m = shared.value
        for part in text_slices(batches):
            n = part.num_rows
            x, size, row = lines(part.column("text"))
            good, _, _ = marginals(((x - m.mean) / m.scale) @ m.weight, row, n, m.switch)
            p = 1 / (1 + np.exp(-document_features(good, size, row, n) @ m.curve)) if m.base is None else np.full(n, m.base)
            yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(p), pa.array(np.bincount(row, minlength=n), pa.int64()), pa.array(np.bincount(row, good < 0.5, n).astype(np.int64))], ["doc_id", "score", "n_lines", "n_bad_lines"])

    return map_arrow(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")), run, "doc_id long, score double, n_lines long, n_bad_lines long")
