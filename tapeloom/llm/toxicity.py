"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

The features are densities of learned lexicons (whole words and stems), lexicon words near a second-person word, capitals,
punctuation and obfuscation rates. Lexicon, trees and calibration are learned from three disjoint hash parts of a bounded
sample of labelled rows, so none of them sees what another was fitted on. Scoring reads whole texts, a slice at a time.

Defined cases: a null text is empty, and an empty text has a score like any other; a row labelled twice counts twice; equal
texts get equal scores, and so do texts of one calibration step; without rows of both labels the score is the labels' mean (0 without labels); an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import RangeHash, cut, map_arrow, text_slices, utf8, words

#: Labelled rows that a model is fitted on at most (expected number of a hash sample).
TRAIN_ROWS = 15_000
#: Entries of the learned lexicons, words and stems together.
LEXICON = 1024
#: Documents that an entry must stand in, and how much likelier (in nats) it makes the label.
LEAST_DOCS, LEAST_GAIN = 4, 1.2
STEM_BYTES = 6
NEAR = 5

# Second-person words in several languages.
SECOND_PERSON = "you your yours yourself du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro su".split()

FEATURES = ["hits", "density", "gain", "best", "strong", "stem_hits", "stem_density", "near_you", "near_you_share", "second_person", "capitals", "capital_words", "exclamation", "question", "punctuation", "symbol_words", "mixed_words", "stretched", "log_words"]


@dataclass
class Lexicon:
    key: np.ndarray  # sorted hashes of words and stems
    gain: np.ndarray


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    calibration: object
    base: float


def _hash_words(texts: list[str]) -> np.ndarray:
    offs, data = utf8(pa.array(texts, pa.large_string()))
    return np.sort(RangeHash(data).of(offs[:-1], offs[1:]))


_YOU = _hash_words(SECOND_PERSON)


def _lookup(table: np.ndarray, value: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, value[at], 0.0)


def _parsed(col):
    """Offsets, bytes as written, and hash, stem hash, start, end and row of each word of the lower-cased texts."""
    offs, data = utf8(pc.ascii_lower(col))
    start, end, row = words(offs, data)
    ranges = RangeHash(data)
    return offs, utf8(col)[1], ranges.of(start, end), ranges.of(start, np.minimum(end, start + STEM_BYTES)) ^ np.uint64(0x5B), start, end, row


def densities(col, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(col)
    offs, data, word, stem, start, end, row = _parsed(col)
    size = np.diff(offs)
    per_row = lambda mask: np.diff(np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)][offs])
    sum_of = lambda x: np.bincount(row, x, n)
    count = np.bincount(row, minlength=n)
    total, letters = np.maximum(count, 1), (data >= 65) & (data <= 90)
    gain = _lookup(lexicon.key, lexicon.gain, word)
    stem_gain = _lookup(lexicon.key, lexicon.gain, stem)
    hit, you = gain > 0, _lookup(_YOU, np.ones(len(_YOU)), word) > 0
    near = np.zeros(len(word), bool)
    for k in range(1, NEAR + 1):
        if len(word) > k:
            same = row[k:] == row[:-k]
            near[k:] |= same & you[:-k]
            near[:-k] |= same & you[k:]
    near &= hit
    best = np.zeros(n)
    np.maximum.at(best, row, np.maximum(gain, stem_gain))
    in_word = lambda mask: np.diff(np.r_[np.int32(0), np.cumsum(mask, dtype=np.int32)][np.ravel(np.column_stack([start, end]))])[::2]
    digits, upper = in_word((data >= 48) & (data <= 57)), in_word(letters)
    long = end - start
    symbol = np.isin(data, np.frombuffer(b"*@$#+", np.uint8))
    letter = (data >= 97) & (data <= 122) | letters
    inner = np.zeros(len(data), bool)
    inner[1:-1] = symbol[1:-1] & letter[:-2] & letter[2:]
    thrice = np.zeros(len(data), bool)
    thrice[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    bytes_ = np.maximum(size, 1)
    hits, stems = sum_of(hit), sum_of(stem_gain > 0)
    punctuation = (data < 128) & ~letter & (data > 32) & ~((data >= 48) & (data <= 57))
    cols = [
        hits, hits / total, sum_of(gain) / total, best, sum_of(np.maximum(gain, stem_gain) > 2.5), stems, stems / total, sum_of(near), sum_of(near) / np.maximum(hits, 1), sum_of(you) / total,
        per_row(letters) / bytes_, sum_of((upper == long) & (long > 1)) / total, per_row(data == 33) / bytes_, per_row(data == 63) / bytes_, per_row(punctuation) / bytes_,
        per_row(inner) / total, sum_of((digits > 0) & (digits < long)) / total, per_row(thrice) / total, np.log1p(count),
    ]
    return np.column_stack([np.asarray(c, float) for c in cols])


def _features(docs: DataFrame, lexicon: Lexicon, *names: str) -> DataFrame:
    """The named columns and the features of rows with a `text`."""
    own = docs.select("text", *names)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # LEXICON entries

    def run(batches):
        for part in text_slices(batches):
            x = densities(part.column("text"), shared.value)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(part.column(c).combine_chunks() for c in names), flat], [*names, "x"])

    kinds = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in names)
    return map_arrow(own, run, f"{kinds}, x array<double>").withColumn("features", array_to_vector("x")).drop("x")


def learn_lexicon(rows: DataFrame) -> Lexicon:
    """Words and stems that make the label likelier, from the share of documents with each label that hold them."""

    def run(batches):
        for part in text_slices(batches):
            _, _, word, stem, _, _, row = _parsed(part.column("text"))
            label = part.column("label").to_numpy()
            pairs = np.unique(np.column_stack([np.r_[row, row].astype(np.uint64), np.r_[word, stem]]), axis=0)
            key, at = np.unique(pairs[:, 1], return_inverse=True)
            ones = np.bincount(at, label[pairs[:, 0].astype(np.int64)], len(key))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(at, minlength=len(key))), pa.array(ones.astype(np.int64))], ["k", "n", "ones"])

    totals = rows.agg(F.count("*"), F.sum("label")).first()
    n, ones = totals[0], totals[1] or 0
    counts = map_arrow(rows.select("text", "label"), run, "k long, n long, ones long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    gain = F.log((F.col("ones") + 0.5) / (ones + 1)) - F.log((F.col("n") - F.col("ones") + 0.5) / (n - ones + 1))
    best = counts.where(F.col("n") >= LEAST_DOCS).withColumn("gain", gain).where(F.col("gain") > LEAST_GAIN)
    got = best.orderBy(F.desc(F.col("gain") * F.sqrt("ones")), "k").limit(LEXICON).toPandas()
    key = got["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    return Lexicon(key[order], got["gain"].to_numpy(float)[order])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", text: str = "text", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """A model from the labelled rows of docs."""
    marked = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).where("label IS NOT NULL AND key IS NOT NULL")
    own = docs.select(docs[key].alias("key"))
    n = own.join(marked, "key").count()
    if n > rows:
        marked = marked.where(F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * rows / n))
    part = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(100)).alias("part")
    found = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(marked, "key")
    found = cut(found.select("text", "label", part), "labelled")
    mean = found.agg(F.avg("label")).first()[0]
    lexicon = learn_lexicon(found.where("part < 40"))
    x = cut(_features(found.where("part >= 40"), lexicon, "label", "part"), "features")
    seen = {tuple(r) for r in x.select((F.col("part") < 80).alias("t"), "label").distinct().collect()}
    if len(seen) < 4:
        return Model(lexicon, None, None, float(mean or 0.0))
    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=3, stepSize=0.2, minInstancesPerNode=5, seed=7).fit(x.where("part < 80"))
    scored = trees.transform(x.where("part >= 80")).select(vector_to_array("probability")[1].alias("raw"), F.col("label").cast("double").alias("label"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(scored)
    return Model(lexicon, trees, isotonic, float(mean))


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and score of every row."""
    own = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    if model.trees is None:
        return own.select("doc_id", F.lit(model.base).alias("score"))
    out = model.trees.transform(_features(own, model.lexicon, "doc_id")).withColumn("raw", vector_to_array("probability")[1])
    return model.calibration.transform(out).select("doc_id", F.col("calibrated").alias("score"))
