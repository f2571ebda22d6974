"""A corpus pipeline over `documents`: language, near copies, repeated substrings, benchmark leaks, packing.

Each stage takes the previous one's rows and, but for the last, returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tapeloom.llm import decontaminate, langid, neardup, packing, suffix_dedup
from tapeloom.llm.common import cut, held_out, table

#: Part of a document's letters that its language must have at least.
MAIN_LANGUAGE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a language (null or no letter) and those in which no language prevails."""
    model = langid.fit(docs.where(~held_out(docs.doc_id, 3, 1)))
    others = tuple(c for c in docs.columns if c != "text")
    found = langid.predict(docs, model, spans=False, carry=others, keep_text=True)
    good = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MAIN_LANGUAGE))
    return good.select(*["text" if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near copies; rows without a doc_id stay.

    Of several rows of one doc_id the one whose columns hash least stays.
    """
    members, _ = neardup.join(docs)
    keep = members.where("doc_id = group_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(keep, "doc_id", "left_semi")
    row = F.struct(*[named[c] for c in docs.columns])
    named = named.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(*[named[c] for c in docs.columns])).alias("row")).select("row.*")
    return named.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove the bytes of repeated 100-byte strings; a character cut in two goes whole."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))

    found = suffix_dedup.dedup(docs, carry=others, whole_characters=True).withColumn("text", F.col("kept").cast("string"))
    made = {"n_chars": F.char_length("text").cast("long")} | {c: F.col("row")[c] for c in others}
    return found.select(*[made[c].alias(c) if c in made else c for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; rows without a doc_id stay."""
    leaks = decontaminate.search(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack what is left."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: Neither the learned language scores nor the tokenizer can be written in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
