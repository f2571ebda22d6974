"""Every stage of the pipeline on nulls, empty texts, repeated rows, ids with several texts, clashing columns and an empty table."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
#: The columns of documents and names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, fp long, kept binary, spans string, length int, h long, salt int, label string, score double, lang_pred string"


def prose(spark):
    """Texts of one language each, from the table itself."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars BETWEEN 700 AND 4000").orderBy("doc_id").limit(12).collect()
    return [(r.text, r.lang) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    found = prose(spark)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    r = random.Random(2)
    texts = [None, "", "   ", "12 34 ..."] + [t for t, _ in found] + [found[0][0] + " and a little more", found[1][0][:300] + item + found[1][0][300:]]
    rows = [(i, t, [None, "en", "fr"][r.randrange(3)], None if i % 5 == 0 else "s", None, "x", "k", 1, b"", "s", 2, 3, 4, "l", 0.5, "p") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, found[2][0], *rows[0][2:]), (None, None, *rows[0][2:]), (6, found[3][0] + " another text of six", *rows[0][2:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stage_keeps_columns_and_survives(spark, docs, stage):
    got = stage(spark, docs, SF)
    assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes)
    assert got.count() > 0
    none = stage(spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_language_stage(spark, docs):
    got = corpus_pipeline.language_id(spark, docs, SF)
    want = Counter({k: n for k, n in texts(docs).items() if k[1] and any(c.isalpha() for c in k[1])})
    assert texts(got) == want  # only null texts and those without a letter go


def test_near_copy_stage(spark, docs):
    """Of repeated rows one stays, near copies go, rows without an id stay, and of an id's texts one stays."""
    got = texts(corpus_pipeline.ngram_jaccard_join(spark, docs, SF))
    all_ids = {d for d, _ in texts(docs)} - {None}
    assert max(n for (d, _), n in got.items() if d is not None) == 1 and len({d for d, _ in got if d is not None}) == sum(d is not None for d, _ in got)
    assert sum(n for (d, _), n in got.items() if d is None) == 2
    gone = all_ids - {d for d, _ in got}
    assert 16 in gone and not gone & set(range(6))  # the copy with a little more; texts without words are no copies


def test_suffix_stage(spark, docs):
    got = corpus_pipeline.suffix_array_dedup(spark, docs, SF)
    by = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert by == Counter(r.doc_id for r in docs.select("doc_id").collect())  # every row stays, with what is left of its text
    for r in got.select("doc_id", "text", "n_chars").collect():
        assert r.n_chars == len(r.text)
    assert {r.text for r in got.where("doc_id < 3").collect()} == {"", "   "}


def test_decontamination_stage(spark, docs):
    got = texts(corpus_pipeline.benchmark_decontamination(spark, docs, SF))
    want = texts(docs)
    assert not any(d == 17 for d, _ in got) and {d for d, _ in want} - {d for d, _ in got} <= {17} | {d for d, _ in want if d and d > 3}
    assert all(got[k] == n for k, n in want.items() if k in got)


def test_packing_stage(spark, docs):
    got = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.select("doc_id").collect()}
    ends = Counter()
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert corpus_pipeline.pack(spark, docs.limit(0), SF).count() == 0
