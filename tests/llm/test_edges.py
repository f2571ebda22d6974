"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and an empty table."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chaining, decontaminate, langid, media, neardup, packing, quality, sharding, suffix_dedup, toxicity

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, row string, h long, label string, salt int, features string, digest string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(60_000, 1)
    near = words(200, 2)
    texts = [None, "", "   \n\n ", "123 456 !!!", "one", "two words", words(120, 3), words(120, 3), near, near + " tail of it", long, long[:5000], "é" * 150 + " ünï " * 40, "☃" * 200, "Total junk $$$ %%%\nline two\n\n\nline"]
    rows = [(i, t, [None, "en", "de"][i % 3], None, None, "x", "y", 7, "z", 1, None, None) for i, t in enumerate(texts)]
    rows += [rows[6], (None, words(150, 5), "en", *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(15)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark, docs):
    return spark.createDataFrame([(1, words(200, 2)[:300], "x"), (2, None, "x"), (3, "", "x"), (4, "two words", "x"), (5, "two words", "x")], "item_id long, text string, key string")


def ids(df):
    return sorted([r.doc_id for r in df.select("doc_id").collect()], key=lambda x: (x is None, x))


ALL = sorted([*range(15), 6]) + [None]


def test_language(docs):
    model = langid.fit(docs)
    got = langid.predict(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 17 and all(by[i].lang_pred == "und" and by[i].score == 0 for i in (0, 1, 2, 3, 13))
    assert all(0 <= r.score <= 1 for r in got) and by[10].lang_pred in ("en", "de")
    empty = docs.limit(0)
    none = langid.fit(empty)
    assert none.langs == [] and langid.predict(empty, model).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(docs, model, carry=("text", "row")).select("row.text", "row.row").count() == 17


def test_near_duplicates(docs):
    members, links = neardup.join(docs)
    by = {r.doc_id: r for r in members.collect()}
    assert members.count() == 17 and by[7].class_id == 6 and by[9].group_id == 8 and by[9].n_links == 1
    assert all(by[i].group_id == i and by[i].n_links == 0 for i in (0, 1, 2, 5, 11))
    assert [(r.a, r.b) for r in links.collect()] == [(8, 9)]
    assert neardup.join(docs.limit(0))[0].count() == 0


def test_suffix_dedup(docs):
    got = suffix_dedup.dedup(docs, carry=("source", "row"))
    by = {r.doc_id: r for r in got.collect()}
    assert ids(got) == ALL
    assert by[0].n_bytes == 0 and by[0].spans == [] and bytes(by[0].kept) == b""
    assert bytes(by[7].kept) == b"" and by[6].spans == [] and bytes(by[11].kept) == b""
    assert len(by[13].spans) == 1  # a run of one character repeats itself
    assert by[None].spans == []
    assert suffix_dedup.dedup(docs.limit(0)).count() == 0


def test_decontaminate(docs, items):
    got = {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items).collect()}
    assert got == {(8, 1), (9, 1), (5, 4), (5, 5)}
    assert got == {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items, block_bytes=64).collect()}
    assert decontaminate.search(docs, items.limit(0)).count() == 0 and decontaminate.search(docs.limit(0), items).count() == 0


def test_packing(docs):
    got = packing.pack(docs, BPE)
    total = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert len(total) == 16 and {r.t for r in total if r.doc_id in (0, 1)} == {1}
    assert packing.pack(docs.limit(0), BPE).count() == 0


def test_sharding(docs):
    got = sharding.shard_rows(docs, 4).collect()
    assert len(got) == 17 and {r.size for r in got if r.doc_id in (0, 1)} == {1}
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_rows(docs.limit(0), 4).count() == 0


@pytest.mark.parametrize(("fit", "score", "label"), [(quality.fit, quality.score, "quality"), (toxicity.fit, toxicity.score, "toxic")])
def test_classifiers(docs, labels, fit, score, label):
    for known in (labels, labels.limit(0)):
        got = score(docs, fit(docs, known, label=label))
        assert ids(got) == ALL and all(0 <= r.score <= 1 for r in got.collect())
    assert score(docs.limit(0), fit(docs, labels.limit(0), label=label)).count() == 0


def test_media(spark, docs):
    got = media.read_back(media.store(docs)).collect()
    assert len(got) == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert all(r.payload_bytes % media.WIDTH == 0 and r.payload_bytes for r in got)
    assert media.store(docs.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p>never closed <img src='digest:" + "0" * 64)], "page_id long, html string")
    items = {r.row.page_id: r["items"] for r in media.interleaved(pages, carry=("page_id",)).collect()}
    assert items[1] == [] and items[2] == [] and items[3][0].text.startswith("never closed")


def test_passages(docs):
    got = chaining.passages(docs).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert (7, 6) in pairs and (9, 8) in pairs and (11, 10) in pairs
    assert not {r.doc_id for r in got} & {0, 1, 2, 3, 4, 5, None}
    assert chaining.passages(docs.limit(0)).count() == 0
