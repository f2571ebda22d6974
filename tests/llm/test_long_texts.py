"""Texts longer than the block that operators work in: what stands beyond the first block counts like the rest."""

from __future__ import annotations

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tapeloom.llm import chaining, decontaminate, langid, media, neardup, packing, quality, toxicity
from tapeloom.llm.common import SLICE_BYTES, table

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts(spark):
    """A text of 2.5 blocks of one language's words in random order, a near copy, one that shares a passage at its end, a short one."""
    rows = table(spark, SF, "documents").where("lang = 'en'").orderBy("doc_id").collect()
    words = sorted({w for r in rows for w in r.text.split()})
    r = random.Random(12)
    long = []
    size = 0
    while size < 2.5 * SLICE_BYTES:
        long.append(r.choice(words))
        size += len(long[-1].encode()) + 1
    passage = [r.choice(words) for _ in range(80)]
    item = " ".join(r.choice(words) for _ in range(25))
    return {1: " ".join(long) + " " + item, 2: " ".join([*long[5:], "fin"]), 3: " ".join([r.choice(words) for _ in range(len(long))] + passage), 4: " ".join(words[:40] + passage), 5: item, 6: "é" * SLICE_BYTES}


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def test_language(spark, docs):
    got = {r.doc_id: r for r in langid.predict(docs, langid.fit(table(spark, SF, "documents"))).collect()}
    assert all(got[k].lang_pred == "en" and got[k].score > 0.9 for k in (1, 2, 3))


def test_near_copies(docs):
    got = {r.doc_id: r for r in neardup.join(docs)[0].collect()}
    assert got[2].group_id == 1 and got[2].n_links == 1 and all(got[k].group_id == k for k in (3, 4, 5, 6))


def test_passages_and_leaks_beyond_the_first_block(spark, docs, texts):
    got = {(r.doc_id, r.source_id): r for r in chaining.passages(docs).collect()}
    assert (2, 1) in got and (4, 3) in got and got[4, 3].equal_words >= 80 and got[4, 3].source_start > 100_000
    items = spark.createDataFrame([(7, texts[5])], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.search(docs, items).collect()} == {(1, 7), (5, 7)}


def test_media_and_packing(docs, texts):
    want = {hashlib.sha256(t.encode() + b" " * (-len(t.encode()) % media.WIDTH)).hexdigest() for t in texts.values()}
    assert {r.payload_sha256 for r in media.read_back(media.store(docs)).collect()} == want
    packed = packing.pack(docs, BPE).collect()
    plain = Tokenizer.from_file(BPE)
    for k in (1, 4, 6):
        own = [r for r in packed if r.doc_id == k]
        n = len(plain.encode(texts[k], add_special_tokens=False).ids) + 1
        assert {r.doc_tokens for r in own} == {n} and sum(r.length for r in own) == n


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_scores(spark, docs, module, label):
    model = module.fit(table(spark, SF, "documents"), table(spark, SF, "labels"), label=label)
    got = {r.doc_id: r.score for r in module.score(docs, model).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and all(0 <= s <= 1 for s in got.values())
    assert abs(got[1] - got[2]) < 0.05  # near copies are alike
