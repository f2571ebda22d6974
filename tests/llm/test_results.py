"""Results against brute force, round trips and held-out labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import chaining, langid, media, neardup, packing, quality, queries, sharding, suffix_dedup, toxicity
from tapeloom.llm.common import held_out, table

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, SMALL, "documents").toPandas().sort_values("doc_id")


def shingle_set(text: str) -> frozenset:
    w = re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", text.lower())
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def similar_groups(texts: dict[int, str]) -> tuple[dict[int, int], Counter]:
    """Least id of each text's component, and its links (by words' sequence, as the operator has classes)."""
    seq, cls = {}, {}
    for k in sorted(texts):
        w = tuple(re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", texts[k].lower()))
        cls[k] = seq.setdefault(w, k) if w else k
    sets, links, root = {k: shingle_set(texts[k]) for k in set(cls.values())}, Counter(), {}
    names = sorted(sets)
    root = {k: k for k in names}
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= 0.8 * len(x | y):
                links.update((a, b))
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    return {k: root[c] for k, c in cls.items()}, Counter({k: links[c] for k, c in cls.items()})


def kept_bytes(texts: dict[int, str], n: int = 100, whole: bool = False) -> dict[int, bytes]:
    seen, out = set(), {}
    for k in sorted(texts):
        b = texts[k].encode()
        edge = np.zeros(len(b) + 1, int)
        for i in range(len(b) - n + 1):
            if b[i : i + n] in seen:
                edge[i] += 1
                edge[i + n] -= 1
            seen.add(b[i : i + n])
        stay = np.cumsum(edge[:-1]) <= 0
        if whole:
            at = 0
            for c in texts[k]:
                size = len(c.encode())
                stay[at : at + size] = stay[at : at + size].all()
                at += size
        out[k] = bytes(np.frombuffer(b, np.uint8)[stay])
    return out


def best_path(e: np.ndarray, penalty: float) -> float:
    score = e[0].copy()
    for x in e[1:]:
        score = np.maximum(score, score.max() - penalty) + x
    return float(score.max())


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(0, 90, 4)
        e = (-5 * rng.random((sizes.sum(), 4))).astype(np.float32)
        row = np.repeat(np.arange(4), sizes)
        label = langid.viterbi(e, row, 4, 3.0)
        for r in range(4):
            own, lab = e[row == r], label[row == r]
            if len(own):
                assert abs(own[np.arange(len(own)), lab].sum() - 3.0 * (lab[1:] != lab[:-1]).sum() - best_path(own, 3.0)) < 1e-3


def test_language_held_out(spark):
    got = queries.op10_language_id(spark, MEDIUM).join(table(spark, MEDIUM, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.99


def test_mixed_language_spans(spark):
    docs = table(spark, MEDIUM, "documents")
    model = langid.fit(docs)
    parts = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("n_chars > 600").orderBy("doc_id").collect()}
    mixed = spark.createDataFrame([(1, parts["en"] + " " + parts["de"])], "doc_id long, text string")
    spans = langid.predict(mixed, model).first().spans
    assert [s.lang for s in spans] == ["en", "de"] and abs(spans[1].first_word - 60) < 25


def auc(score, label) -> float:
    r = pd.Series(score).rank().to_numpy()
    n = label.sum()
    return (r[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("query", "label", "least"), [(queries.op1_toxicity, "toxic", 0.9), (queries.op5_quality_classifier, "quality", 0.97)])
def test_classifiers_held_out(spark, query, label, least):
    got = query(spark, MEDIUM).join(table(spark, MEDIUM, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(got["score"], got[label].to_numpy()) > least


def test_marginals_against_all_paths():
    u, s = np.array([0.3, -1.0, 2.0, 0.5]), np.array([[0.7, -0.2], [0.1, 0.9]])
    total, good = 0.0, np.zeros(4)
    for k in range(16):
        y = [(k >> i) & 1 for i in range(4)]
        p = np.exp(sum(u[i] * y[i] for i in range(4)) + sum(s[a, b] for a, b in zip(y, y[1:])))
        total += p
        good += p * np.array(y)
    got, pair, log_total = quality.marginals(np.r_[u, u[:1]], np.array([0, 0, 0, 0, 1]), 2, s)
    assert np.allclose(got[:4], good / total) and np.allclose(log_total[0], np.log(total)) and np.allclose(pair[1:4].sum((1, 2)), 1)


def test_near_duplicates_with_families(spark, small, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 3)
    base = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 9).split()
    near = {10_000 + i: " ".join(w if j % 37 or j // 37 != i % 3 else f"x{i}" for j, w in enumerate(dict.fromkeys(f"{w}{j}" for j, w in enumerate(base)))) for i in range(12)}
    texts = dict(zip(small["doc_id"].tolist(), small["text"])) | near
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group, links = similar_groups(texts)
    got = neardup.join(docs)[0].toPandas().set_index("doc_id")
    assert got["group_id"].to_dict() == group
    assert got["n_links"].to_dict() == {k: links[k] for k in texts}
    assert len({group[k] for k in near}) == 1


def test_cores_are_similar_by_proof(spark):
    rng = np.random.default_rng(21)
    base = rng.choice(1 << 40, 60, replace=False).astype(np.uint64)
    sets = {}
    for k in range(60):
        gone, new = int(rng.integers(0, 6)) if k else 0, int(rng.integers(0, 6)) if k else 0
        own = np.sort(np.r_[rng.permutation(base)[gone:], rng.choice(1 << 41, new, replace=False).astype(np.uint64)])
        sets[k] = set(own.tolist()), own.tobytes()
    rows = spark.createDataFrame([(k, bytearray(b)) for k, (_, b) in sets.items()], "doc_id long, sh binary")
    of = spark.createDataFrame([(k, 0) for k in sets], "doc_id long, family long")
    core = {r.doc_id for r in neardup.cores(of, rows, 0.8).collect() if r.core}
    similar = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    assert 0 in core and 5 < len(core) < 60 and all(similar(sets[a][0], sets[b][0]) for a in core for b in core)
    got = neardup.family_links(of, rows, 0.8).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    want = {a: sum(similar(sets[a][0], sets[b][0]) for b in sets) - 1 for a in sets}
    assert {r.doc_id: r.n for r in got} == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_suffix_dedup(spark, small, parts):
    want = kept_bytes(dict(zip(small["doc_id"].tolist(), small["text"])))
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(table(spark, SMALL, "documents").repartition(parts)).collect()}
    assert got == want


def test_suffix_dedup_of_a_common_line(spark):
    rng = np.random.default_rng(11)
    letters = lambda n: "".join(rng.choice(list("abcdefghijklmnop"), n))
    line = letters(150)
    texts = {k: letters(90) + line[k % 3 :] + letters(int(rng.integers(0, 200))) for k in range(300)}
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()}
    assert got == kept_bytes(texts)


def test_suffix_dedup_of_long_texts(spark):
    rng = np.random.default_rng(12)
    part = rng.integers(97, 123, 700_000, dtype=np.uint8).tobytes().decode()
    texts = {1: part + "x" * 150 + part[:500_000], 2: part[300_000:] * 2 + part[:1000]}  # longer than SLICE_BYTES
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == kept_bytes(texts)


def test_packing_round_trip(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BPE)
    ids = {k: np.array([*e.ids, 1], "<u4") for k, e in zip(small["doc_id"], tok.encode_batch(small["text"].tolist(), add_special_tokens=False))}
    got = packing.pack(table(spark, SMALL, "documents"), BPE).toPandas()
    for k, g in got.sort_values("start").groupby("doc_id"):
        assert (g["start"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() == len(ids[k]) == g["doc_tokens"].iloc[0]
        assert all(zlib.crc32(ids[k][a : a + n]) == c for a, n, c in zip(g["start"], g["length"], g["ids_crc32"]))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= packing.SEQUENCE
    assert got["length"].sum() > 0.97 * packing.SEQUENCE * got["sequence_id"].nunique()


def test_special_token_text():
    from tokenizers import Tokenizer

    text = "a <|endoftext|> b<|endoftext|>"
    assert packing.encoder(BPE)(text) == Tokenizer.from_file(BPE).encode(text, add_special_tokens=False).ids


def test_pack_group_costs():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 4000)
    p, n = packing.pack_group(lengths)
    assert np.bincount(p[:, 0], p[:, 2]).tolist() == lengths.tolist() and n == np.ceil(lengths.sum() * (1 + packing.SLACK) / packing.SEQUENCE)
    cost = np.bincount(p[:, 3], packing.LINEAR * p[:, 2] + packing.QUADRATIC * p[:, 2] ** 2.0)
    assert cost.max() < 1.15 * cost.mean()


@pytest.mark.parametrize("slack", [0, packing.SLACK])
def test_pack_group_against_all_sequences(slack):
    rng = np.random.default_rng(3)
    lengths = np.minimum(rng.lognormal(np.log(400), 1, 3000).astype(int) + 1, 9000)
    p, n = packing.pack_group(lengths, slack=slack)
    # replay: a document goes to a cheapest sequence with room; only if there is none, it is cut over those with the most
    first = int((lengths // packing.SEQUENCE).sum())
    fill, cost, left, cut = np.zeros(n, int), np.zeros(n), lengths % packing.SEQUENCE, np.zeros(len(lengths), bool)
    fill[:first] = packing.SEQUENCE
    for d, _, take, s, offset in p[first:].tolist():
        room = packing.SEQUENCE - fill
        cut[d] |= not (room >= left[d]).any()
        among = room == room.max() if cut[d] else room >= left[d]
        assert offset == fill[s] and take == min(left[d], room[s]) and among[s] and cost[s] == cost[among].min()
        fill[s], cost[s], left[d] = fill[s] + take, cost[s] + packing.LINEAR * take + packing.QUADRATIC * take * take, left[d] - take
    assert not left.any() and cut.any() and np.bincount(p[:, 0]).max() <= 6
    assert n * packing.SEQUENCE - lengths.sum() <= slack * lengths.sum() + packing.SEQUENCE


def test_pack_equal_lengths_in_order():
    p, n = packing.pack_group(np.full(10, 1024))
    assert p[:, 0].tolist() == list(range(10)) and n == 6 and np.bincount(p[:, 0]).max() == 1


def test_sharding_map(spark):
    placed = sharding.shard_rows(table(spark, MEDIUM, "documents")).toPandas()
    load = placed.groupby("shard")["size"].sum()
    assert len(load) == 16 and load.max() - load.min() < 0.002 * load.mean()
    rng = np.random.default_rng(2)
    size, start = rng.integers(0, 1000, 4096), np.arange(4096) % 8
    new = sharding.rebalance(start, size, 9)
    assert (new != start).mean() < 0.25 and set(new) == set(range(9))


def test_sharding_map_is_stored_and_edited(spark, tmp_path):
    path, docs = str(tmp_path / "map"), table(spark, SMALL, "documents")
    first = sharding.shard_rows(docs, 4, path=path).toPandas().set_index("doc_id")
    assert sharding.versions(spark, path) == [1, 2] and set(first["map_version"]) == {2}
    again = sharding.shard_rows(docs, 4, path=path).toPandas().set_index("doc_id")
    assert set(again["map_version"]) == {3} and (again["shard"] == first["shard"]).all()  # nothing to move
    grown = sharding.shard_rows(docs, 5, path=path).toPandas().set_index("doc_id")
    moved = grown["shard"] != again["shard"]
    assert 0 < moved.mean() < 0.5 and set(grown["shard"]) == set(range(5))
    old = sharding.read_map(spark, path, 2).orderBy("slot").toPandas()  # former versions stay as they were
    assert old["shard"].to_numpy()[first["vslot"]].tolist() == first["shard"].tolist()
    for r in docs.collect():
        raw = (r.text or "").encode()
        assert (first.loc[r.doc_id, "size"], first.loc[r.doc_id, "text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))


def test_sharding_of_equal_rows(spark):
    docs = spark.createDataFrame([(None, "same")] * 40 + [(k, None) for k in range(40)], "doc_id long, text string")
    got = sharding.shard_rows(docs, 3).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    load = got.groupby("shard")["size"].sum()
    assert got["size"].tolist().count(5) == 40 and load.sum() == 240


def test_media_parser_of_careless_html():
    a = "a" * 64
    get = lambda html: [(i["kind"], i["text"] if i["kind"] == "text" else i["caption"]) for i in media.parse(html)]
    assert get("<head><title>T</title><body><p>body text</p>") == [("text", "body text")]
    assert get("<p>one<template><p>two") == [("text", "one"), ("text", "two")]
    assert get("<p>one<template><p>two</template>three") == [("text", "one"), ("text", "three")]
    figure = f"<figure><img src='digest:{a}' alt='x'><figcaption><p>first</p><p>second</p></figcaption></figure>"
    assert get(figure) == [("media", "first second")]
    assert get(f"<figure><figcaption>before</figcaption><img src='digest:{a}'></figure><p>after") == [("media", "before"), ("text", "after")]
    assert get("<figure><figcaption>alone</figcaption></figure><p>after") == [("text", "alone"), ("text", "after")]
    assert get(f"<noscript><img src='digest:{a}'></noscript><p>text") == [("text", "text")]
    assert get(f"<figure><img src='digest:{a}'><figcaption>never closed") == [("media", "never closed")]


def test_page_items(spark):
    import html as entities

    hidden = r"(?s)<!--.*?-->|<(script|style|title)\b.*?</\1>"
    got = queries.page_items(spark, SMALL).toPandas()
    for page_id, source in [(r.page_id, r.html) for r in table(spark, SMALL, "pages").collect()]:
        own = got[got["page_id"] == page_id].sort_values("position")
        assert own["position"].tolist() == list(range(len(own)))
        # the same words in the same order as without any markup
        want = entities.unescape(re.sub(r"(?s)<[^>]*>", " ", re.sub(hidden, " ", source or "")))
        assert "".join(" ".join(own["text"]).split()) == "".join(want.split())


def test_media_round_trip(spark):
    rng = np.random.default_rng(4)
    for n in (0, 1, 191, 192, 193, 5000):
        body = media.payload(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(body) % 192 == 0 and media.decode(media.encode(body)).tobytes() == body
    a, b = "a" * 64, "b" * 64
    html = f"<p>first</p><figure><img src='digest:{a}' alt='x'><figcaption>cap A</figcaption></figure><p>mid &amp; dle</p><img src='sha256-{b}' alt='B'><img src='digest:{a}'><script>no</script><p>end"
    items = media.parse(html)
    assert [(i["kind"], i["text"] if i["kind"] == "text" else (i["digest"], i["caption"])) for i in items] == [("text", "first"), ("media", (a, "cap A")), ("text", "mid & dle"), ("media", (b, "B")), ("media", (a, None)), ("text", "end")]
    pages = media.interleaved(spark.createDataFrame([(1, html)], "page_id long, html string"), carry=("page_id",))
    store = spark.createDataFrame([(a, 5)], "digest string, payload_bytes long")
    got = sorted((r.position, r.caption, r.payload_bytes) for r in media.resolve(media.references(pages), store).select("position", "caption", "payload_bytes").collect() if True)
    assert got[0] == (1, "cap A", 5) and got[1] == (3, "B", None) and got[2] == (4, None, 5)


def test_media_query(spark, small):
    import hashlib

    got = queries.op2_media_columns(spark, SMALL).toPandas().set_index("doc_id")
    for k, t in zip(small["doc_id"], small["text"]):
        raw = t.encode()
        full = raw + b" " * (-len(raw) % 192 or 0 if raw else 192)
        r = got.loc[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


def test_passages(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(3, 9)))
    make = lambda n: [word() for _ in range(n)]
    shared = make(70)
    fuzzy = [w if i % 17 else word() for i, w in enumerate(shared)]
    texts = {1: make(300), 2: make(100) + shared + make(100), 3: make(50) + shared + make(30), 4: make(500) + fuzzy + make(10), 5: make(200)}
    docs = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.source_id): r for r in chaining.passages(docs).collect()}
    assert {d for d, _ in got} == {3, 4}
    r = got[3, 2]
    assert (r.start_word, r.end_word, r.source_start, r.source_end, r.identity) == (50, 120, 100, 170, 1.0)
    r = got[4, 2]
    assert r.start_word <= 505 and r.end_word >= 560 and 0.8 <= r.identity < 1


def test_passages_of_every_holder(spark):
    rng = np.random.default_rng(7)
    words = iter("".join(x) for x in rng.choice(list("abcdefghijklmnop"), (40_000, 9)))
    make = lambda n: [next(words) for _ in range(n)]
    whole, line, late, split = make(60), make(20), make(30), make(60)
    texts = {1: whole[:30] + make(30), 2: whole[30:] + make(30), 3: make(9) + whole + make(9), 4: make(20) + whole + make(5)}
    # a line of 40 documents before and after which two of them agree, with other holders between them
    texts |= {k: make(30) + line + make(30) for k in range(10, 50)}
    both = make(12) + line + make(12)
    texts[25], texts[44] = make(50) + both + make(40), make(15) + both + make(50)
    # 60: the first holder of late[:20] has it again, in a passage that 59 holds elsewhere
    texts |= {59: make(40) + late[20:] + late[:20] + make(10) + late, 60: make(5) + late[:20] + make(80) + late[20:] + late[:20] + make(3) + late}
    texts |= {k: split[:30] + make(40) if k % 2 else make(40) + split[30:] for k in range(70, 110)}
    texts |= {90: make(10) + split + make(10), 105: make(33) + split + make(3)}
    rows = [(k, " ".join(v)) for k, v in texts.items()]
    for parts in (1, 7):
        got = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        found = {(r.doc_id, r.source_id): (r.start_word, r.end_word, r.source_start, r.source_end) for r in got}
        assert found[4, 3] == (20, 80, 9, 69) and found[44, 25] == (15, 59, 50, 94) and found[105, 90] == (33, 93, 10, 70)
        assert any(r.doc_id == 60 and r.start_word <= 105 and r.end_word >= 135 for r in got)
        assert {d for d, _ in found} == {4, 44, 60, 105}


def test_equal_passages_against_brute_force(spark, small):
    """Every equal run of LONG_WORDS words with an earlier document is covered; every passage reported is one."""
    texts = {k: re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.lower()) for k, t in zip(small["doc_id"], small["text"])}
    n, seen, again = chaining.LONG_WORDS, set(), {}
    for k in sorted(texts):
        own = [tuple(texts[k][i : i + n]) for i in range(len(texts[k]) - n + 1)]
        again[k] = [i for i, x in enumerate(own) if x in seen]
        seen.update(own)
    results = []
    for parts in (1, 7, 40):
        found = chaining.passages(table(spark, SMALL, "documents").repartition(parts)).toPandas()
        results.append(sorted(map(tuple, found.to_numpy().tolist())))
    assert results[0] == results[1] == results[2] and results[0]
    covered = {k: np.zeros(len(w) + 1, bool) for k, w in texts.items()}
    for d, s, a0, a1, b0, b1, equal, identity in results[0]:
        a, b = texts[d][int(a0) : int(a1)], texts[s][int(b0) : int(b1)]
        assert s < d and len(a) == a1 - a0 >= chaining.MIN_WORDS and len(b) == b1 - b0
        assert identity == equal / max(len(a), len(b)) >= chaining.MIN_IDENTITY and lcs(a, b) >= equal
        covered[d][int(a0) : int(a1)] = True
    starts = [(k, i) for k, x in again.items() for i in x]
    # an equal run of LONG_WORDS holds a sampled run of MIN_WORDS, which is part of a passage
    assert starts and all(covered[k][i : i + n].sum() >= chaining.MIN_WORDS for k, i in starts)


def lcs(a: list[str], b: list[str]) -> int:
    names = {w: i for i, w in enumerate({*a, *b})}
    x, y = (np.array([names[w] for w in t]) for t in (a, b))
    last = np.zeros(len(y) + 1, int)
    for w in x:
        last[1:] = np.maximum.accumulate(np.maximum(last[1:], last[:-1] + (y == w)))
    return int(last[-1])


@pytest.mark.parametrize(("words", "identity", "least"), [(60, 0.95, 0.95), (100, 0.9, 0.95), (100, 0.85, 0.9)])
def test_recall_of_fuzzy_passages(spark, words, identity, least):
    """Share of planted passages with random substitutions that are found, as the README states it."""
    rng = np.random.default_rng(int(words * identity))
    make = lambda n: ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (n, 8))]
    rows, pairs = [], 150
    for k in range(pairs):
        first = make(words)
        second = list(first)
        for i in rng.choice(words, round(words * (1 - identity)), replace=False):
            second[i] = make(1)[0]
        rows += [(2 * k, " ".join(make(30) + first + make(30))), (2 * k + 1, " ".join(make(50) + second + make(9)))]
    got = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "source_id").distinct().collect()
    assert all(r.source_id == r.doc_id - 1 for r in got)
    print(f"recall at {words} words, identity {identity}: {len(got) / pairs:.3f}")
    assert len(got) / pairs >= least


@pytest.mark.parametrize(("words", "identity", "size", "least"), [(60, 0.95, 2, 0.9), (60, 0.95, 10, 0.95), (60, 0.95, 40, 0.9), (100, 0.95, 40, 0.95)])
def test_recall_in_families(spark, words, identity, size, least):
    """Copies of a base that no document holds: share of later documents with 80 % of the passage reported."""
    rng = np.random.default_rng(words + size)
    make = lambda n: ["".join(x) for x in rng.choice(list("abcdefghijklmnop"), (n, 8))]
    texts, spans = [], []
    for _ in range(120 // size):
        base = make(words)
        for k in range(size):
            copy = [w if rng.random() < identity else make(1)[0] for w in base]
            before = make(int(rng.integers(40, 120)))
            spans.append((len(before), k > 0))
            texts.append(" ".join(before + copy + make(60)))
    got = chaining.passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    covered = np.zeros((len(texts), words), bool)
    for r in got:
        at = spans[r.doc_id][0]
        assert r.start_word >= at - 5 and r.end_word <= at + words + 5
        covered[r.doc_id, max(0, r.start_word - at) : max(0, r.end_word - at)] = True
    later = np.array([k for _, k in spans])
    share = (covered[later].mean(1) >= 0.8).mean()
    print(f"families of {size}, {words} words at {identity}: {share:.3f}")
    assert share >= least


def test_an_extension_crosses_unequal_words():
    a = list(range(100))
    assert chaining.extend(a[:50], a[:50]) == (50, 50, 50)
    assert chaining.extend(a[:50], [*a[:10], -1, *a[11:50]]) == (50, 50, 49)
    assert chaining.extend(a[:50], [*a[:10], *a[12:50]]) == (50, 48, 48)
    assert chaining.extend([*a[:20], -5, *a[20:40]], [*a[:20], *a[20:30], -6, *a[31:40]]) == (41, 40, 39)
    assert chaining.extend(a[:30], [-k - 1 for k in range(30)]) == (0, 0, 0) and chaining.extend([], a) == (0, 0, 0)
    assert chaining.extend(a[:20] + [500 + k for k in range(40)], a[:60]) == (20, 20, 20)  # nothing after the last equal word
    for k in range(9):  # up to seven unequal words are crossed, whichever side has them
        far, none = (k + 30, k + 30, 30), (0, 0, 0)
        assert chaining.extend([-1] * k + a[:30], [-2] * k + a[:30]) == (far if k < 8 else none)
        assert chaining.extend([-1] * k + a[:30], a[:30]) == ((k + 30, 30, 30) if k < 8 else none)


def test_chains_against_all_orders():
    from itertools import combinations

    rng = np.random.default_rng(6)
    for _ in range(40):
        seg = sorted({(int(a), int(b), int(n)) for a, b, n in zip(rng.integers(0, 60, 6), rng.integers(0, 60, 6), rng.integers(0, 6, 6))})
        best = 0.0
        for k in range(1, len(seg) + 1):
            for c in combinations(sorted(seg), k):
                ok = all(x[0] + x[2] < y[0] and x[1] + x[2] < y[1] for x, y in zip(c, c[1:]))
                if ok:
                    best = max(best, sum(s[2] + chaining.SEED_WORDS for s in c) - chaining.GAP_COST * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(c, c[1:])))
        c = [seg[i] for i in chaining.chain(seg)[0]]
        score = sum(s[2] + chaining.SEED_WORDS for s in c) - chaining.GAP_COST * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(c, c[1:]))
        assert abs(score - best) < 1e-9


def test_reach_trees_give_the_greatest_of_a_window():
    rng = np.random.default_rng(3)
    tree, put = chaining.Reach(), {}
    for item in range(400):
        at, value = int(rng.integers(0, 700)), float(rng.integers(0, 20))
        tree.put(at, (value, item))
        put[item] = (at, value)
        ask = int(rng.integers(0, 760))
        near = [(v, j) for j, (x, v) in put.items() if ask - chaining.REACH <= x < ask]
        assert tree.before(ask) == max(near, default=(float("-inf"), -1))


def test_chains_within_reach_against_all_orders():
    from itertools import combinations

    # a longer passage before must not hide the nearer segment
    assert sorted(chaining.chain([(0, 0, 294), (370, 370, 23), (400, 401, 24)])) == [[0], [1, 2]]
    rng = np.random.default_rng(8)
    cost = lambda c: sum(s[2] + chaining.SEED_WORDS for s in c) - chaining.GAP_COST * sum(y[0] - x[0] - x[2] + y[1] - x[1] - x[2] for x, y in zip(c, c[1:]))
    reach = chaining.MAX_GAP + chaining.SEED_WORDS
    fits = lambda c: all(0 < y[k] - x[k] - x[2] <= reach for x, y in zip(c, c[1:]) for k in (0, 1))
    for _ in range(200):
        a, n = rng.integers(0, 600, 9), rng.integers(0, 90, 9)
        seg = sorted({(int(x), int(max(0, x + y)), int(z)) for x, y, z in zip(a, rng.integers(-9, 9, 9), n)})
        best = max(cost(c) for k in range(1, len(seg) + 1) for c in combinations(seg, k) if fits(c))
        chains = [[seg[i] for i in c] for c in chaining.chain(seg)]
        assert abs(cost(chains[0]) - best) < 1e-9 and all(map(fits, chains)) and sorted(sum(chains, [])) == seg


def test_lexicon_and_features(spark):
    rows = [(f"you are such an idi0t loser {i} word", 1) for i in range(30)] + [(f"a calm text about number {i} word", 0) for i in range(60)]
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    import pyarrow as pa

    x = dict(zip(toxicity.FEATURES, toxicity.densities(pa.array(["You LOSER!!! w*rd sooo", ""], pa.large_string()), lex).T))
    assert x["hits"].tolist() == [2, 0] and x["near_you"][0] >= 1 and x["exclamation"][0] > 0 and x["symbol_words"][0] > 0 and x["stretched"][0] > 0 and x["log_words"][1] == 0


def test_pipeline_against_brute_force(spark, small):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = table(spark, SMALL, "documents")
    texts = dict(zip(small["doc_id"].tolist(), small["text"]))
    # 1: the same model, its best path by plain dynamic programming
    model = langid.fit(docs.where(~held_out(docs.doc_id, 3, 1)))
    import pyarrow as pa
    import pyarrow.compute as pc

    from tapeloom.llm.common import utf8

    def share(t):
        e, letters, _ = langid.word_scores(model, *utf8(pc.utf8_lower(pa.array([t], pa.large_string()))))
        if not len(e):
            return 0.0
        back, score = [], e[0].copy()
        for x in e[1:]:
            jump = score.max() - langid.SWITCH_PENALTY
            back.append(np.where(score >= jump, np.arange(len(score)), score.argmax()))
            score = np.maximum(score, jump) + x
        path = [int(score.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        return np.bincount(path[::-1], letters).max() / max(letters.sum(), 1)

    left = {k: t for k, t in texts.items() if re.search(r"[^\W\d_]", t) and share(t) >= corpus_pipeline.MAIN_LANGUAGE}
    group, _ = similar_groups(left)
    left = {k: t for k, t in left.items() if group[k] == k}
    left = {k: b.decode() for k, b in kept_bytes(left, whole=True).items()}
    items = [shingle_set(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    left = {k: t for k, t in left.items() if not any(s and len(s & shingle_set(t)) >= 0.8 * len(s) for s in items)}
    tok = Tokenizer.from_file(BPE)
    want = {k: len(tok.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}
    got = corpus_pipeline.run(spark, SMALL).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SMALL)
        assert stage.columns == docs.columns, name
