"""Byte slices, source divergence and SimHash against plain versions, on ordinary and awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tapeloom.llm import divergence, queries, simhash, slices
from tapeloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, fp string, term string, shard int, n long, docs long, root string"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcDEé_") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    long = words(300_000, 1)
    texts = [None, "", " \t\n", "one", "One", "two words", "two  words ", "a b c", "A\nb\tc", long, long + " end", words(300, 2), words(300, 2), "x" * 3_000_000, "é" * 700, "word " * 400, "123 !!!"]
    rows = [(i, t, [None, "", "en", "de"][i % 4], ["a", None, "b"][i % 3], "f", "t", 1, 2, 3, "r") for i, t in enumerate(texts)]
    rows += [rows[11], (None, texts[11], "en", "b", *rows[0][4:]), (None, "only here", "en", "b", *rows[0][4:]), (11, "another text of eleven", "de", "a", *rows[0][4:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_hashes_and_groups_of_slices():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 4, 20_000).astype(np.uint8)
    start, n = rng.integers(0, 19_000, 4000), np.r_[rng.integers(0, 90, 3980), rng.integers(400, 900, 20)]
    raw = [data[s : s + k].tobytes() for s, k in zip(start, n)]
    b = slices.Bytes(data)
    for seed in (0, 42):
        assert [xxhash.xxh64_intdigest(x, seed) for x in raw] == slices.xxh64(b, start, start + n, seed).tolist()
    for hashed in (slices.xxh64, lambda *a: slices.xxh64(*a) & np.uint64(7)):  # a hash that collides: bytes decide
        of, first = slices.group(b, start, start + n, hashed)
        assert len(first) == len(set(raw)) and all(raw[first[g]] == x for g, x in zip(of, raw))


def terms(text: str) -> list[str]:
    return [re.sub("[A-Z]+", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]


def plain_audit(rows, least: int, top: int) -> set:
    """(lang, source, part, item, value, rank) by the definition."""
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in rows:
        lang, source, found = lang or "", source or "", Counter(terms(text or ""))
        groups[lang].add(source)
        docs.update((lang, t) for t in found)
        for t, k in found.items():
            n[lang, source, t] += k
    out = set()
    for lang, sources in groups.items():
        kept = [t for (k, t), d in docs.items() if k == lang and d >= least]

        def shares(count):
            total = sum(count)
            return {t: 1 + 1_000_000_000 * (c + 5) // (total + 5 * len(kept)) for t, c in zip(kept, count)}

        p = {s: shares([n[lang, s, t] for t in kept]) for s in sources}
        q = shares([sum(n[lang, s, t] for s in sources) for t in kept])
        for s in sources:
            pairs = {o: sum(abs(p[s][t] - p[o][t]) for t in kept) for o in sources - {s}}
            own = {t: p[s][t] - q[t] for t in kept if n[lang, s, t] and p[s][t] > q[t]}
            for part, f, to in (("pair", pairs, len(pairs)), ("term", own, top)):
                ranked = sorted(f.items(), key=lambda x: (-x[1], x[0].encode()))[:to]
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)}
    return out


@pytest.mark.parametrize(("least", "blocked", "tokens"), [(1, 1 << 17, 1 << 21), (2, 50, 1000), (100, 1 << 17, 1 << 21)])
def test_divergence_against_definition(docs, monkeypatch, least, blocked, tokens):
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    monkeypatch.setattr(divergence, "BLOCK_SHARES", blocked)
    got = divergence.audit(docs, least=least).drop("q").collect()
    assert {tuple(r) for r in got} == plain_audit(rows, least, 50) and len(got) == len({tuple(r) for r in got})


def test_long_texts_are_counted_block_by_block():
    text = "x" * 5000 + " " + words(4000, 4)
    data = np.frombuffer(text.encode(), np.uint8)
    found = Counter()
    for a, b in slices.blocks(data, divergence.TERM[data], 1000):
        t, of, _ = divergence._terms(slices.lower_ascii(data[a:b]), np.array([0, b - a]))
        found.update(t[i] for i in of)
    assert found == Counter(terms(text))


def test_divergence_of_an_empty_table(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def plain_fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(fps: dict[int, set[int]], bits: int = 2) -> dict[int, int | None]:
    """Component name of each fingerprint; fps: the doc_ids of each."""
    names = sorted(fps)
    root = {f: f for f in names}
    for i, f in enumerate(names):
        for g in names[:i]:
            if bin(f ^ g).count("1") <= bits:
                old, new = root[f], root[g]
                root = {k: new if v == old else v for k, v in root.items()}
    least = defaultdict(list)
    for f in names:
        least[root[f]] += fps[f]
    return {f: min(least[root[f]], default=None) for f in names}


def check_simhash(docs):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    fps = defaultdict(set)
    for d, f in rows:
        fps[f] |= {d} - {None}
    name = plain_components(fps)
    got = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    want = [(d, f"{f:016x}", name[f]) for d, f in rows]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_simhash_of_awkward_rows(docs, monkeypatch):
    check_simhash(docs)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_simhash_of_a_table(spark):
    check_simhash(table(spark, SMALL, "documents"))


def test_fingerprints_of_long_texts():
    for text in (words(900, 7), "  " + words(3, 8) + "\n" * 900 + words(2, 9), "y" * 4000, "a b " + "z" * 4000 + " c\td", " " * 3000):
        data = np.frombuffer(text.encode(), np.uint8)
        for limit in (64, 257, 1 << 20):
            assert int(simhash._long_text(data, limit)[0]) == plain_fingerprint(text)


@pytest.mark.parametrize("block", [1 << 17, 300])
def test_vantage_point_trees_lose_no_link(spark, monkeypatch, block):
    """Random fingerprints, chains and a dense ball, through many shards, small blocks and small leaves."""
    rng = random.Random(11)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    for f in list(fps)[:300]:
        for _ in range(4):
            f ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(f)
    ball = rng.getrandbits(64)
    fps |= {ball ^ sum(1 << k for k in rng.sample(range(64), 3)) for _ in range(800)}
    for k, v in (("SHARD", 100), ("SAMPLE_PART", 2), ("LEAST_SAMPLED", 4), ("BLOCK", block), ("LEAF", 40), ("QUERIES", 100), ("HELD", 500)):
        monkeypatch.setattr(simhash, k, v)
    names = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in names]
    got = simhash.links(spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")).collect()
    want = plain_components({f: {i} for i, f in enumerate(names)})
    root = {f: f for f in names}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for r in got:
        a, b = (x & (1 << 64) - 1 for x in r)
        root[top(a)] = top(b)
    mine, theirs = defaultdict(set), defaultdict(set)
    for f in names:
        mine[top(f)].add(f)
        theirs[want[f]].add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_registered_queries(spark):
    got = queries.op12_simhash_near_dedup(spark, SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.count() == 200
    assert queries.op11_source_divergence(spark, SMALL).columns == ["lang", "source", "part", "item", "value", "rank"]
