"""Spelling variants against a plain version, on ordinary and awkward rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from tapeloom.llm import queries, variants
from tapeloom.llm.common import table

SMALL = "/root/testdata/sf0.001"


def plain_words(rows) -> Counter:
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]+", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return Counter({w: n for w, n in out.items() if len(w) >= 6 and n >= 5})


def plain_variants(n: Counter) -> set:
    """(word, form, root, n, n_near, form_n), near words by what deletions of one letter have in common."""
    by, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by[w[:i] + "\0" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in variants.variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_variants(plain_words(rows))
    return got


def test_a_table(spark):
    assert len(check(table(spark, SMALL, "documents"))) > 500


@pytest.mark.parametrize("held", [200_000, 10])
def test_awkward_rows(spark, monkeypatch, held):
    """Nulls, repeats, a text of several blocks, accents, chains of forms, ties of count, edits of repeated letters."""
    monkeypatch.setattr(variants, "HELD_WORDS", held)
    r = random.Random(3)
    base = ["".join(r.choice("aabcdeé×ÿ") for _ in range(r.randint(5, 9))) for _ in range(300)]
    near = base + ["letters", "leters", "lettters", "letterz", "lettres", "äpfelmus", "öpfelmus", "apfelmus", "x" * 700, "x" * 701, "y" + "x" * 700]
    for w in base:
        i = r.randrange(len(w))
        near += [w[:i] + w[i + 1 :], w[:i] + r.choice("abé") + w[i + 1 :], w[:i] + w[i] + w[i:]]
    text = [" ".join(w.upper() if k % 7 == 0 and w.isascii() else w for k, w in enumerate(r.choices(near, k=2500))) for _ in range(12)]
    chain = " ".join(["lengthy"] * 5 + ["lengthx"] * 25 + ["lengths"] * 625 + ["elengths"] * 3125)
    rows = [(None, None), (None, ""), (None, "1 2 ..."), (7, text[0]), (7, text[0]), (7, text[1]), (None, text[2]), (None, text[3]), (99, chain)]
    rows += [(100 + i, t) for i, t in enumerate(text)] + [(1000, (" ".join(text) + " ") * 6)]
    rows = [(d, t, "w", 1, "f", 0) for d, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long, form string, key int").repartition(3)
    got = {x[0]: x for x in check(docs)}
    assert got["lengthy"][1] == "lengths" and got["lengthy"][2] == got["lengths"][2] == "elengths"
    assert variants.variants(docs.limit(0)).count() == 0


def test_registered_query(spark):
    assert queries.op13_spelling_variants(spark, SMALL).columns == ["word", "form", "root", "n", "n_near", "form_n"]
