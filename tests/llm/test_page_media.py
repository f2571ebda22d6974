"""Pages with several media, some of them lost: every item, caption and resolved field against a plain version."""

from __future__ import annotations

import hashlib

from tapeloom.llm import media, queries
from tapeloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_illustrated_pages_field_by_field(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    want = {}
    for r in table(spark, SF, "pages").collect():
        k, items = r.page_id, []

        def picture(text, caption):
            body = media.payload(text.encode())
            stored = media.encode(body)
            digest = hashlib.sha256(body).hexdigest()
            return ("media", f"digest:{digest}", caption, digest, len(body), len(stored), hashlib.sha256(stored).hexdigest(), media.features(media.decode(stored)))

        def shown(text):
            return ("text", text, *[None] * 6)

        items += [shown(f"Page {k}"), picture(r.url, f"Address of {k}"), shown("Lost:")]
        lost = hashlib.sha256(f"lost {k}".encode()).hexdigest()
        items.append(("media", f"digest:{lost}", None, lost, *[None] * 4))
        if k in texts:
            items.append(picture(texts[k], f"Document {k}"))
        items += [shown(x["text"]) for x in media.parse(r.html)]
        want |= {(k, i): x for i, x in enumerate(items)}
    got = queries.page_media(spark, SF).collect()
    first = min(r.position for r in got)
    found = {(r.page_id, r.position - first): (r.kind, r.text, r.caption, r.digest, r.payload_bytes, r.media_bytes, r.media_sha256, r.feature) for r in got}
    assert len(found) == len(got) and found == want
    assert sum(x[0] == "media" and x[4] is None for x in found.values()) == len({k for k, _ in found})


def test_captions_on_either_side_and_clashing_columns(spark):
    """Columns named like the operator's own; two media in one figure; one payload shown many times."""
    a, b = (hashlib.sha256(media.payload(x)).hexdigest() for x in (b"a", b"b"))
    html = f"<p>one</p><figure><figcaption>first</figcaption><img src='digest:{a}'><img src='digest:{b}'></figure>two<figure><img src='digest:{a}'><figcaption>late</figcaption></figure><img src='digest:{a}'>"
    pages = spark.createDataFrame([(1, html, "t", "r", "i"), (2, None, "t", None, "i")], "page_id long, html string, text string, row string, items string")
    rows = media.interleaved(pages, carry=("page_id", "row", "items", "text"))
    got = media.resolve(media.references(rows), media.read_back(media.store(spark.createDataFrame([("a",), ("b",)], "text string")))).collect()
    assert {(r.row.page_id, r.row.row, r.row["items"], r.row.text) for r in got} == {(1, "r", "i", "t")}
    assert [(r.digest, r.caption) for r in sorted(got, key=lambda r: r.position)] == [(a, "first"), (b, None), (a, "late"), (a, None)]  # a caption is its next picture's
    assert all(r.payload_bytes == media.WIDTH for r in got)
