"""Media columns: interleaved documents of text and media, with payloads in a content-addressed table.

HTML is parsed into an ordered array of items: a text, or a media reference with its digest and caption. References find
their payload by a join on the digest; position and caption stay with the reference. A payload is stored as an 8-bit grey
PNG image of WIDTH samples a row, losslessly; equal payloads are stored once.

Defined cases: null or empty HTML has no item; a reference whose digest is unknown keeps its place with null payload
columns; markup that never closes is read as far as it goes; a head need not be closed, nor a template (its text is
shown then); media in hidden elements are none; a caption of several paragraphs is one text, and one before its figure's
media belongs to them; references to one payload any number of times, also
by one document, each keep their place; an empty table gives no row; other columns may be carried, under `row`.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tapeloom.llm.common import map_arrow, text_slices

WIDTH = 192
PAD = 32
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_DIGEST = re.compile(r"(?:digest:|sha256[-:])([0-9a-f]{64})", re.ASCII)
_PNG = b"\x89PNG\r\n\x1a\n"


class _Items(HTMLParser):
    """Collects texts and media references in the order in which they stand."""

    MEDIA = {"img", "video", "audio", "source", "embed"}
    BLOCK = {
        "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "article", "section", "figure", "figcaption", "blockquote",
        "pre", "table", "ul", "ol", "nav", "header", "footer", "main", "aside", "body", "title", "hr", "dt", "dd",
    }

    def __init__(self, silent: set[str]):
        super().__init__(convert_charrefs=True)
        self.quiet = silent  # elements whose content is not shown
        self.items: list[dict] = []
        self.words: list[str] = []
        self.silent: list[str] = []  # the open ones of them
        self.figure: int | None = None  # place of an open figure's first item
        self.caption: list[str] | None = None  # texts of an open figcaption
        self.waiting: tuple[int, str] | None = None  # place and text of a caption before its figure's media

    def flush(self):
        text = " ".join("".join(self.words).split())
        self.words = []
        if text and self.caption is not None:
            self.caption.append(text)
        elif text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def end_caption(self):
        text, self.caption = " ".join(self.caption or []), None
        start = len(self.items) if self.figure is None else self.figure
        media = next((x for x in reversed(self.items[start:]) if x["kind"] == "media"), None)
        if text and media:
            media["caption"] = text
        elif text:
            self.waiting = (len(self.items), text)

    def end_figure(self):
        if self.caption is not None:
            self.end_caption()
        if self.waiting:  # no media came: the caption is a text
            self.items.insert(self.waiting[0], {"kind": "text", "text": self.waiting[1], "digest": None, "caption": None})
        self.figure = self.waiting = None

    def handle_starttag(self, tag, attrs):
        if tag in self.quiet:
            self.flush()
            self.silent.append(tag)
        if self.silent:
            return
        if tag in self.BLOCK or tag in self.MEDIA:
            self.flush()
        if tag == "figure":
            self.end_figure()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.caption = []
        elif tag in self.MEDIA:
            a = dict(attrs)
            found = _DIGEST.search(f"{a.get('src') or ''} {a.get('data-digest') or ''} {a.get('integrity') or ''}")
            if found or a.get("src"):
                caption = self.waiting[1] if self.waiting else a.get("alt")
                self.waiting = None
                self.items.append({"kind": "media", "text": a.get("src"), "digest": found and found[1], "caption": caption})

    def handle_endtag(self, tag):
        if tag in self.silent:
            while self.silent.pop() != tag:
                pass
            return
        if self.silent:
            return
        if tag in self.BLOCK:
            self.flush()
        if tag == "figcaption" and self.caption is not None:
            self.end_caption()
        elif tag == "figure":
            self.end_figure()

    def handle_data(self, data):
        if not self.silent:
            self.words.append(data)


def parse(html: str) -> list[dict]:
    """Ordered items of one page. An element that hides its content but is never closed hides nothing but script and style."""
    for silent in ({"script", "style", "title", "template", "noscript"}, {"script", "style"}):
        p = _Items(silent)
        p.feed(html)
        p.close()
        if not p.silent:
            break
    p.flush()
    p.end_figure()
    return [{"position": k} | x for k, x in enumerate(p.items)]


def interleaved(pages: DataFrame, *, html: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """row (the columns in carry) and items of every page."""
    row = F.struct(F.lit(0).alias("_"), *[pages[c] for c in carry]).alias("row")
    own = pages.select(pages[html].alias("text"), row)
    kind = pa.list_(pa.struct([("position", pa.int32()), *[(k, pa.string()) for k in ("kind", "text", "digest", "caption")]]))

    def run(batches):
        for part in text_slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("row").combine_chunks(), pa.array([parse(t) for t in part.column("text").to_pylist()], kind)], ["row", "items"])

    return map_arrow(own, run, f"row {own.schema['row'].dataType.simpleString()}, items array<{ITEM}>")


def _chunk(tag: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG whose samples are the payload's bytes; the payload is a positive multiple of width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()  # filter type 0 before each row
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


def decode(stored: bytes) -> np.ndarray:
    """Samples of a PNG as `encode` writes it: rows x width."""
    if stored[:8] != _PNG:
        raise ValueError("not a PNG")
    at, size, body = 8, None, b""
    while at < len(stored):
        n, tag = struct.unpack(">I4s", stored[at : at + 8])
        part = stored[at + 8 : at + 8 + n]
        if zlib.crc32(tag + part) != struct.unpack(">I", stored[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged PNG")
        if tag == b"IHDR":
            size = struct.unpack(">IIBBBBB", part)
        elif tag == b"IDAT":
            body += part
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey PNG")
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:]


def features(samples: np.ndarray) -> str:
    """Mean, deviation, entropy in bits, and a 64-bit difference hash of an 8 x 9 thumbnail."""
    flat = samples.ravel()
    n = np.bincount(flat, minlength=256)
    mean = float((n * np.arange(256)).sum() / flat.size)
    var = float((n * (np.arange(256) - mean) ** 2).sum() / flat.size)
    p = n[n > 0] / flat.size
    rows = np.array([x.mean(0) for x in np.array_split(samples, 8)]) if len(samples) >= 8 else np.repeat(samples, 8, 0)[:: len(samples)].astype(float)
    small = np.array([x.mean(1) for x in np.array_split(rows, 9, 1)]).T
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    return f"mean={mean:.6f};std={var**0.5:.6f};entropy={-(p * np.log2(p)).sum():.6f};dhash={int(''.join('01'[int(b)] for b in bits), 2):016x}"


def payload(text: bytes, width: int = WIDTH) -> bytes:
    return text + bytes([PAD]) * ((-len(text)) % width if text else width)


def store(texts: DataFrame, *, text: str = "text") -> DataFrame:
    """The media table: digest of each distinct text's payload, and its stored form."""

    def run(batches):
        for part in text_slices(batches):
            body = [payload(t.encode()) for t in part.column("text").to_pylist()]
            seen = {hashlib.sha256(b).hexdigest(): b for b in body}
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([encode(b) for b in seen.values()], pa.binary())], ["digest", "stored"])

    made = map_arrow(texts.select(texts[text].alias("text")), run, "digest string, stored binary")
    return made.groupBy("digest").agg(F.first("stored").alias("stored"))


def read_back(media: DataFrame) -> DataFrame:
    """digest, sizes, checksums and features of every stored payload, from its stored bytes."""

    def run(batches):
        names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            out = []
            for digest, stored in zip(batch.column("digest").to_pylist(), batch.column("stored").to_pylist()):
                samples = decode(stored)
                raw = samples.tobytes()
                out.append((digest, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), features(samples)))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names) if out else batch.slice(0, 0)

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_arrow(media.select("digest", "stored"), run, schema)


def references(pages: DataFrame) -> DataFrame:
    """One row for each media reference: the page's row, position, digest and caption."""
    item = F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("item")
    return pages.select("row", item).select("row", F.col("item.position").alias("position"), F.col("item.digest").alias("digest"), F.col("item.caption").alias("caption"))


def resolve(refs: DataFrame, media: DataFrame) -> DataFrame:
    """References with the columns of the media table (small ones: `read_back`'s).

    Both sides come from Python and are dealt by the join itself, so that adaptive execution can split a digest that holds
    most references.
    """
    return refs.join(media, "digest", "left")
