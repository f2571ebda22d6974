"""Cost-balanced packing of tokenised documents into fixed-length sequences.

A document of n ids is estimated to cost LINEAR * n + QUADRATIC * n * n (feed-forward and attention).
Each task packs its own documents in groups of about GROUP_TOKENS ids, so nothing is shuffled and memory
is bounded by a group. Within a group, documents are taken in descending order and put into the cheapest
sequence with room (of equally cheap ones, the fullest). A group has sequences for SLACK more ids than its own;
only a document that fits nowhere is cut, over the sequences with the most room, so padding stays under SLACK and
one sequence a group.

Defined cases: a null or empty text is the end id alone; equal texts are packed one by one; documents of equal
length keep their order; a text longer than a sequence is cut at whole sequences first; an empty table gives no
piece; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tapeloom.llm.common import map_arrow, text_slices

SEQUENCE = 2048
END_ID = 1
GROUP_TOKENS = 4_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Share of padding that keeps documents whole.
SLACK = 0.005
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The pre-tokeniser of byte-level BPE vocabularies of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """text -> ids of the byte-level BPE tokenizer file at `path`, as the tokenizers library gives them."""
    import regex
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
    encode = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not special:
        return encode
    split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def whole(text: str) -> list[int]:
        if not any(s in text for s in special):
            return encode(text)
        return [i for part in split.split(text) if part for i in ([special[part]] if part in special else encode(part))]

    return whole


def pack_group(lengths: np.ndarray, sequence: int = SEQUENCE, slack: float = SLACK) -> tuple[np.ndarray, int]:
    """Rows (document, start, length, sequence, offset) for documents of these lengths, and the sequences used."""
    pieces: list[tuple[int, int, int, int, int]] = []
    used, rest = 0, []
    for d, n in enumerate(lengths.tolist()):
        whole = n // sequence
        for k in range(whole):
            pieces.append((d, k * sequence, sequence, used, 0))
            used += 1
        if n % sequence:
            rest.append((n % sequence, d, whole * sequence))
    rest.sort(key=lambda x: (-x[0], x[1]))
    count = math.ceil(sum(x[0] for x in rest) * (1 + slack) / sequence)
    # sequences by room left, each heap with the cheapest on top; least has the cost on top of each
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(sequence + 1)]
    heaps[sequence] = [(0.0, s) for s in range(used, used + count)]
    least = np.full(sequence + 1, np.inf)
    least[sequence] = 0.0 if count else np.inf
    for n, d, at in rest:
        broken = False
        while n:
            room = n + int(least[n:].argmin())
            if broken or least[room] == np.inf:  # no sequence has room: cut over those with the most
                broken = True
                room = int(np.flatnonzero(least < np.inf)[-1])
            cost, s = heapq.heappop(heaps[room])
            least[room] = heaps[room][0][0] if heaps[room] else np.inf
            take = min(n, room)
            pieces.append((d, at, take, s, sequence - room))
            at, n, room = at + take, n - take, room - take
            if room:
                heapq.heappush(heaps[room], (cost + LINEAR * take + QUADRATIC * take * take, s))
                least[room] = heaps[room][0][0]
    return np.array(pieces, np.int64).reshape(-1, 5), used + count


def pack(docs: DataFrame, tokenizer_path: str, *, text: str = "text", key: str = "doc_id", sequence: int = SEQUENCE, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row for each piece: document, start and length in its ids, checksum of the ids, sequence and offset there."""

    def run(batches):
        encode = encoder(tokenizer_path)
        first, keys, ids, held = TaskContext.get().partitionId() << 36, [], [], 0

        def flush():
            nonlocal first, keys, ids, held
            lengths = np.array([len(x) for x in ids], np.int64)
            p, n = pack_group(lengths, sequence)
            sums = [zlib.crc32(ids[d][a : a + k]) for d, a, k, _, _ in p.tolist()]
            doc = pa.array(keys, pa.int64()).take(pa.array(p[:, 0]))
            cols = [doc, *map(pa.array, (p[:, 1], p[:, 2], np.array(sums, np.int64), lengths[p[:, 0]], p[:, 3] + first, p[:, 4]))]
            first, keys, ids, held = first + n, [], [], 0
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for part in text_slices(batches):
            for k, t in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                x = np.array([*encode(t), END_ID], "<u4")
                keys.append(k)
                ids.append(x)
                held += len(x)
                if held >= group_tokens:
                    yield from flush()
        if keys:
            yield from flush()

    return map_arrow(docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")), run, SCHEMA)
