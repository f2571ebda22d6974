"""Byte-level tokenising of concatenated UTF-8 texts: boundaries by table lookup, XXH64 of many slices at once, exact grouping."""

from __future__ import annotations

import numpy as np
import xxhash

#: Slices longer than this are hashed and compared one by one.
LONG = 512

_U = np.uint64
# Fixed values of XXH64.
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of marked bytes; a run ends where its text ends. offs: ends of texts, from 0."""
    if not len(inside):
        none = np.empty(0, np.int64)
        return none, none, none
    edge = np.zeros(len(inside) + 1, bool)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cut = offs[(offs > 0) & (offs < len(inside))]
    both = np.unique(cut[inside[cut - 1] & inside[cut]])  # a run of one text goes on with one of the next: an end and a start
    at = np.flatnonzero(edge)
    start, end = at[::2], at[1::2]
    if len(both):
        start, end = np.sort(np.concatenate([start, both])), np.sort(np.concatenate([end, both]))
    return start, end, np.searchsorted(offs, start, "right") - 1


def blocks(data: np.ndarray, inside: np.ndarray, limit: int):
    """(from, to) of consecutive parts of one text of about `limit` bytes that cut no run of marked bytes."""
    at = 0
    while at < len(data):
        to = min(len(data), at + limit)
        while to < len(data) and inside[to] and inside[to - 1]:
            rest = inside[to : to + limit]
            to += int(np.argmin(rest)) if not rest.all() else len(rest)
        yield at, to
        at = to


class Bytes:
    """Unaligned 8-byte words of an array of bytes."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.words = np.ndarray(len(data) + 1, "<u8", self.data, strides=(1,))

    def word(self, at: np.ndarray) -> np.ndarray:
        return self.words[at]

    def raw(self, start: int, end: int) -> bytes:
        return self.data[start:end].tobytes()


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _U(r)) | (x >> _U(64 - r))


def _round(acc, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: Bytes, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """XXH64 of each slice, as the reference function gives it."""
    with np.errstate(over="ignore"):
        n, at, s = end - start, start.copy(), _U(seed)
        h = np.full(len(start), s + _P5)
        wide = np.flatnonzero((n >= 32) & (n <= LONG))
        if len(wide):
            p, stop, live = at[wide], end[wide] - 32, np.arange(len(wide))
            v = [np.full(len(wide), x) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while len(live):
                for k in range(4):
                    v[k][live] = _round(v[k][live], data.word(p[live] + 8 * k))
                p[live] += 32
                live = live[p[live] <= stop[live]]
            acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for x in v:
                acc = (acc ^ _round(_U(0), x)) * _P1 + _P4
            h[wide], at[wide] = acc, p
        h += n.astype(np.uint64)
        live = np.flatnonzero((end - at >= 8) & (n <= LONG))
        while len(live):
            h[live] = _rotl(h[live] ^ _round(_U(0), data.word(at[live])), 27) * _P1 + _P4
            at[live] += 8
            live = live[end[live] - at[live] >= 8]
        live = np.flatnonzero((end - at >= 4) & (n <= LONG))
        h[live] = _rotl(h[live] ^ (data.word(at[live]) & _U(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
        at[live] += 4
        for _ in range(3):
            live = np.flatnonzero((end > at) & (n <= LONG))
            h[live] = _rotl(h[live] ^ data.data[at[live]].astype(np.uint64) * _P5, 11) * _P1
            at[live] += 1
        h ^= h >> _U(33)
        h *= _P2
        h ^= h >> _U(29)
        h *= _P3
        h ^= h >> _U(32)
    for i in np.flatnonzero(n > LONG).tolist():
        h[i] = xxhash.xxh64_intdigest(data.raw(start[i], end[i]), seed)
    return h


def _differ(data: Bytes, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether the n bytes from a on differ from those from b on."""
    bad = np.zeros(len(a), bool)
    for i in np.flatnonzero((n > LONG) & (a != b)).tolist():
        bad[i] = data.raw(a[i], a[i] + n[i]) != data.raw(b[i], b[i] + n[i])
    live, off = np.flatnonzero((n > 0) & (n <= LONG) & (a != b)), 0
    while len(live):
        rest = np.minimum(n[live] - off, 8)
        shift = ((8 - rest) * 8).astype(np.uint64)
        bad[live] |= ((data.word(a[live] + off) ^ data.word(b[live] + off)) << shift) != 0
        off += 8
        live = live[n[live] > off]
    return bad


def group(data: Bytes, start: np.ndarray, end: np.ndarray, hashed=xxh64) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): by hash, then verified byte by byte, so equal groups are equal bytes."""
    _, first, of = np.unique(hashed(data, start, end), return_index=True, return_inverse=True)
    n, lead = end - start, first[of]
    wrong = n != n[lead]
    same = np.flatnonzero(~wrong)
    wrong[same] = _differ(data, start[same], start[lead[same]], n[same])
    if wrong.any():
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(wrong).tolist():
            key = data.raw(start[i], end[i])
            if key not in more:
                more[key] = len(first)
                first = np.append(first, i)
            of[i] = more[key]
    return of, first
