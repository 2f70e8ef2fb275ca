"""Words of many texts at once, as offsets into one buffer of bytes, and hashes of byte ranges."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

SPACES = bytes(range(9, 14)) + b" "
#: A-Z to a-z, all other bytes as they are.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


class Words(NamedTuple):
    """Word i of all texts is buffer[starts[i]:ends[i]]; text t has the words first[t] to first[t+1].

    Within a text the words stand one space apart, so that a run of them is one byte range.
    """

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def split_words(texts: list[str | bytes | None], table: bytes | None = None) -> Words:
    """Texts may be UTF-8 bytes. table translates bytes beforehand; null texts have no words."""
    raw = [t if isinstance(t, bytes) else (t or "").encode() for t in texts]
    joined = b"\n".join(raw) + b"\n"
    if table is not None:
        joined = joined.translate(table)
    data = np.frombuffer(joined, np.uint8)
    space = _IS_SPACE[data]
    before = np.empty_like(space)
    before[0] = True
    before[1:] = space[:-1]
    text_starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=text_starts[1:])
    first = np.searchsorted(np.flatnonzero(space & ~before), text_starts)
    keep = ~(space & before)
    buffer, space = data[keep], space[keep]
    buffer[space] = 32
    ends = np.flatnonzero(space)
    starts = np.empty_like(ends)
    if len(ends):
        starts[0] = 0
        starts[1:] = ends[:-1] + 1
    return Words(buffer, starts, ends, first)


# The five primes of XXH64.
_P1 = np.uint64(11400714785074694791)
_P2 = np.uint64(14029467366897019727)
_P3 = np.uint64(1609587929392839161)
_P4 = np.uint64(9650029242287828579)
_P5 = np.uint64(2870177450012600261)


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64_ranges(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range, unsigned. Ranges under 32 bytes are hashed together, others one by one."""
    sizes = ends - starts
    data = np.concatenate([buffer, np.zeros(8, np.uint8)])
    at8 = np.ndarray(len(buffer) + 1, "<u8", data, strides=(1,))
    at4 = np.ndarray(len(buffer) + 5, "<u4", data, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64(seed) + _P5
        block = 1 << 15  # what a pass touches stays in the CPU's cache
        for at in range(0, len(starts), block):
            place, size = starts[at : at + block].copy(), sizes[at : at + block]
            h = base + size.astype(np.uint64)
            for k in range(1, 4):
                has = np.flatnonzero((size >= 8 * k) & (size < 32))
                if not len(has):
                    break
                p = place[has]
                h[has] = _rotated(h[has] ^ (_rotated(at8[p] * _P2, 31) * _P1), 27) * _P1 + _P4
                place[has] = p + 8
            place[size >= 32] = 0
            has = np.flatnonzero(size & 4)
            p = place[has]
            h[has] = _rotated(h[has] ^ (at4[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
            place[has] = np.minimum(p + 4, len(buffer))
            for k in range(1, 4):
                has = np.flatnonzero((size & 3) >= k)
                p = place[has]
                h[has] = _rotated(h[has] ^ (data[p].astype(np.uint64) * _P5), 11) * _P1
                place[has] = np.minimum(p + 1, len(buffer))
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[at : at + block] = h ^ (h >> np.uint64(32))
    long = np.flatnonzero(sizes >= 32)
    if len(long):
        view = memoryview(np.ascontiguousarray(buffer))
        hashed = [xxhash.xxh64_intdigest(view[s:e], seed) for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        out[long] = np.array(hashed, np.uint64)
    return out
