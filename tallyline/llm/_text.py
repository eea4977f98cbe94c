"""Vectorised scans over Arrow string batches: words, lines and their 64-bit hashes.

A batch is cut into slices of a bounded number of bytes (one text at least), so
memory follows the longest text, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_TAIL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes of text, or a single row."""
    _, off = raw(batch.column(text))
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and what they keep adds up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("")
    arr = arr.cast(pa.large_string())
    if not len(arr):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def owners(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Row of each byte position."""
    return np.searchsorted(off, at, "right") - 1


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of `inside` that stay within a row."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[off] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside [\\x20\\x09-\\x0D]."""
    s, e = spans(~SPACE[data], off)
    return s, e, owners(off, s)


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every \\n-split line; an empty text is one empty line."""
    nl = np.flatnonzero(data == 10)
    who = np.concatenate([np.arange(len(off) - 1), owners(off, nl)])
    s = np.concatenate([off[:-1], nl + 1])
    o = np.lexsort((s, who))
    s, who = s[o], who[o]
    last = np.ones(len(s), bool)
    last[:-1] = who[1:] != who[:-1]
    e = np.empty_like(s)
    e[:-1] = s[1:] - 1
    e[last] = off[who[last] + 1]
    return s, e, who


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    size = e - s
    h = mix(size.astype(np.uint64) * _C1 + np.uint64(seed))
    todo, k = np.flatnonzero(size > 0), 0
    while len(todo):
        left = size[todo] - k
        w = view[s[todo] + k] & _TAIL[np.minimum(left, 8)]
        h[todo] = mix((h[todo] ^ w) * _C1 + np.uint64(k + 1))
        todo, k = todo[left > 8], k + 8
    return h


def windows(h: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k consecutive words of a row, and the index of its first word."""
    if len(h) < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(who[: len(h) - k + 1] == who[k - 1 :])
    out = np.full(len(at), np.uint64(k), np.uint64)
    for j in range(k):
        out = mix((out ^ h[at + j]) * _C1 + np.uint64(j + 1))
    return out, at


def per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many positions of each row are set."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def seen_before(key: np.ndarray) -> np.ndarray:
    """For each element, whether an equal one stands earlier."""
    o = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    if len(key):
        out[o[1:]] = key[o[1:]] == key[o[:-1]]
    return out


def repeated(key: np.ndarray) -> np.ndarray:
    """For each element, whether an equal one stands anywhere else."""
    o = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[o[1:]] == key[o[:-1]]
    out = np.zeros(len(key), bool)
    out[o] = same[:-1] | same[1:] if len(key) else False
    return out
