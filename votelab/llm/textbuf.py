"""Vectorised views of an Arrow text column: word bounds, 64-bit word hashes and windows over them.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D (those bytes never occur inside a multi-byte
UTF-8 character). A word's hash is a polynomial in an odd base modulo 2^64 over a fixed random byte table,
so it depends on the word alone and not on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

GROUP_BYTES = 2 << 20   # documents are handled in groups of about this many bytes
_STEP = 1 << 16         # bytes hashed at once (2^16); keeps the temporary arrays in the CPU cache

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
LOWER_CODE = BYTE_CODE.copy()
LOWER_CODE[65:91] = BYTE_CODE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out)


_UP, _DOWN = _powers(BASE, _STEP + 1), _powers(BASE_INV, _STEP + 1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Group(NamedTuple):
    """Neighbouring documents of one batch: their bytes, where each starts, and the first one's row."""
    first: int
    data: np.ndarray      # uint8
    off: np.ndarray       # int64, documents + 1


class Words(NamedTuple):
    """Words of a group: byte bounds, hashes, and where each document's words start."""
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray       # int64, documents + 1


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """``(bytes, offsets)`` of a string column; null reads as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    n = len(col)
    if n == 0 or col.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(col.buffers()[1], kind)[col.offset: col.offset + n + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None else np.empty(0, np.uint8)
    return data[off[0]: off[-1]], off - off[0]


def groups(col, most: int = GROUP_BYTES) -> Iterator[Group]:
    """The column's documents in neighbouring groups of at most ``most`` bytes, or one longer document."""
    data, off = text_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        j = min(j, n, i + 4096)
        yield Group(i, data[off[i]: off[j]], off[i: j + 1] - off[i])
        i = j


def words(g: Group, lower: bool = True) -> Words:
    """Bounds and hashes of the words of ``g`` (``lower``: A-Z counts as a-z)."""
    data, off = g.data, g.off
    n = len(data)
    if n == 0:
        z = np.empty(0, np.int64)
        return Words(z, z, np.empty(0, np.uint64), np.zeros(len(off), np.int64))
    inside = IS_WORD[data]
    cut = off[(off > 0) & (off < n)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, span_hashes(data, start, end, LOWER_CODE if lower else BYTE_CODE),
                 np.searchsorted(start, off).astype(np.int64))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, code: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans whose starts and ends both ascend: differences of running sums, which are
    formed block by block so that their memory doesn't grow with a text's length."""
    blocks = max(1, -(-len(data) // _STEP))
    up, down = _powers(_UP[_STEP], blocks), _powers(_DOWN[_STEP], blocks + 1)
    at_start, at_end = np.zeros(len(start), np.uint64), np.zeros(len(end), np.uint64)
    s, e = (np.searchsorted(x, np.arange(blocks + 1) * _STEP, side="right") for x in (start, end))
    carry = np.zeros(1, np.uint64)
    for b in range(blocks):
        lo = b * _STEP
        part = data[lo: lo + _STEP]
        total = np.cumsum(code[part] * _UP[: len(part)]) * up[b] + carry
        at_start[s[b]: s[b + 1]] = total[start[s[b]: s[b + 1]] - lo - 1]
        at_end[e[b]: e[b + 1]] = total[end[e[b]: e[b + 1]] - lo - 1]
        carry = total[-1:]
    return mix((at_end - at_start) * _DOWN[start & (_STEP - 1)] * down[start >> 16])


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words that stay inside a document: ``(hash, first word, offsets)``."""
    count = np.maximum(np.diff(off) - (k - 1), 0)
    woff = np.zeros(len(off), np.int64)
    np.cumsum(count, out=woff[1:])
    n = len(h) - (k - 1)
    if n <= 0 or woff[-1] == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), woff
    total = h[:n].copy()
    for j in range(1, k):
        total *= BASE
        total += h[j: j + n]
    at = np.arange(woff[-1]) + np.repeat(off[:-1] - woff[:-1], count)
    return mix(total[at]), at, woff


def segment(off: np.ndarray) -> np.ndarray:
    """The document number of each item that the offsets delimit."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))
