"""Keyword counts of whole batches of texts with numpy: the words of a batch are found once, for all keyword lists.

A word is a run of ASCII letters, digits and underscores (``\\b`` and ``\\w`` of an ASCII regex); letters compare without
case. A list's hits in a text are its words that equal a keyword, which is what ``\\b(?:a|b)\\b`` counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

PLAIN = re.compile(r"[A-Za-z0-9_]+")


def _runs(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of marked bytes, none of them across two texts."""
    padded = np.concatenate([[False], inside, [False]])
    begin, end = inside & ~padded[:-2], inside & ~padded[2:]
    first = off[:-1][np.diff(off) > 0]
    last = off[1:][np.diff(off) > 0] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


class Words:
    """The words of a batch of texts (a null counts as an empty one)."""

    def __init__(self, texts: Iterable[str | None]):
        col = pa.array(texts, pa.large_string(), from_pandas=True).fill_null("")
        self.n = len(col)
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset: col.offset + self.n + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[off[0]: off[-1]]
        self.off, self.data = off - off[0], data
        self.begin, end = _runs(_WORD[data], self.off)
        self.length = end - self.begin
        self._words: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}

    def spaced(self) -> np.ndarray:
        """Runs of other than white space in each text."""
        return self._by_text(_runs(~_SPACE[self.data], self.off)[0])

    def _by_text(self, at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, self.off))

    def _of(self, length: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Begins of the words of a length, and their lower-cased bytes, eight to a number."""
        if length not in self._words:
            at = self.begin[self.length == length]
            packed = []
            for i in range(0, length, 8):
                code = np.zeros(len(at), np.uint64)
                for k in range(i, min(i + 8, length)):
                    code |= _LOWER[self.data[at + k]].astype(np.uint64) << np.uint64(8 * (k - i))
                packed.append(code)
            self._words[length] = at, packed
        return self._words[length]

    def hits(self, keywords: Iterable[str]) -> np.ndarray:
        """How many words of each text are one of the ``keywords`` (words themselves)."""
        found = []
        for length in {len(k) for k in keywords}:
            at, packed = self._of(length)
            equal = np.zeros(len(at), bool)
            for k in {k.lower().encode() for k in keywords if len(k) == length}:
                parts = [np.uint64(int.from_bytes(k[i: i + 8], "little")) for i in range(0, length, 8)]
                equal |= np.logical_and.reduce([p == x for p, x in zip(packed, parts)])
            found.append(at[equal])
        return self._by_text(np.sort(np.concatenate(found))) if found else np.zeros(self.n, np.int64)
