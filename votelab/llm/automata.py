"""Count transducers: weighted acyclic automata over paths ``language, word, word, ...``.

States are kept by depth, each depth sorted by (source state, label), so that arcs are looked up by binary search and
paths stand in byte order of their words. The weight of a state is the count of the phrase that leads to it. Labels
are positions in the automaton's own sorted dictionaries. Blocks are built from sorted paths and added to a growing
automaton by ``union``, which sums weights; ``parts`` cuts one into slices by ranges of a hash of the prefix
(language and first two words); ``compose`` looks another automaton's paths up.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textbuf as tb


class Automaton(NamedTuple):
    langs: pa.Array            # sorted binary labels of depth 0
    words: pa.Array            # sorted binary labels of the depths after it
    parent: list[np.ndarray]   # by depth: source state of each state's arc
    label: list[np.ndarray]
    weight: list[np.ndarray]

    def dumps(self) -> bytes:
        """Compact bytes: narrow labels, steps between the sorted source states, one byte for small weights."""
        steps = [np.diff(p, prepend=0) for p in self.parent]
        many = [np.flatnonzero(w >= 255) for w in self.weight]
        return pickle.dumps((_raw(self.langs), _raw(self.words), [_narrow(p) for p in steps], [_narrow(x) for x in self.label],
                             [np.minimum(w, 255).astype(np.uint8) for w in self.weight], [_narrow(i) for i in many],
                             [w[i] for w, i in zip(self.weight, many)]), 5)


def loads(blob: bytes) -> Automaton:
    langs, words, steps, label, small, many, value = pickle.loads(blob)
    weight = [w.astype(np.int64) for w in small]
    for w, i, v in zip(weight, many, value):
        w[i] = v
    return Automaton(_array(*langs), _array(*words), [np.cumsum(p, dtype=np.int64) for p in steps], [x.astype(np.int64) for x in label], weight)


def _narrow(a: np.ndarray) -> np.ndarray:
    """The least unsigned type that holds the values."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _raw(a: pa.Array) -> tuple[bytes, np.ndarray]:
    data, off = tb.text_bytes(a)
    return data.tobytes(), off.astype(np.int32)


def _array(data: bytes, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data)])


def sorted_labels(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct values in byte order, and each value's place among them."""
    d = a.dictionary_encode()
    order = np.asarray(pc.sort_indices(d.dictionary))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return d.dictionary.take(pa.array(order)), rank[np.asarray(d.indices)]


def hashes(a: pa.Array) -> np.ndarray:
    """The labels' 64-bit hashes, as ``textbuf.words`` gives them."""
    data, off = tb.text_bytes(a)
    if not len(data):
        return np.zeros(len(a), np.uint64)
    full = off[1:] > off[:-1]                    # an empty language is a label too
    out = np.zeros(len(a), np.uint64)
    out[full] = tb.span_hashes(data, off[:-1][full], off[1:][full], tb.BYTE_CODE)
    return out


def build(langs: pa.Array, words: pa.Array, paths: list[np.ndarray], weight: np.ndarray) -> Automaton:
    """The automaton of paths (one array of labels a depth) whose last states get ``weight``; repeats add up."""
    state = np.zeros(len(weight), np.int64)
    parent, label, weights = [], [], []
    for d, at in enumerate(paths):
        size = max(1, len(words if d else langs))
        key, state = np.unique(state * size + at, return_inverse=True)
        parent.append(key // size), label.append(key % size), weights.append(np.zeros(len(key), np.int64))
    np.add.at(weights[-1], state, weight)
    return Automaton(langs, words, parent, label, weights)


def paths(a: Automaton, depth: int | None = None) -> list[np.ndarray]:
    """The labels of the paths to the states of one depth (the last), in order."""
    depth = len(a.label) - 1 if depth is None else depth
    state, out = np.arange(len(a.label[depth])), []
    for d in range(depth, -1, -1):
        out.append(a.label[d][state])
        state = a.parent[d][state]
    return out[::-1]


def taken(a: Automaton, cols: list[np.ndarray], weight: np.ndarray) -> Automaton:
    """An automaton of some paths of ``a``, with only the labels that they need."""
    used, at = np.unique(cols[0], return_inverse=True)
    new, langs = [at], a.langs.take(pa.array(used))
    flat = np.concatenate(cols[1:]) if len(cols) > 1 else np.zeros(0, np.int64)
    used, at = np.unique(flat, return_inverse=True)
    if len(cols) > 1:
        new += np.split(at, len(cols) - 1)
    return build(langs, a.words.take(pa.array(used)), new, weight)


def frequent(a: Automaton, least: int) -> Automaton:
    """The paths to the last states of weight ``least`` or more."""
    keep = np.flatnonzero(a.weight[-1] >= least)
    return taken(a, [c[keep] for c in paths(a)], a.weight[-1][keep])


def union(parts: list[Automaton]) -> Automaton:
    """All paths of the parts; weights of equal paths add up."""
    if len(parts) == 1:
        return parts[0]
    langs, lang_at = sorted_labels(pa.concat_arrays([p.langs for p in parts]))
    words, word_at = sorted_labels(pa.concat_arrays([p.words for p in parts]))
    lang_at = np.split(lang_at, np.cumsum([len(p.langs) for p in parts])[:-1])
    word_at = np.split(word_at, np.cumsum([len(p.words) for p in parts])[:-1])
    states = [np.zeros(1, np.int64) for _ in parts]
    parent, label, weight = [], [], []
    for d in range(max(len(p.label) for p in parts)):
        size = max(1, len(words if d else langs))
        own = [i for i, p in enumerate(parts) if d < len(p.label)]
        key = np.concatenate([states[i][parts[i].parent[d]] * size + (word_at if d else lang_at)[i][parts[i].label[d]] for i in own])
        key, at = np.unique(key, return_inverse=True)
        w = np.zeros(len(key), np.int64)
        np.add.at(w, at, np.concatenate([parts[i].weight[d] for i in own]))
        for i, s in zip(own, np.split(at, np.cumsum([len(parts[i].label[d]) for i in own])[:-1])):
            states[i] = s
        parent.append(key // size), label.append(key % size), weight.append(w)
    return Automaton(langs, words, parent, label, weight)


def phrase_hashes(a: Automaton, cols: list[np.ndarray]) -> np.ndarray:
    """Hashes of (language, words), as ``gram_hashes`` gives them for running text."""
    word, total = hashes(a.words), None
    for c in cols[1:]:
        total = word[c] if total is None else total * tb.BASE + word[c]
    return gram_hashes(np.zeros(len(cols[0]), np.uint64) if total is None else tb.mix(total), hashes(a.langs)[cols[0]])


def gram_hashes(windows: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return tb.mix(windows + lang)


def prefix_range(a: Automaton, cols: list[np.ndarray], ranges: int) -> np.ndarray:
    """The range, of ``ranges`` equal ones over the hash of the prefix, of each path."""
    h = phrase_hashes(a, cols[:3]) >> np.uint64(32)
    return ((h * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def parts(a: Automaton, ranges: int, cols: list[np.ndarray] | None = None, weight: np.ndarray | None = None):
    """``(range, automaton)`` of each range that has paths of ``a`` (to the last states, unless paths are given)."""
    cols = paths(a) if cols is None else cols
    weight = a.weight[-1] if weight is None else weight
    where = prefix_range(a, cols, ranges)
    order = np.argsort(where, kind="stable")
    cut = np.flatnonzero(np.diff(where[order], prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(order)]):
        rows = order[i:j]
        yield int(where[rows[0]]), taken(a, [c[rows] for c in cols], weight[rows])


def compose(a: Automaton, cols: list[np.ndarray], counts: Automaton) -> np.ndarray:
    """The weights that ``counts`` gives to paths of ``a``'s labels; 0 for those it doesn't hold."""
    state, found = np.zeros(len(cols[0]), np.int64), np.ones(len(cols[0]), bool)
    for d, c in enumerate(cols):
        own, other = (a.words, counts.words) if d else (a.langs, counts.langs)
        to = np.asarray(pc.fill_null(pc.index_in(own, value_set=other), -1)).astype(np.int64)[c]
        if d >= len(counts.label) or not len(counts.label[d]):
            return np.zeros(len(state), np.int64)
        size = max(1, len(other))
        arcs = counts.parent[d] * size + counts.label[d]
        at = np.minimum(np.searchsorted(arcs, state * size + to), len(arcs) - 1)
        found &= (to >= 0) & (arcs[at] == state * size + to)
        state = np.where(found, at, 0)
    return np.where(found, counts.weight[len(cols) - 1][state], 0)
