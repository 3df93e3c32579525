"""Quality rules: gradient-boosted trees over document statistics.

Every text is reduced to counts and ratios in one vectorised pass. Trees are grown on histograms of the
labelled rows' statistics, with a logistic loss and monotonic constraints on the features that can only
speak against a text, and are flattened into node arrays that score a whole batch at once. Two plain rules
come first: a text that they fail is not kept, whatever the trees say.

Defined results: a null or empty text has all counts 0 and fails the plain rules; with no labelled row the
trees pass every text; repeated rows are judged each for itself; other input columns pass through unread, and
an output column takes the place of an input column of its name.
Fitting takes a bounded sample of labelled rows (``sample_rows``, drawn by a hash of the id); statistics
cover every row and whole texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import extend, fresh

SYMBOLS = "#*$%&|<>"
WINDOW = 8
SAMPLE_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature -> -1 where a larger value may only lower the score, 0 where it is free.
FEATURES = {"log_words": 0, "mean_word": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "same_next_share": -1, "upper_share": -1, "digit_share": 0, "letter_share": 0, "stop_share": 0,
            "distinct_share": 0, "words_a_line": 0, "longest_word": 0, "bang_share": -1}

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(SYMBOLS.encode())] = 1
_CHAR = np.ones(256, np.uint8)          # 1 for the first byte of each character
_CHAR[0x80:0xC0] = 0
_UPPER, _DIGIT, _LETTER, _STOP, _BANG = (np.zeros(256, np.uint8) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC2:0xF5] = 1
_STOP[list(b".,;:")] = 1
_BANG[list(b"!?")] = 1


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[off])


def _distinct(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each document."""
    key = h + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(tb.mix(key))
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    return np.bincount(doc[order[new]], minlength=n)


def _repeated(g: tb.Group, w: tb.Words) -> np.ndarray:
    """Words of each document inside windows that it holds twice or more."""
    h, at, off = tb.windows(w.hash, w.off, WINDOW)
    cover = np.zeros(len(w.hash) + 1, np.int64)
    if len(h):
        key = tb.mix(h + tb.segment(off).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        found = at[order[twice]]
        np.add.at(cover, found, 1)
        np.add.at(cover, found + WINDOW, -1)
    return _per_doc(np.cumsum(cover[:-1]) > 0, w.off)


def _lines(g: tb.Group, w: tb.Words, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(lines with a word, those equal to an earlier one)`` of each document."""
    n = len(g.off) - 1
    brk = np.flatnonzero(g.data == 10)
    start = np.sort(np.concatenate([g.off[:-1], brk + 1]))
    # a line ends at its line feed or its document's end; a break at a document's end opens an empty line
    end = np.sort(np.concatenate([g.off[1:], brk]))
    total = np.zeros(len(g.data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    real = total[end] > total[start]
    start, end = start[real], end[real]
    doc = np.searchsorted(g.off, start, side="right") - 1
    h = tb.span_hashes(g.data, start, end, tb.BYTE_CODE)
    lines = np.bincount(doc, minlength=n)
    return lines, lines - _distinct(h, doc, n)


def statistics(col) -> pd.DataFrame:
    """Counts and features of every text of an Arrow column."""
    parts = []
    for g in tb.groups(col):
        w = tb.words(g, lower=False)
        n, nw = len(g.off) - 1, np.diff(w.off)
        inside = tb.IS_WORD[g.data]
        chars = _per_doc(_CHAR[g.data] * inside, g.off)
        symbols = _per_doc(_SYMBOL[g.data], g.off)
        lines, dup = _lines(g, w, inside)
        rep = _repeated(g, w)
        doc = tb.segment(w.off)
        next_same = np.zeros(len(w.hash), bool)
        next_same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
        longest = np.zeros(n)
        np.maximum.at(longest, doc, (w.end - w.start).astype(float))
        c, k = np.maximum(chars, 1), np.maximum(nw, 1)
        share = lambda t: _per_doc(t[g.data], g.off) / c
        parts.append(pd.DataFrame({
            "n_words": nw, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep,
            "log_words": np.log1p(nw), "mean_word": chars / k, "symbol_share": symbols / c,
            "dup_line_share": dup / np.maximum(lines, 1), "repeat_share": rep / k,
            "same_next_share": _per_doc(next_same, w.off) / k, "upper_share": share(_UPPER), "digit_share": share(_DIGIT),
            "letter_share": share(_LETTER), "stop_share": share(_STOP), "distinct_share": _distinct(w.hash, doc, n) / k,
            "words_a_line": nw / np.maximum(lines, 1), "longest_word": np.log1p(longest), "bang_share": share(_BANG)}))
    if not parts:
        return pd.DataFrame({c: pd.Series(dtype="int64" if c in COUNTS else "float64") for c in [*COUNTS, *FEATURES]})
    return pd.concat(parts, ignore_index=True)


class Trees(NamedTuple):
    """All nodes of all trees in a row: an inner node has a feature, a limit and its left child (the right one
    follows it); a leaf points to itself."""
    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                leaf = self.feature[at] < 0
                right = x[rows, np.maximum(self.feature[at], 0)] > self.limit[at]
                at = np.where(leaf, at, self.left[at] + right)
            out += self.value[at]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48,
        ridge: float = 1.0, constraints: list[int] | None = None) -> Trees:
    """Boosted trees for labels 0 and 1; ``constraints``: the sign a feature's effect must have, or 0."""
    n, f = x.shape if len(x) else (0, len(FEATURES))
    signs = np.array(constraints if constraints is not None else [0] * f)
    feature, limit, left, value, roots = [], [], [], [], []
    rate0 = (y.sum() + 1) / (n + 2) if n else 1 - 1e-6
    base = float(np.log(rate0 / (1 - rate0)))
    if n == 0 or len(np.unique(y)) < 2:
        return Trees(*(np.array(a, d) for a, d in ((roots, int), (feature, int), (limit, float), (left, int), (value, float))), base, depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        roots.append(len(feature))
        todo = [(np.arange(n), -np.inf, np.inf, 0)]
        place = [len(feature)]
        feature.append(-1), limit.append(0.0), left.append(0), value.append(0.0)
        while todo:
            rows, lo, hi, level = todo.pop(0)
            at = place.pop(0)
            gs, hs = grad[rows].sum(), hess[rows].sum()
            own = np.clip(gs / (hs + ridge), lo, hi)
            best = (1e-6, None)
            for j in range(f if level < depth and len(rows) >= 20 else 0):
                m = len(edges[j]) + 1
                gl = np.cumsum(np.bincount(binned[rows, j], grad[rows], m))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], hess[rows], m))[:-1]
                if not len(gl):
                    continue
                vl, vr = np.clip(gl / (hl + ridge), lo, hi), np.clip((gs - gl) / (hs - hl + ridge), lo, hi)
                gain = _gain(gl, hl, vl, ridge) + _gain(gs - gl, hs - hl, vr, ridge) - _gain(gs, hs, own, ridge)
                gain[(hl < 1) | (hs - hl < 1) | (signs[j] * (vr - vl) < 0)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                value[at], left[at] = rate * own, at
                margin[rows] += rate * own
                continue
            j, k, vl, vr = best[1]
            feature[at], limit[at], left[at] = j, edges[j][k], len(feature)
            goes = binned[rows, j] > k
            mid = (vl + vr) / 2
            for side, sub in ((0, rows[~goes]), (1, rows[goes])):
                a, b = (lo, hi) if signs[j] == 0 else (mid, hi) if (signs[j] > 0) == bool(side) else (lo, mid)
                todo.append((sub, a, b, level + 1))
                place.append(len(feature))
                feature.append(-1), limit.append(0.0), left.append(len(left)), value.append(0.0)
    return Trees(np.array(roots), np.array(feature), np.array(limit), np.array(left), np.array(value), base, depth)


def _gain(g, h, v, ridge):
    return g * v - 0.5 * (h + ridge) * v * v


def with_statistics(df: DataFrame, text: str = "text", trees: Trees | None = None, score: str = "score") -> DataFrame:
    """``df`` with the counts and features of ``text``, and the trees' score where trees are given."""
    add = [*COUNTS, *FEATURES, *([score] if trees else [])]

    def compute(b: pa.RecordBatch) -> list:
        s = statistics(b.column(text))
        if trees:
            s[score] = trees.scores(s[list(FEATURES)].to_numpy(float))
        return [pa.array(s[c].to_numpy(), pa.int64() if c in COUNTS else pa.float64()) for c in add]

    return extend(df, "rules", text, [T.StructField(c, T.LongType() if c in COUNTS else T.DoubleType()) for c in add], compute)


def train(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from the rows of ``df`` that ``labels`` marks (a bounded sample, see above)."""
    drawn = draw(labels, label, doc_id, sample_rows)
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where("t is not null").join(F.broadcast(drawn), "i")
    stats = with_statistics(bounded(rows, sample_rows), "t").drop("t").toPandas().sort_values(["i", "y", *FEATURES])
    return fit(stats[list(FEATURES)].to_numpy(float), stats["y"].to_numpy(float), constraints=list(FEATURES.values()))


def draw(labels: DataFrame, label: str, doc_id: str, rows: int) -> DataFrame:
    """About ``rows`` labelled ids ``(i, y)``, drawn by a hash of the id: small enough to broadcast."""
    marked = labels.select(F.col(doc_id).alias("i"), F.col(label).alias("y")).where("i is not null and y is not null")
    n = marked.count()
    return marked.where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(n, 1)))).distinct()


def bounded(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the ``rows (i, t, ...)``, by a hash of id and text, where ids repeat."""
    n = rows.count()
    if n <= most:
        return rows
    u = fresh("u")
    some = rows.withColumn(u, F.xxhash64("i", "t", F.lit(7)))
    # the limit meets few rows more than it keeps, copies of a row apart
    near = some.where(F.pmod(F.col(u), F.lit(1 << 30)) < int((1 << 30) * min(1.0, 1.5 * most / n)))
    return near.orderBy(F.pmod(F.col(u), F.lit(1 << 30)), u, *[c for c in rows.columns if c != "t"]).limit(most).drop(u)


def apply_rules(df: DataFrame, trees: Trees, text: str = "text", limit: float = 0.5) -> DataFrame:
    """``df`` with its statistics, ``score``, ``base_failed`` (the plain rules) and ``kept``."""
    out = with_statistics(df, text, trees)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= limit))
