"""Language identification with interpolated Kneser-Ney character models.

One model per language over lower-cased letters (every run of other characters reads as one space). The
models share sorted 64-bit hash arrays, one per order, with a row of log probabilities per gram (a column
per language) and a row of back-off weights per context. A text goes to the language of lowest
cross-entropy per character; a text whose cross-entropy lies beyond what calibration texts of that language
showed is not accepted.

Defined results: a null text or one without a letter is ``und`` with score 0 and not accepted; among equal
languages the alphabetically first wins; rows without a language are never learned from; with no row to
learn from, every text is ``und``. Copies of a row (id, text and language) are learned from once. Other input columns pass
through unread; an output column takes the place of an input column of its name.

Fitting uses a bounded sample: about ``sample_docs`` texts of at most ``sample_chars`` characters for each
language, drawn by a hash of id and text. Limits follow the 90 % quantile of the calibration texts, not their maximum,
so that a few mislabelled texts among them do not raise them. Prediction covers every row and whole texts.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, worker_cache
from .textbuf import mix

ORDER = 4
SAMPLE_DOCS = 500
SAMPLE_CHARS = 50_000
TYPICAL = 0.9      # share of a language's calibration texts that its rejection limits are derived from
UNKNOWN = "und"
_P = np.uint64(0xD6E8FEB86659FD93)


def letter_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space."""
    held = worker_cache("langid")
    if not held:
        t = np.full(0x110000, 32, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        held["letters"] = t
    return held["letters"]


class Chars(NamedTuple):
    """Normalised texts, each after ORDER - 1 spaces."""
    code: np.ndarray   # uint64
    at: np.ndarray     # where each real character stands
    off: np.ndarray    # real characters before each text, texts + 1
    letters: np.ndarray  # letters of each text


def normalise(texts: list[str]) -> Chars:
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    raw = letter_table()[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)]
    off = np.zeros(n + 1, np.int64)
    np.cumsum(lens, out=off[1:])
    letter = raw != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]            # the first space of a run stays
    starts = off[:-1][lens > 0]
    keep[starts] = letter[starts]      # a text doesn't begin with a space
    kept = np.flatnonzero(keep)
    koff = np.searchsorted(kept, off)
    size = np.diff(koff)
    at = np.arange(len(kept)) + (ORDER - 1) * (1 + np.repeat(np.arange(n), size))
    code = np.full(len(kept) + (ORDER - 1) * n, 32, np.uint64)
    code[at] = raw[kept]
    total = np.zeros(len(letter) + 1, np.int64)
    np.cumsum(letter, out=total[1:])
    return Chars(code, at, koff, total[off[1:]] - total[off[:-1]])


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """``[k]``: hashes of the k characters that begin at each place (unmixed; 0 characters hash to 0)."""
    out = [np.zeros(len(code) + 1, np.uint64)]
    for k in range(1, ORDER + 1):
        prev = out[-1][: max(0, len(code) - k + 1)]
        out.append(prev * _P + code[k - 1: k - 1 + len(prev)] + np.uint64(k))
    return out


class Table:
    """Sorted hashes with a row of values each, found through the leading bits of the hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.n = len(keys)
        self.keys = np.append(keys[order], np.uint64(0))
        self.values = np.concatenate([values[order], np.zeros((1, values.shape[1]), np.float32)]).astype(np.float32)
        bits = max(1, int(self.n * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys[: self.n], np.arange(2**bits, dtype=np.uint64) << self.shift)
        self.first = np.append(self.first, self.n).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, found)`` of each hash."""
        b = (h >> self.shift).astype(np.int64)
        row, end = self.first[b], self.first[b + 1]
        found = (self.keys[row] == h) & (row < end)
        todo = np.flatnonzero(~found & (row + 1 < end))
        while len(todo):
            row[todo] += 1
            hit = self.keys[row[todo]] == h[todo]
            found[todo[hit]] = True
            todo = todo[~hit]
            todo = todo[row[todo] + 1 < end[todo]]
        return row, found


class Model:
    """Joint hash arrays of all languages."""

    def __init__(self, langs: list[str], grams: dict[int, Table], backs: dict[int, Table], floor: np.ndarray):
        self.langs, self.grams, self.backs, self.floor = langs, grams, backs, floor
        self.mean = self.slack = self.slope = None
        self.sharpness = 1.0

    def log_probs(self, h: list[np.ndarray], at: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probabilities (rows: the grams of ``order`` characters beginning at ``at``; a column per language)."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(at), len(self.langs)))
        row, found = self.grams[order].find(mix(h[order][at]))
        out = self.grams[order].values[row]
        miss = np.flatnonzero(~found)
        if len(miss):
            low = self.log_probs(h, at[miss] + 1, order - 1)
            crow, cfound = self.backs[order].find(mix(h[order - 1][at[miss]]))
            out[miss] = low + np.where(cfound[:, None], self.backs[order].values[crow], 0)
        return out

    def cross_entropies(self, c: Chars) -> np.ndarray:
        """Mean negative log probability of a character (a row per text, a column per language)."""
        n = len(c.off) - 1
        out = np.zeros((n, len(self.langs)))
        some = np.flatnonzero(np.diff(c.off))
        if len(some):
            lp = self.log_probs(gram_hashes(c.code), c.at - (ORDER - 1))
            out[some] = -np.add.reduceat(lp, c.off[some], axis=0, dtype=np.float64) / np.diff(c.off)[some][:, None]
        return out

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(language number or -1, score, accepted)`` of each text."""
        c = normalise(texts)
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool)
        ce, n = self.cross_entropies(c), np.maximum(np.diff(c.off), 1)
        best = ce.argmin(axis=1)
        low = ce[np.arange(len(texts)), best]
        odds = np.exp(-self.sharpness * np.sqrt(n)[:, None] * (ce - low[:, None]))
        none = c.letters == 0
        ok = low <= self.mean[best] + self.slack[best] + self.slope[best] / np.sqrt(n)
        return np.where(none, -1, best), np.where(none, 0.0, 1 / odds.sum(axis=1)), ok & ~none


def _count(h: list[np.ndarray], at: np.ndarray) -> tuple[dict, dict, int]:
    """One language's Kneser-Ney probabilities and back-off weights, each per order as ``(hashes, values)``, and
    its number of letters."""
    # distinct grams of each order, with one place each; the lower orders count distinct left neighbours
    place, count = {}, {}
    _, first, n = np.unique(h[ORDER][at], return_index=True, return_counts=True)
    place[ORDER], count[ORDER] = at[first], n.astype(np.float64)
    for k in range(ORDER - 1, 0, -1):
        _, first, n = np.unique(h[k][place[k + 1] + 1], return_index=True, return_counts=True)
        place[k], count[k] = place[k + 1][first] + 1, n.astype(np.float64)
    probs, backs = {}, {}
    letters = len(place[1])
    lower_keys, lower = None, None
    for k in range(1, ORDER + 1):
        n1, n2 = (count[k] == 1).sum(), (count[k] == 2).sum()
        d = min(0.95, max(0.1, n1 / (n1 + 2 * n2))) if n1 + n2 else 0.5
        ctx, inv = np.unique(h[k - 1][place[k]], return_inverse=True)
        total, kinds = np.bincount(inv, count[k]), np.bincount(inv)
        weight = d * kinds / total
        if k == 1:
            base = np.full(len(place[k]), 1 / (letters + 1))
        else:
            base = lower[np.searchsorted(lower_keys, h[k - 1][place[k] + 1])]
        p = (count[k] - d) / total[inv] + weight[inv] * base
        keys = h[k][place[k]]
        order = np.argsort(keys)
        lower_keys, lower = keys[order], p[order]
        probs[k], backs[k] = (lower_keys, lower), (ctx, weight)
    return probs, backs, letters


def fit(texts: list[str], langs: list[str]) -> Model:
    """A model from labelled texts; every fifth one of a language calibrates."""
    names = sorted(set(langs))
    mine = {g: [t for t, x in zip(texts, langs) if x == g] for g in names}
    seen, held = {}, {}
    for g in names:
        held[g] = mine[g][::5] if len(mine[g]) >= 50 else []
        seen[g] = [t for i, t in enumerate(mine[g]) if not held[g] or i % 5]
    parts, places = {}, {}
    for g in names:
        c = normalise(seen[g])
        h = gram_hashes(c.code)
        parts[g] = _count(h, c.at - (ORDER - 1)) if len(c.at) else None
        places[g] = (c, h)
    names = [g for g in names if parts[g] is not None]
    floor = np.array([-np.log(parts[g][2] + 1.0) for g in names], np.float32)
    grams, backs = {}, {}
    model = Model(names, grams, backs, floor)
    for k in range(1, ORDER + 1):
        ctx = np.unique(np.concatenate([parts[g][1][k][0] for g in names])) if names else np.empty(0, np.uint64)
        bv = np.zeros((len(ctx), len(names)), np.float32)
        for j, g in enumerate(names):
            keys, w = parts[g][1][k]
            bv[np.searchsorted(ctx, keys), j] = np.log(w)
        backs[k] = Table(mix(ctx), bv)
        # a gram's row holds every language's probability; where a language hasn't seen it, by back-off
        grams[k] = Table(np.empty(0, np.uint64), np.empty((0, len(names)), np.float32))
        found: dict[str, tuple] = {}
        for g in names:
            c, h = places[g]
            at = c.at - (ORDER - 1) + (ORDER - k)
            keys, first = np.unique(h[k][at], return_index=True)
            found[g] = (keys, model.log_probs(h, at[first], k))
        union, first = np.unique(np.concatenate([found[g][0] for g in names]), return_index=True) if names else (np.empty(0, np.uint64), [])
        values = np.concatenate([found[g][1] for g in names])[first].copy() if names else np.empty((0, 0), np.float32)
        for j, g in enumerate(names):
            keys, p = parts[g][0][k]
            where = np.searchsorted(union, keys)
            known = (where < len(union)) & (union[np.minimum(where, len(union) - 1)] == keys)
            values[where[known], j] = np.log(p[known])
        grams[k] = Table(mix(union), values)
    # limits for languages with too few texts to calibrate: generous ones about the counted texts
    model.slack, model.slope = np.full(len(names), 1.5), np.full(len(names), 6.0)
    model.mean = np.array([model.cross_entropies(places[g][0])[:, j].mean() for j, g in enumerate(names)])
    _calibrate(model, held)
    return model


def _calibrate(model: Model, held: dict[str, list[str]]) -> None:
    """Rejection limits of each language and the sharpness of scores, from texts that were not counted."""
    gaps, sizes, right = [], [], []
    for j, g in enumerate(model.langs):
        c = normalise(held[g])
        n = np.diff(c.off)
        use = n > 0
        if use.sum() < 10:
            continue
        ce, n = model.cross_entropies(c)[use], n[use]
        model.mean[j] = np.average(ce[:, j], weights=n)
        beyond = ce[:, j] - model.mean[j]
        long = n >= np.median(n)
        model.slack[j] = max(0.75, 2 * np.quantile(beyond[long], TYPICAL))
        model.slope[j] = max(6.0, 1.5 * np.quantile((beyond - model.slack[j]) * np.sqrt(n), TYPICAL))
        gaps.append(ce), sizes.append(n), right.append(np.full(len(n), j))
    if gaps:
        ce, n, j = np.concatenate(gaps), np.concatenate(sizes), np.concatenate(right)
        def loss(s: float) -> float:
            z = -s * np.sqrt(n)[:, None] * (ce - ce.min(axis=1, keepdims=True))
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(n)), j]).mean())
        model.sharpness = min((0.05 * 2**k for k in range(11)), key=loss)


def train(df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the rows of ``df`` that have a text and a language (a bounded sample, see above)."""
    rows = df.select(F.col(doc_id).alias("i"), F.col(text).alias("t"), F.col(lang).alias("g")).where("g is not null and t is not null")
    sizes = {r["g"]: r["count"] for r in rows.groupBy("g").count().collect()}
    if not sizes:
        return fit([], [])
    spread = float(2**32)
    share = F.create_map(*[F.lit(x) for g, n in sizes.items() for x in (g, min(1.0, 1.5 * sample_docs / n))])
    # rows that share an id, or have none, are drawn by their texts; copies of a row are drawn as one
    drawn = (rows.withColumn("u", F.pmod(F.xxhash64("i", "t"), F.lit(2**32)) / F.lit(spread))
             .where((F.col("u") < share[F.col("g")]) & (F.length("t") <= sample_chars)).dropDuplicates(["g", "u"]).toPandas())
    drawn = drawn.sort_values(["g", "u", "i", "t"]).groupby("g").head(sample_docs)
    return fit(drawn["t"].tolist(), drawn["g"].tolist())


def identify(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score",
             accepted: str = "accepted") -> DataFrame:
    """``df`` with the predicted language, its posterior score and whether the text is accepted."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def compute(b: pa.RecordBatch) -> list:
        names = np.array([*shared.value.langs, UNKNOWN], object)
        who, s, ok = shared.value.predict([t or "" for t in b.column(text).to_pylist()])
        return [pa.array(names[who], pa.string()), pa.array(s, pa.float64()), pa.array(ok)]

    return extend(df, "langid", text, [T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()),
                             T.StructField(accepted, T.BooleanType())], compute, 1 << 19)
