"""Quality classifier: naive Bayes support vectors.

A text's n-grams (words, word pairs, runs of 2 to 8 equal words whatever the word, byte triples) are hashed to
indicators. Each
indicator is scaled by the log ratio of its smoothed frequencies in the two classes; a linear hinge-loss
model over the scaled, length-normalised indicators is fitted by dual coordinate descent. A logistic curve
fitted by cross-validation turns margins into scores.

Defined results: a null or empty text has no indicator and gets the score of the bias alone; with labels of
one class only, every score is the smoothed share of class 1; repeated rows score alike; other input columns
pass through unread, and the output column takes the place of an input column of its name. Fitting takes a
bounded sample of labelled texts (``sample_rows`` texts of at most
``sample_chars`` characters, drawn by a hash of the id); scoring covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import extend
from .rules import bounded, draw

BITS = 18
SAMPLE_ROWS = 6_000
SAMPLE_CHARS = 50_000
#: Indicator of a run of so many equal words.
_RUNS = (tb.mix(np.arange(9, dtype=np.uint64) + np.uint64(0x5A17)) >> np.uint64(64 - BITS)).astype(np.int64)
_TRIPLE = np.uint32(2654435761)


def indicators(col) -> Iterator[np.ndarray]:
    """The distinct hashed n-grams of each text, ascending."""
    seen = np.zeros(1 << BITS, bool)
    for g in tb.groups(col):
        w = tb.words(g)
        top = np.uint64(64 - BITS)
        one = (w.hash >> top).astype(np.int32)
        two = (tb.mix(w.hash[:-1] * np.uint64(3) + w.hash[1:]) >> top).astype(np.int32)
        at = np.arange(len(w.hash))
        new = np.append(True, w.hash[1:] != w.hash[:-1])[: len(at)]
        new[w.off[:-1][np.diff(w.off) > 0]] = True
        run = at - np.maximum.accumulate(np.where(new, at, 0)) + 1       # equal words up to each
        d = g.data.astype(np.uint32)
        three = (((d[:-2] << np.uint32(16) | d[1:-1] << np.uint32(8) | d[2:]) * _TRIPLE) >> np.uint32(32 - BITS)).astype(np.int32)
        for i in range(len(g.off) - 1):
            a, b, s, e = w.off[i], w.off[i + 1], g.off[i], g.off[i + 1]
            seen[one[a:b]] = True
            seen[two[a: max(a, b - 1)]] = True
            seen[three[s: max(s, e - 2)]] = True
            if b > a:
                seen[_RUNS[2: run[a:b].max() + 1]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


class Model:
    def __init__(self, weight: np.ndarray, ratio: np.ndarray, bias: float, slope: float, shift: float):
        self.weight, self.ratio, self.bias, self.slope, self.shift = weight, ratio, bias, slope, shift
        #: squared scale and weight of an indicator before length normalisation
        self.square, self.both = ratio**2, ratio * weight

    def margin(self, found: np.ndarray) -> float:
        length = np.sqrt(self.square[found].sum())
        return self.bias + (float(self.both[found].sum()) / length if length > 0 else 0.0)

    def scores(self, col) -> np.ndarray:
        m = np.array([self.margin(x) for x in indicators(col)])
        return 1 / (1 + np.exp(-(self.slope * m + self.shift)))


def fit(texts: list[str], y: np.ndarray, cost: float = 1.0, passes: int = 12, folds: int = 4) -> Model:
    """A model for labels 0 and 1. The logistic curve is fitted to margins of models that hadn't seen the text."""
    zero = np.zeros(1 << BITS)
    prior = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Model(zero, zero, 0.0, 0.0, float(np.log(prior / (1 - prior))))
    rows = list(indicators(pa.array(texts, pa.string())))
    every = np.arange(len(y))
    model = _linear(rows, y, every, cost, passes)
    margins, seen = np.zeros(len(y)), np.zeros(len(y), bool)
    for f in range(folds):
        held = every % folds == f
        if len(np.unique(y[~held])) == 2:
            part = _linear(rows, y, every[~held], cost, passes)
            margins[held] = [part.margin(rows[i]) for i in every[held]]
            seen |= held
    if not seen.all():
        margins = np.array([model.margin(r) for r in rows])
    model.slope, model.shift = _logistic(margins, y)
    return model


def _linear(rows: list[np.ndarray], y: np.ndarray, learn: np.ndarray, cost: float, passes: int) -> Model:
    count = np.ones((2, 1 << BITS))
    for i in learn:
        count[int(y[i])][rows[i]] += 1
    share = count / count.sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    weight, bias = _descend([rows[i] for i in learn], np.where(y[learn] > 0, 1.0, -1.0), ratio, cost, passes)
    return Model(weight, ratio, bias, 1.0, 0.0)


def _descend(rows, sign, ratio, cost, passes) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the rarer class weighs as much as the other."""
    x = []
    for r in rows:
        v = ratio[r]
        x.append(v / (np.sqrt((v * v).sum()) or 1.0))
    diag = np.array([(v * v).sum() + 1.0 for v in x])
    upper = cost * np.where(sign > 0, len(sign) / (2 * (sign > 0).sum()), len(sign) / (2 * (sign < 0).sum()))
    alpha, w, b = np.zeros(len(rows)), np.zeros(1 << BITS), 0.0
    rng = np.random.default_rng(7)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            grad = sign[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(alpha[i] - grad / diag[i], 0.0), upper[i])
            if (step := (new - alpha[i]) * sign[i]) != 0:
                w[rows[i]] += step * x[i]
                b += step
                alpha[i] = new
                worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, b


def _logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve, with smoothed targets so that they stay finite (Newton steps)."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.stack([m, np.ones(len(m))], axis=1)
    a = np.array([1.0, 0.0])

    def loss(a):
        s = z @ a
        return (np.logaddexp(0, s) - t * s).sum()

    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ a)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-6 * np.eye(2), z.T @ (p - t))
        scale = 1.0
        while scale > 1e-4 and loss(a - scale * step) > loss(a):
            scale /= 2
        a = a - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return float(a[0]), float(a[1])


def train(df: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text",
          sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from the rows of ``df`` that ``labels`` marks (a bounded sample, see above)."""
    drawn = draw(labels, label, doc_id, sample_rows)
    rows = (df.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).where(F.length("t") <= sample_chars)
            .join(F.broadcast(drawn), "i"))
    rows = bounded(rows, sample_rows).withColumn("u", F.xxhash64("i", F.lit(11))).toPandas().sort_values(["u", "i", "y", "t"])
    return fit(rows["t"].tolist(), rows["y"].to_numpy(float))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return extend(df, "nbsvm", text, [T.StructField(out, T.DoubleType())], lambda b: [pa.array(shared.value.scores(b.column(text)), pa.float64())])
