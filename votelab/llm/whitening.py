"""Embedding whitening from an exact covariance.

Entries become integers ``x = floor(64 * c) + 1000000``. Blocks of rows are bit-sliced: each dimension, shifted by
its least value in the block, is packed plane by plane into 64-bit words across rows, and cross-products are sums
of AND-popcounts weighted by the planes' powers of two. A plane of ones beside them gives the sums and the number
of rows. Blocks and tasks add up as integers of any size (limbs of 40 bits in the shuffle), so that
``n^2 V = n * sum(x x') - S S'`` is exact before the first rounding; ``eigh`` sees only the centred matrix.

Defined results: a vector that is null, or holds a null or non-finite entry, gives no row; nor does one whose
length isn't the commonest (ties: the longer one counts). An empty table gives an empty model and no rows; a
component whose eigenvalue is zero up to rounding (one row, equal rows, dependent dimensions) gets whitened values
of 0 and is left out of the identity error; equal eigenvalues leave their vectors' choice to ``eigh``. Repeated rows
and ids count row by row; ``deviation`` is null where it doesn't fit a long. Entries beyond +-2^62 after scaling
saturate. Other input columns pass through; an output column takes the place of one of its name. Texts aren't read.
Memory: a block of ``BLOCK`` rows and a d x d matrix a task; d x d numbers reach the driver, whatever the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import extend, prepare

SCALE, SHIFT = 64, 1_000_000
BLOCK = 1 << 15          # rows that are bit-sliced together
LIMB, LIMBS = 40, 5      # sums travel as limbs: 2^23 partial sums fit a long each
_TOP = float(1 << 62)


class Model(NamedTuple):
    """``n`` rows with sums ``total`` of ``x - SHIFT`` (exact); components by falling eigenvalue, as rows."""
    n: int
    total: list[int]
    values: np.ndarray       # eigenvalues
    vectors: np.ndarray      # (components, dimensions)
    explained: np.ndarray
    usable: np.ndarray       # eigenvalue positive beyond rounding


def usable_rows(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector has finite entries only and the commonest length."""
    whole = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    ok = df.where(F.col(vector).isNotNull() & F.coalesce(whole, F.lit(False)))
    size = F.size(vector)
    first = ok.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return ok.where(size == (first["d"] if first else -1))


def integers(col, dims: int) -> np.ndarray:
    """``floor(64 * c)`` of every entry, one row a vector."""
    flat = np.asarray(col.flatten().cast(pa.float64()))
    return np.clip(np.floor(flat * SCALE), -_TOP, _TOP).astype(np.int64).reshape(-1, dims)


def planes(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(words, dimension, bit, least)``: the bit planes of ``z - least`` that hold a one, each packed across rows
    into 64-bit words; the last one, of an added dimension, is all ones."""
    rows, dims = z.shape
    least = z.min(axis=0)
    y = (z - least).astype(np.uint64)                    # the difference wraps into 64 bits without loss
    packed, dim, bit = [], [], []

    def add(ones: np.ndarray, d: int, b: int) -> None:
        packed.append(np.resize(np.append(np.packbits(ones), np.zeros(8, np.uint8)), -(-rows // 64) * 8))
        dim.append(d), bit.append(b)

    for d in range(dims):
        for b in range(int(y[:, d].max()).bit_length()):
            add(((y[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), d, b)
    add(np.ones(rows, np.uint8), dims, 0)
    return np.stack(packed).view(np.uint64), np.array(dim), np.array(bit), np.append(least, 0)


def scatter(z: np.ndarray) -> np.ndarray:
    """Exact cross-products of ``z``'s columns and of a column of ones after them, as Python integers."""
    words, dim, bit, least = planes(z)
    size = z.shape[1] + 1
    small = 2 * int(bit.max()) + len(z).bit_length() + 2 < 63
    acc = np.zeros((size, size), np.int64 if small else object)
    for p in range(len(words)):
        hits = np.bitwise_count(words[p] & words[p:]).sum(axis=1, dtype=np.int64)
        hits[1:][dim[p + 1:] == dim[p]] *= 2             # two planes of one dimension meet in both orders
        weighted = hits << (bit[p] + bit[p:]) if small else np.array([int(h) << int(bit[p] + b) for h, b in zip(hits, bit[p:])], object)
        np.add.at(acc[dim[p]], dim[p:], weighted)
    y = acc.astype(object)
    y = np.triu(y) + np.triu(y, 1).T
    # from y = z - least back to z
    m, s, n = least.astype(object), y[:, -1], int(y[-1, -1])
    s_m = np.outer(s, m)
    return y + s_m + s_m.T + n * np.outer(m, m)


def _limbs(v: int) -> list[int]:
    """Base 2^40, the last limb signed."""
    low = [(v >> (LIMB * k)) & ((1 << LIMB) - 1) for k in range(LIMBS - 1)]
    return [*low, v >> (LIMB * (LIMBS - 1))]


_NAMES = [f"l{k}" for k in range(LIMBS)]


def totals(df: DataFrame, dims: int, vector: str = "embedding") -> np.ndarray:
    """The exact cross-products of all rows: one partial matrix a task, added up by Spark."""
    prepare(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc, waiting, rows = None, [], 0
        for b in batches:
            waiting.append(integers(b.column(0), dims))
            rows += b.num_rows
            if rows >= BLOCK:
                acc, waiting, rows = _added(acc, waiting), [], 0
        acc = _added(acc, waiting) if rows else acc
        if acc is not None:
            i, j = np.triu_indices(dims + 1)
            limbs = np.array([_limbs(int(v)) for v in acc[i, j]], np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, limbs)], ["i", "j", *_NAMES])

    schema = "i int, j int, " + ", ".join(f"{c} long" for c in _NAMES)
    parts = df.select(vector).mapInArrow(partial, schema)
    out = np.zeros((dims + 1, dims + 1), object)
    for r in parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in _NAMES]).collect():
        v = sum(int(r[c]) << (LIMB * k) for k, c in enumerate(_NAMES))
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = v
    return out


def _added(acc, waiting: list[np.ndarray]):
    z = np.concatenate(waiting)
    for i in range(0, len(z), BLOCK):
        part = scatter(z[i: i + BLOCK])
        acc = part if acc is None else acc + part
    return acc


def train(df: DataFrame, vector: str = "embedding", components: int = 32) -> Model:
    """The model of the rows of ``df``, which ``usable_rows`` has filtered."""
    first = df.select(F.size(vector).alias("d")).first()
    dims = first["d"] if first else 0
    if dims == 0:
        none = np.zeros(0)
        return Model(0, [], none, np.zeros((0, 0)), none, none.astype(bool))
    cross = totals(df, dims, vector)
    n, s = int(cross[-1, -1]), [int(v) for v in cross[-1, :-1]]
    centred = [[n * int(cross[i, j]) - s[i] * s[j] for j in range(dims)] for i in range(dims)]
    v = np.array([[c / (n * n) for c in row] for row in centred])     # integer division, rounded once
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:components]
    trace = sum(centred[i][i] for i in range(dims)) / (n * n)
    values = values[order]
    usable = values > max(trace, 0) * dims * 2.0**-50
    explained = np.where(usable, values / (trace or 1.0), 0.0)
    return Model(n, s, values, vectors.T[order], explained, usable)


def _project(z: np.ndarray, m: Model) -> tuple[np.ndarray, list]:
    """Whitened values, and the sum of squares of ``n*x - S`` (in Python integers only where 64 bits don't do)."""
    big = m.n * (int(np.abs(z).max(initial=0)) + 1) + max(map(abs, m.total)) < 1 << 62
    c = z * m.n - np.array(m.total) if big else z.astype(object) * m.n - np.array(m.total, object)
    centred = (c / m.n).astype(float)
    white = centred @ m.vectors.T / np.where(m.usable, np.sqrt(np.where(m.usable, m.values, 1.0)), np.inf)
    most = int(np.abs(c).max(initial=0))
    if big and most * most * z.shape[1] < 1 << 63:
        dev = (c * c).sum(axis=1).tolist()
    else:
        dev = [d if d < 1 << 63 else None for d in (c.astype(object) ** 2).sum(axis=1).tolist()]
    return white, dev


def whiten(df: DataFrame, m: Model, vector: str = "embedding", whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The rows of ``df``, which ``usable_rows`` has filtered, with their whitened vector and exact deviation."""

    def compute(b: pa.RecordBatch) -> list:
        z = integers(b.column(vector), len(m.total))
        white, dev = _project(z, m)
        k = white.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(white) + 1) * k, k, dtype=np.int32)), pa.array(white.ravel()))
        return [lists, pa.array(dev, pa.int64())]

    if not m.n:
        return df.where("false").withColumn(whitened, F.lit(None).cast("array<double>")).withColumn(deviation, F.lit(None).cast("long"))
    return extend(df, "whitening", vector, [T.StructField(whitened, T.ArrayType(T.DoubleType())), T.StructField(deviation, T.LongType())],
                  compute, most=8192 * len(m.total))


def identity_error(df: DataFrame, m: Model, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over usable components; the
    values are centred by their exact mean before they are multiplied."""
    if not m.n or not m.usable.any():
        return 0.0
    k = int(m.usable.sum())
    prepare(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros((k + 1, k + 1))
        for b in batches:
            w = _project(integers(b.column(0), len(m.total)), m)[0][:, m.usable]
            w = np.column_stack([w, np.ones(len(w))])
            acc += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(acc[i, j])], ["i", "j", "v"])

    sums = np.zeros((k + 1, k + 1))
    for r in df.select(vector).mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r["i"], r["j"]] = sums[r["j"], r["i"]] = r["v"]
    mean = sums[-1, :-1] / m.n
    return float(np.abs(sums[:-1, :-1] / m.n - np.outer(mean, mean) - np.eye(k)).max())
