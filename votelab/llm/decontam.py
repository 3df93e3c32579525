"""Benchmark decontamination: size-partitioned MinHash containment search with exact confirmation.

Test items are partitioned by size (powers of two of their shingle count). A long document would drown a short
item, so for each partition the document is seen through windows fitted to the partition's sizes: blocks of
its smallest size, three blocks a window, so that every run as long as an item of the partition lies whole in
some window. Universal-hash minima of a window and of an item agree with probability at least 0.25 each where
the item is contained at the limit; one agreement of 40 makes a candidate (a pair at the limit is missed with
probability 1e-5 or less). An item that repeats shingles may fill no window, nor its share of one; such items are
looked up exactly instead, by as many of their shingles as a document that contains them cannot lack all of. Every candidate is confirmed on the exact shingle sets of the whole
document and the item.

Items are the query set: they are sent to the tasks in blocks of bounded size, one pass over the documents a
block, so neither side needs a shuffle and no document is held with another.

Defined results: items with fewer than ``k`` words (null and empty ones too) have no shingle and are found
nowhere; null, empty and short documents contain nothing; repeated items are reported each; the documents'
other columns pass through unread, and the output takes the place of a column of its name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbuf as tb
from .common import extend

HASHES = 40
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32_000_000
_BITS = np.uint32((1 << 18) - 1)
_rng = np.random.default_rng(1181783497276652981)
_A = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def _shingles(g: tb.Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    w = tb.words(g)
    h, _, off = tb.windows(w.hash, w.off, k)
    return h, off


def _offsets(count: np.ndarray) -> np.ndarray:
    out = np.zeros(len(count) + 1, np.int64)
    np.cumsum(count, out=out[1:])
    return out


class Partition:
    """Items of one size range: their minima, ready to be looked up."""

    def __init__(self, block: int, numbers: np.ndarray, minima: np.ndarray):
        self.block = block
        order = np.argsort(minima, axis=1)
        self.minima = np.take_along_axis(minima, order, axis=1)      # a row per hash, ascending
        self.items = numbers[order]
        self.maybe = np.zeros((HASHES, int(_BITS) + 1), bool)
        for j in range(HASHES):
            self.maybe[j, self.minima[j] & _BITS] = True


class Index:
    """Test items by size; those that repeat shingles by their shingles."""

    def __init__(self, texts: list[str | None], k: int, percent: int = 80):
        self.k, self.sets, sizes = k, [], []
        for g in tb.groups(pa.array(texts, pa.string())):
            h, off = _shingles(g, k)
            self.sets += [np.unique(h[s:e]) for s, e in zip(off, off[1:])]
            sizes += np.diff(off).tolist()
        again = np.array([n != len(x) for n, x in zip(sizes, self.sets)], bool)
        level = np.where(again, -1, np.array([int(n).bit_length() - 1 for n in sizes], int))
        # of d shingles, a container lacks at most d less the needed ones
        asked = [(i, self.sets[i][: len(self.sets[i]) + 1 - -(-percent * len(self.sets[i]) // 100)]) for i in np.flatnonzero(again)]
        self.asked = np.concatenate([np.empty(0, np.uint64), *[x for _, x in asked]])
        self.asker = np.concatenate([np.empty(0, np.int64), *[np.full(len(x), i) for i, x in asked]])
        order = np.argsort(self.asked, kind="stable")
        self.asked, self.asker = self.asked[order], self.asker[order]
        self.partitions = []
        for c in sorted(set(level[level >= 0].tolist())):
            mine = np.flatnonzero(level == c)
            low = [(self.sets[i] >> np.uint64(32)).astype(np.uint32) for i in mine]
            minima = np.array([[int((x * a + b).min()) for x in low] for a, b in zip(_A, _B)], np.uint32)
            self.partitions.append(Partition(2**c, mine, minima))

    def askers(self, h: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
        """``(document, item)`` rows of the items that ask for a shingle of the document."""
        lo, hi = (np.searchsorted(self.asked, h, side) for side in ("left", "right"))
        doc = tb.segment(off)
        return [(doc[p], i) for p in np.flatnonzero(lo < hi) for i in self.asker[lo[p]: hi[p]]]

    def candidates(self, h: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Distinct ``(document, item)`` rows whose window and item share a minimum, or an asked shingle."""
        found = self.askers(h, off)
        if not self.partitions:
            return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)
        x = (h >> np.uint64(32)).astype(np.uint32)
        size = self.partitions[0].block
        blocks = -(-np.diff(off) // size)
        boff = _offsets(blocks)
        doc = tb.segment(boff)
        # column: a block of the finest partition; a document's last block repeats its last shingle
        begin = off[doc] + (np.arange(boff[-1]) - boff[doc]) * size
        x = x[np.minimum(begin + np.arange(size)[:, None], off[doc + 1] - 1)]
        levels, top = [], self.partitions[-1].block
        by_size = {p.block: p for p in self.partitions}
        while True:
            # documents of fewer than three blocks are a window of their own
            few = np.flatnonzero(blocks < 3)
            levels.append((by_size.get(size), doc, few, boff[few], boff[few + 1] - 1))
            if size >= top:
                break
            finer, size, blocks = boff, size * 2, -(-blocks // 2)
            boff = _offsets(blocks)
            doc = tb.segment(boff)
            left = finer[doc] + (np.arange(boff[-1]) - boff[doc]) * 2
            levels.append((left, np.minimum(left + 1, finer[doc + 1] - 1)))
        for j in range(HASHES):
            low = (x * _A[j] + _B[j]).min(axis=0)
            for level in levels:
                if len(level) == 2:
                    low = np.minimum(low[level[0]], low[level[1]])
                    continue
                p, doc, few, begin, last = level
                if p is None:
                    continue
                least = np.minimum(low[:-1], low[1:])
                least = np.minimum(least[:-1], low[2:])
                for values, docs in ((least, doc), (np.minimum(low[begin], low[last]), few)):
                    at = np.flatnonzero(p.maybe[j][values & _BITS])
                    lo, hi = (np.searchsorted(p.minima[j], values[at], side) for side in ("left", "right"))
                    for w in np.flatnonzero(lo < hi):
                        found += [(docs[at[w]], i) for i in p.items[j, lo[w]: hi[w]]]
        return np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0)

    def search(self, g: tb.Group, percent: int) -> list[tuple[int, int, int]]:
        """``(document, item, common shingles)`` of the items contained in the group's documents."""
        h, off = _shingles(g, self.k)
        if not len(h):
            return []
        # documents without a shingle have no block
        some = np.flatnonzero(np.diff(off))
        pairs = self.candidates(h, np.append(off[some], off[-1]))
        out, last, own = [], -1, None
        for d, i in pairs:
            if d != last:
                last, own = d, np.unique(h[off[some[d]]: off[some[d] + 1]])
            item = self.sets[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            common = int((own[at] == item).sum())
            if 100 * common >= percent * len(item):
                out.append((int(some[d]), int(i), common))
        return out


def contained(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
              k: int = 5, percent: int = 80, out: str = "leaks") -> DataFrame:
    """``docs`` with ``out``: an array of ``(item_id, n_shingles, n_common)`` for every item of which at least
    ``percent`` hundredths of the distinct ``k``-word shingles occur in the document."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    leak = T.ArrayType(T.StructType([T.StructField("item_id", kind), T.StructField("n_shingles", T.LongType()), T.StructField("n_common", T.LongType())]))
    asked = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    many = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("c")).first()
    blocks = max(1, -(-many["n"] // BLOCK_ITEMS), -(-many["c"] // BLOCK_CHARS))
    done = docs.withColumn(out, F.array().cast(leak))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        rows.sort(key=lambda r: (r["i"] is None, r["i"], r["t"]))
        shared = spark.sparkContext.broadcast(([r["i"] for r in rows], Index([r["t"] for r in rows], k, percent)))

        def compute(b: pa.RecordBatch, shared=shared) -> list:
            names, index = shared.value
            got: list[list] = b.column(out).to_pylist() if blocks > 1 else [[] for _ in range(b.num_rows)]
            for g in tb.groups(b.column(text), 1 << 19):
                for d, i, c in index.search(g, percent):
                    got[g.first + d].append({"item_id": names[i], "n_shingles": len(index.sets[i]), "n_common": c})
            return [pa.array(got, b.schema.field(out).type)]

        done = extend(done, "decontam", text, [T.StructField(out, leak)], compute)
    return done
