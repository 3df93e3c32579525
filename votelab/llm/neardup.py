"""Near-duplicate documents: MinHash with banding, signature verification, exact confirmation, components.

1. A text's set is its distinct shingles (runs of ``k`` words; fewer words: the whole sequence as one; none:
   empty, linked with nothing). One pass gives the set's size, a 128-bit fingerprint, band keys over many
   universal-hash minima, and a signature of two bits of each minimum.
2. Documents of equal sets form a class, and only its smallest document goes on.
3. Within each bucket (equal band key) every class is paired with the bucket's smallest one. Pairs whose sizes
   and signatures allow the wanted similarity are confirmed on the full sets, and confirmed links give
   components. So a large group costs a pair for each member and not for each two.
4. Buckets that still span several components are searched again, block by block, for pairs across components;
   after that no pair that shares a bucket is left unexamined, so no link is lost by step 3.
5. Components are the smallest document reachable, by alternating large-star and small-star.

With ``bands`` x ``rows`` = 25 x 5 a pair at the limit of 0.85 shares no bucket with probability 4e-7.

Defined results: null and empty texts have an empty set and are kept; rows without an id are linked with
nothing and kept; rows that share an id are one node; ties go to the smaller id; input columns other than id
and text are ignored, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import dropped, pieces, prepare, worker_cache, written
from .components import components

BANDS, ROWS = 25, 5
MINIMA = 640                   # the first BANDS * ROWS of them make band keys, all of them the signature
_WORDS = MINIMA // 64          # 64-bit words of one bit of each minimum
#: Signature columns: the words of the minima's first bits, then of their second bits. As plain columns they are
#: compared within one small compiled expression.
BITS = [f"b{i}" for i in range(2 * _WORDS)]
BLOCK = 1_000                  # members of a bucket that meet as a block
#: A table of at most so many ids (8 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_IDS = 500_000
_rng = np.random.default_rng(88172645463325252)
_A = _rng.integers(0, 2**31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, MINIMA, dtype=np.uint32)


def shingle_sets(g: tb.Group, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and their offsets."""
    w = tb.words(g)
    h, _, off = tb.windows(w.hash, w.off, k)
    count = np.diff(w.off)
    out, size = [], np.zeros(len(count), np.int64)
    for i, n in enumerate(count):
        if n >= k:
            x = np.sort(h[off[i]: off[i + 1]])
            if len(x) > 1:
                x = x[np.append(True, x[1:] != x[:-1])]
        elif n:
            x = tb.windows(w.hash[w.off[i]: w.off[i + 1]], np.array([0, n]), int(n))[0] + np.uint64(n)
        else:
            continue
        out.append(x)
        size[i] = len(x)
    off = np.zeros(len(count) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), off


def minima(sets: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Minima of the universal hashes (a row per hash, a column per non-empty set)."""
    x, start = (sets >> np.uint64(32)).astype(np.uint32), off[:-1][np.diff(off) > 0]
    out = np.empty((len(_A), len(start)), np.uint32)
    y = np.empty_like(x)
    for j in range(len(_A)):
        np.multiply(x, _A[j], out=y)
        y += _B[j]
        np.minimum.reduceat(y, start, out=out[j])
    return out


def _describe(g: tb.Group, k: int) -> dict[str, np.ndarray]:
    sets, off = shingle_sets(g, k)
    size = np.diff(off)
    some = np.flatnonzero(size)
    n = len(size)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    keys, bits = np.zeros((n, BANDS), np.uint64), np.zeros((n, 2 * _WORDS), np.uint64)
    if len(some):
        one[some] = np.add.reduceat(tb.mix(sets), off[some])
        two[some] = np.add.reduceat(tb.mix(sets * tb.BASE), off[some])
        m = minima(sets, off).astype(np.uint64)
        for b in range(BANDS):
            key = np.full(m.shape[1], b + 1, np.uint64)
            for r in range(ROWS):
                key = key * tb.BASE + m[b * ROWS + r]
            keys[some, b] = tb.mix(key)
        for j in range(MINIMA):
            for k in (0, 1):
                bits[some, k * _WORDS + j // 64] |= ((m[j] >> np.uint64(9 + k)) & np.uint64(1)) << np.uint64(j % 64)
    return {"n": size, "f1": one.view(np.int64), "f2": two.view(np.int64), "bits": bits.view(np.int64), "keys": keys.view(np.int64)}


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``(id, n, f1, f2, *BITS, keys)`` of every row of ``docs (id, text)``: set size, fingerprint, signature, band keys."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("neardup")
        for b in pieces(batches, "text"):
            at = 0
            for g in tb.groups(b.column("text"), 1 << 18):
                d = _describe(g, k)
                rows = len(d["n"])
                keys = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(d["keys"].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, rows), *[pa.array(d[c]) for c in ("n", "f1", "f2")],
                     *[pa.array(np.ascontiguousarray(d["bits"][:, i])) for i in range(len(BITS))], keys],
                    ["id", "n", "f1", "f2", *BITS, "keys"])
                at += rows

    return docs.mapInArrow(make, f"id long, n long, f1 long, f2 long, {', '.join(f'{c} long' for c in BITS)}, keys array<long>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """``(id, f1, set)``: fingerprint and packed set of every row of ``docs (id, text)``."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            at = 0
            for g in tb.groups(b.column("text"), 1 << 18):
                sets, off = shingle_sets(g, k)
                rows = len(off) - 1
                one = [int(tb.mix(sets[s:e]).sum(dtype=np.uint64)) for s, e in zip(off, off[1:])]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id").slice(at, rows), pa.array(np.array(one, np.uint64).view(np.int64)),
                     pa.array([sets[s:e].tobytes() for s, e in zip(off, off[1:])], pa.binary())], ["id", "f1", "set"])
                at += rows

    return docs.mapInArrow(make, "id long, f1 long, set binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, fa, b, fb)`` whose full sets are similar enough, as edges ``(a, b)``."""
    side = lambda x: sets.select(F.col("id").alias(x), F.col("f1").alias(f"f{x}"), F.col("set").alias(f"set{x}"))
    joined = pairs.select("a", "fa", "b", "fb").join(side("a"), ["a", "fa"]).join(side("b"), ["b", "fb"]).select("a", "b", "seta", "setb")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "seta", 1 << 20):
            good = []
            for x, y in zip(b.column("seta").to_pylist(), b.column("setb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (len(both) - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(make, "a long, b long")


def _plausible(x: str, y: str, percent: int):
    """Whether sizes and signatures allow the wanted similarity."""
    differ = F.lit(0)
    for one, two in zip(BITS[:_WORDS], BITS[_WORDS:]):
        first, second = (F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}")) for c in (one, two))
        differ = differ + F.bit_count(first.bitwiseOR(second))
    sizes = 100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (differ <= _most_different(percent))


def _most_different(percent: int, sigmas: float = 4.5) -> int:
    """So many minima may differ in a bit where the wanted similarity holds: equal minima agree in both bits, others by
    chance in a quarter of the cases."""
    p = percent / 100 + (1 - percent / 100) / 4
    return int(np.ceil(MINIMA * (1 - p) + sigmas * np.sqrt(MINIMA * p * (1 - p))))


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, fa, b, fb)`` of classes that share a bucket, lie in different components and may be similar.

    A bucket of m members is cut into blocks of about BLOCK by a hash; a task compares two blocks (or one with
    itself) by sizes and signatures, as numpy rows, and gives out only the pairs that pass, each in the first
    bucket that the two share. So no bucket meets in one task and no pair of a group becomes a row unless it is
    plausible."""
    most = _most_different(percent)
    wide = rest.groupBy("key").agg(F.count("*").alias("m")).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("rep", "f1"), F.col("blocks").cast("long")).cast("int")
    dealt = rest.join(wide, "key").withColumn("block", mine)
    # each block meets every block of its bucket, itself included
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))

    def passing(x: dict, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for r in i.tolist():
            c = j[j > r] if i is j else j
            c = c[(x["part"][c] != x["part"][r]) & (100 * np.minimum(x["n"][c], x["n"][r]) >= percent * np.maximum(x["n"][c], x["n"][r]))]
            if len(c):
                z = x["bits"][c] ^ x["bits"][r]
                differ = np.bitwise_count(z[:, :_WORDS] | z[:, _WORDS:]).sum(axis=1, dtype=np.int64)
                c = c[differ <= most]
            if len(c):
                shared = x["keys"][c] == x["keys"][r]
                c = c[x["keys"][r][shared.argmax(axis=1)] == x["key"][r]]
                out += [(r, int(k)) for k in c]
        return out

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("neardup")
        kept = None
        for b in chain(batches, [None]):
            if b is not None:
                t = pa.Table.from_batches([b])
                kept = t if kept is None else pa.concat_tables([kept, t])
            if kept is None or not kept.num_rows:
                continue
            x = {c: kept.column(c).to_numpy() for c in ("key", "lo", "hi", "block", "rep", "f1", "n", "part")}
            new = np.append(True, (x["key"][1:] != x["key"][:-1]) | (x["lo"][1:] != x["lo"][:-1]) | (x["hi"][1:] != x["hi"][:-1]))
            start = np.flatnonzero(new)
            end = np.append(start[1:], kept.num_rows)
            whole = len(start) if b is None else len(start) - 1       # the last group may go on
            x["bits"] = np.stack([kept.column(c).to_numpy() for c in BITS], axis=1).view(np.uint64)
            x["keys"] = np.asarray(kept.column("keys").combine_chunks().flatten()).reshape(-1, BANDS)
            found = []
            for s, e in zip(start[:whole].tolist(), end[:whole].tolist()):
                rows = np.arange(s, e)
                if x["lo"][s] == x["hi"][s]:
                    found += passing(x, rows, rows)
                else:
                    first = x["block"][s:e] == x["lo"][s]
                    found += passing(x, rows[first], rows[~first])
            at = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[c][at[:, k]]) for k in (0, 1) for c in ("rep", "f1")], ["a", "fa", "b", "fb"])
            kept = kept.slice(int(start[whole])) if whole < len(start) else None

    groups = ["key", "lo", "hi"]
    return dealt.repartition(*groups).sortWithinPartitions(*groups).mapInArrow(make, "a long, fa long, b long, fb long")


def link(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, percent: int = 85) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` of every row: documents are linked when their sets'
    intersection is at least ``percent`` hundredths of their union."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    described = written(signatures(rows, k), "neardup-signatures")
    class_key = ["f1", "f2", "n"]
    named = described.where("n > 0 and id is not null")
    classes = written(named.groupBy(*class_key).agg(F.min("id").alias("rep")), "neardup-classes")
    reps = (named.withColumnRenamed("id", "rep").join(classes, [*class_key, "rep"], "left_semi").dropDuplicates([*class_key, "rep"]))

    # members of buckets with at least two classes
    keyed = reps.select("rep", "f1", F.explode("keys").alias("key"))
    # written, so that the join below reads two plain shuffles, of which Spark can split the skewed partitions
    hubs = written(keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("many")).where("many > 1").select("key", "hub"),
                   "neardup-hubs")
    members = written(keyed.join(hubs, "key"), "neardup-members")
    dropped(hubs)
    ids = written(members.select(F.col("rep").alias("id")).distinct(), "neardup-ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = written(_sets(rows.join(wanted, "id", "left_semi"), k).distinct(), "neardup-sets")

    # each member with its bucket's smallest class
    one = written(reps.select("rep", "n", "f1", *BITS, "keys").join(members.select("rep", "f1").distinct(), ["rep", "f1"], "left_semi"), "neardup-reps")
    star = members.where("rep <> hub").select("rep", "hub").distinct()
    near = (star.join(one.alias("x"), F.col("x.rep") == star["rep"]).join(one.alias("y"), F.col("y.rep") == F.col("hub"))
            .where(_plausible("x", "y", percent))
            .select(F.col("x.rep").alias("a"), F.col("x.f1").alias("fa"), F.col("y.rep").alias("b"), F.col("y.f1").alias("fb")))
    # rows that share an id tie their classes together
    shared = (named.join(classes, class_key).groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b")
              .select("id", "a"))
    tied = shared.join(named.join(classes, class_key).select("id", F.col("rep").alias("b")), "id").select("a", "b").where("a <> b")
    edges = written(_confirm(near, sets, percent).unionByName(tied), "neardup-edges")
    first = written(components(edges), "neardup-components")
    dropped(ids, edges)

    # what buckets still hold across components
    placed = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    rest = written(placed.join(mixed, "key", "left_semi").select("key", "rep", "f1", "part").join(one, ["rep", "f1"]), "neardup-rest")
    more = written(_confirm(_across(rest, percent), sets, percent), "neardup-more")
    parts = first if more.isEmpty() else written(
        components(more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b")))), "neardup-final")

    classed = written(described.select("id", *class_key), "neardup-classed")
    dropped(described, members, sets, one, rest, more, *([] if parts is first else [first]))
    best = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select(*class_key, F.coalesce("component", "rep").alias("component_id"))
    out = classed.join(best, class_key, "left")
    own = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
