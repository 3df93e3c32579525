r"""Phrase collocation mining with count transducers.

Texts are lower-cased (A-Z), split at ``[.,;:!?\x0A-\x0D]`` into pieces and those into words ``[^\x20\x09]+``. Phrases
of one length after the other are counted: each task adds its blocks of sorted phrases to a transducer
(``automata.py``), cuts it by prefix range, and the slices of a range are united, their weights summed. A phrase can
only be frequent if its first and last words but one are, so a bit map of the frequent phrases of one length thins
the next: hash collisions in it let more through and never lose an occurrence. The parts of every candidate are
phrases of the same transducers: their paths are routed to the range that holds them, composed with its transducer,
and the weights return to the candidate. Scores use integers of any size.

A candidate inside a longer one of the same count needs only be sought in those one word longer, as counts never
rise from a phrase to one around it.

Defined results: null or empty texts have no words, a null language is ``und``; rows count each for itself, ids
aren't read; ties in score and count go by the phrase's bytes; an empty table or one without frequent phrases gives
no rows; other input columns are ignored, and the result has its own columns only. Very long texts are whole: a
phrase may lie anywhere in them.
Memory: a task keeps up to ``STATES`` phrases before it sends them on; a range holds about ``RANGE_BYTES`` of text;
with more than ``FAN`` ranges, slices unite in rounds of ``FAN`` ranges each, and a round's groups are salted to the
same size. The bit map has at most 2^``MAP_BITS`` bits. Words are told apart by 64-bit hashes within a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import automata as am
from . import textbuf as tb
from .common import pieces, prepare, written

RANGE_BYTES = 16 << 20
FAN = 1024
STATES = 4 << 20
SLICE = 1 << 17          # frequent phrases of one length in a slice for the part look-ups, about
MAP_BITS = 27

_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[[0x20, 9]] = True
_INSIDE = ~(_BREAK | _GAP)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def split(g: tb.Group) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, hash)`` of the words of a group of texts, where each piece's words start (one more than
    pieces), and each piece's document."""
    n, off = len(g.data), g.off
    inside = _INSIDE[g.data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = off[(off > 0) & (off < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(off, start, side="right") - 1
    broken = np.searchsorted(np.flatnonzero(_BREAK[g.data]), start)
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (broken[1:] != broken[:-1])
    at = np.flatnonzero(new)
    return start, end, tb.span_hashes(g.data, start, end, tb.LOWER_CODE), np.append(at, len(start)), doc[at]


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The lower-cased byte spans as a binary array."""
    size = end - start
    off = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=off[1:])
    at = np.arange(off[-1]) + np.repeat(start - off[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(_LOWER[data[at]].tobytes())])


def block(g: tb.Group, langs: pa.Array, lang_of: np.ndarray, length: int, seen: np.ndarray | None) -> am.Automaton | None:
    """The transducer of the phrases of ``length`` words in a group of texts, of those whose parts of one word less
    are ``seen`` in the bit map."""
    if not len(g.data):
        return None
    start, end, h, off, doc = split(g)
    lang = am.hashes(langs)[lang_of[g.first + doc]]
    wh, at, woff = tb.windows(h, off, length)
    piece = tb.segment(woff)
    if seen is not None:
        ph, pat, poff = tb.windows(h, off, length - 1)
        slot = am.gram_hashes(ph, lang[tb.segment(poff)]) & np.uint64(64 * len(seen) - 1)
        ok = np.zeros(len(h) + 1, bool)
        ok[pat] = (seen[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)
        keep = np.flatnonzero(ok[at] & ok[at + 1])
        wh, at, piece = wh[keep], at[keep], piece[keep]
    if not len(at):
        return None
    _, row, count = np.unique(am.gram_hashes(wh, lang[piece]), return_index=True, return_counts=True)
    at, piece = at[row], piece[row]
    word, row, label = np.unique(h[at[:, None] + np.arange(length)], return_index=True, return_inverse=True)
    one = (at[:, None] + np.arange(length)).ravel()[row]
    words, rank = am.sorted_labels(_texts(g.data, start[one], end[one]))
    label = rank[label].reshape(len(at), length)
    return am.build(langs, words, [lang_of[g.first + doc[piece]], *label.T], count)


_BLOB = "part long, salt long, blob binary"


def _rows(slices, salt: int) -> Iterator[pa.RecordBatch]:
    for part, a in slices:
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([salt]), pa.array([a.dumps()], pa.binary())], ["part", "salt", "blob"])


def shards(docs: DataFrame, length: int, seen, ranges: int, salts: int) -> DataFrame:
    """Each task's transducer of the phrases of one length, cut by prefix range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if seen is None else seen.value
        salt = TaskContext.get().partitionId() % salts
        whole, fresh, waiting = None, [], 0
        for b in pieces(batches, "text"):
            langs, lang_of = am.sorted_labels(b.column("lang").cast(pa.binary()))
            for g in tb.groups(b.column("text")):
                a = block(g, langs, lang_of, length, bits)
                if a is None:
                    continue
                fresh.append(a)
                waiting += len(a.label[-1])
                if waiting > max(1 << 19, len(whole.label[-1]) if whole else 0):
                    whole, fresh, waiting = am.union([*([whole] if whole else []), *fresh]), [], 0
                    if len(whole.label[-1]) > STATES:
                        yield from _rows(am.parts(whole, ranges), salt)
                        whole = None
        if whole or fresh:
            yield from _rows(am.parts(am.union([*([whole] if whole else []), *fresh]), ranges), salt)

    return docs.mapInArrow(run, _BLOB)


def _table(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)


def counted(docs: DataFrame, length: int, seen, ranges: int, least: int) -> DataFrame:
    """``(level, part, blob, size)``: the frequent phrases of one length by prefix range; with length 1, also the
    number of words of each language, as paths without words (level 0)."""
    fans = [min(ranges, FAN)]
    while fans[-1] < ranges:
        fans.append(min(ranges, fans[-1] * FAN))
    blobs = shards(docs, length, seen, fans[0], -(-ranges // fans[0]))

    def unite(fan: int, salts: int):
        def run(t: pa.Table) -> pa.Table:
            whole = am.union([am.loads(b) for b in t["blob"].to_pylist()])
            rows = [(p, (7919 * t["part"][0].as_py() + t["salt"][0].as_py()) % salts, a.dumps()) for p, a in am.parts(whole, fan)]
            return _table(rows, ["part", "salt", "blob"], [pa.int64(), pa.int64(), pa.binary()])
        return run

    def finish(t: pa.Table) -> pa.Table:
        part, whole, rows = t["part"][0].as_py(), am.union([am.loads(b) for b in t["blob"].to_pylist()]), []
        if length == 1:
            total = np.zeros(len(whole.label[0]), np.int64)
            np.add.at(total, whole.parent[1], whole.weight[1])
            rows += [(0, p, a.dumps(), len(a.label[-1])) for p, a in am.parts(whole, ranges, am.paths(whole, 0), total)]
        kept = am.frequent(whole, least)
        if len(kept.label[-1]):
            rows.append((length, part, kept.dumps(), len(kept.label[-1])))
        return _table(rows, ["level", "part", "blob", "size"], [pa.int32(), pa.int64(), pa.binary(), pa.int64()])

    for fan in fans[1:]:
        blobs = blobs.repartition(ranges, "part", "salt").groupBy("part", "salt").applyInArrow(unite(fan, -(-ranges // fan)), _BLOB)
    return blobs.repartition(ranges, "part").groupBy("part").applyInArrow(finish, "level int, part long, blob binary, size long")


def bit_map(found: DataFrame, level: int, size: int):
    """A broadcast bit map of the hashes of one level's phrases, at most 2^``MAP_BITS`` bits."""
    bits = min(MAP_BITS, max(16, math.ceil(math.log2(16 * size))))
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                a = am.loads(blob)
                h = am.phrase_hashes(a, am.paths(a)) & mask
                slot, at = np.unique(h >> np.uint64(6), return_inverse=True)
                word = np.zeros(len(slot), np.uint64)
                np.bitwise_or.at(word, at, np.uint64(1) << (h & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(word.view(np.int64))], ["slot", "word"])

    t = (found.where(F.col("level") == level).select("blob").mapInArrow(run, "slot long, word long")
         .groupBy("slot").agg(F.bit_or("word").alias("word")).toArrow())
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[t["slot"].to_numpy()] = t["word"].to_numpy().view(np.uint64)
    return found.sparkSession.sparkContext.broadcast(out)


def transducers(df: DataFrame, least: int = 100, max_words: int = 5, text: str = "text", lang: str = "lang",
                range_bytes: int = RANGE_BYTES, slice_size: int = SLICE) -> tuple[DataFrame, dict[int, tuple[int, int]], int]:
    """``(level, part, blob)``, the transducers of all frequent phrases by level (their number of words) and part;
    the phrases and parts of each level; and the number of ranges that parts are coarsened from."""
    spark = df.sparkSession
    prepare(spark)
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = max(1, -(-size // range_bytes))
    seen, levels, tables = None, {}, []
    for length in range(1, max_words + 1):
        found = written(counted(docs, length, seen, ranges, least), f"phrases-{length}")
        sizes = {r["level"]: r["n"] for r in found.groupBy("level").agg(F.sum("size").alias("n")).collect()}
        levels |= {k: (n, min(ranges, -(-n // slice_size))) for k, n in sizes.items()}
        tables.append(found)
        if seen is not None:
            seen.unpersist()
        if length not in sizes or length == max_words:
            break
        seen = bit_map(found, length, sizes[length])
    coarse = F.expr("CASE level " + " ".join(f"WHEN {k} THEN part * {p} div {ranges}" for k, (_, p) in levels.items()) + " END") \
        if levels else F.lit(None).cast("long")

    def unite(t: pa.Table) -> pa.Table:
        whole = am.union([am.loads(b) for b in t["blob"].to_pylist()])
        return _table([(t["level"][0].as_py(), t["part"][0].as_py(), whole.dumps())], ["level", "part", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    every = every.select("level", coarse.alias("part"), "blob").groupBy("level", "part").applyInArrow(unite, "level int, part long, blob binary")
    return written(every, "phrases-levels"), levels, ranges


def _cuts(cols: list[np.ndarray]):
    """``(words in the first part, first part, rest)`` of paths, for each cut."""
    for k in range(1, len(cols) - 1):
        yield k, cols[: k + 1], [cols[0], *cols[k + 1:]]


def scored(counts: DataFrame, levels: dict[int, tuple[int, int]], ranges: int, percent: int = 100) -> DataFrame:
    """``(lang, phrase, mark, a, l, r, n, score)``: a row for each candidate, and one with ``mark`` for each phrase
    that a candidate one word longer covers."""
    candidates = counts.where("level >= 2")
    spread = {k: p for k, (_, p) in levels.items()}

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, part, blob in zip(*[b.column(c).to_pylist() for c in ("level", "part", "blob")]):
                a = am.loads(blob)
                cols = am.paths(a)
                wanted = {0: [cols[:1]]}
                for _, first, rest in _cuts(cols):
                    for p in (first, rest):
                        wanted.setdefault(len(p) - 1, []).append(p)
                for words, lists in wanted.items():
                    p = [np.concatenate(x) for x in zip(*lists)]
                    q = am.taken(a, p, np.zeros(len(p[0]), np.int64))
                    q_cols = am.paths(q)
                    where = am.prefix_range(q, q_cols, ranges) * spread[words] // ranges
                    for to in np.unique(where):
                        own = am.taken(q, [c[where == to] for c in q_cols], np.zeros(int((where == to).sum()), np.int64))
                        yield pa.RecordBatch.from_pydict({"level": pa.array([words], pa.int32()), "part": [int(to)], "from_level": pa.array([level], pa.int32()),
                                                          "from_part": [part], "paths": pa.array([own.dumps()], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, part, blob, asked in zip(*[b.column(c).to_pylist() for c in ("from_level", "from_part", "blob", "paths")]):
                q = am.loads(asked)
                cols = am.paths(q)
                q = am.taken(q, cols, am.compose(q, cols, am.loads(blob)))
                yield pa.RecordBatch.from_pydict({"level": pa.array([level], pa.int32()), "part": [part], "own": [False], "blob": pa.array([q.dumps()], pa.binary())})

    def score(t: pa.Table) -> pa.Table:
        own = t["own"].to_pylist()
        blobs = t["blob"].to_pylist()
        a = am.loads(blobs[own.index(True)])
        known = am.union([am.loads(b) for b, o in zip(blobs, own) if not o])
        cols, f = am.paths(a), a.weight[-1]
        n, length, covered = am.compose(a, cols[:1], known), len(cols) - 1, []
        best = np.zeros((len(f), 3), np.int64)
        for k, first, rest in _cuts(cols):
            le, r = am.compose(a, first, known), am.compose(a, rest, known)
            s = (1000 * f.astype(object) * n // (le.astype(object) * r)).astype(np.int64)
            now = s < best[:, 0] if k > 1 else np.ones(len(s), bool)
            best[now] = np.stack([s, le, r], axis=1)[now]
            covered += [(p, w) for p, w in ((first, le), (rest, r)) if len(p) == length > 2]
        out = [_phrases(a, cols, {"mark": np.zeros(len(f), bool), "a": f, "l": best[:, 1], "r": best[:, 2], "n": n, "score": best[:, 0]})]
        for p, w in covered:
            inside = np.flatnonzero(100 * f >= percent * w)
            zero = np.zeros(len(inside), np.int64)
            out.append(_phrases(a, [c[inside] for c in p], {"mark": zero == 0, **{c: zero for c in ("a", "l", "r", "n", "score")}}))
        return pa.concat_tables(out)

    asked = candidates.mapInArrow(ask, "level int, part long, from_level int, from_part long, paths binary")
    answers = (written(asked, "phrases-asked").join(counts, ["level", "part"]).select("from_level", "from_part", "blob", "paths")
               .mapInArrow(answer, "level int, part long, own boolean, blob binary"))
    both = candidates.select("level", "part", F.lit(True).alias("own"), "blob").unionByName(answers)
    return both.groupBy("level", "part").applyInArrow(score, "lang string, phrase string, mark boolean, a long, l long, r long, n long, score long")


def _phrases(a: am.Automaton, cols: list[np.ndarray], values: dict[str, np.ndarray]) -> pa.Table:
    said = pc.binary_join_element_wise(*[a.words.take(pa.array(c)) for c in cols[1:]], b" ")
    return pa.table({"lang": a.langs.take(pa.array(cols[0])).cast(pa.string()), "phrase": said.cast(pa.string()), **values})


def mine(df: DataFrame, least: int = 100, max_words: int = 5, percent: int = 100, limit: int = 2000, text: str = "text",
         lang: str = "lang", range_bytes: int = RANGE_BYTES, slice_size: int = SLICE) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``limit`` phrases of 2 to ``max_words``
    words that stand ``least`` times or more, by score, count and bytes, without those inside a longer one that has
    at least ``percent`` of their count."""
    counts, levels, ranges = transducers(df, least, max_words, text, lang, range_bytes, slice_size)
    rows = written(scored(counts, levels, ranges, percent), "phrases-scored")
    covered = rows.where("mark").select("lang", "phrase").distinct()
    left = rows.where("not mark").join(covered, ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salts = -(-sum(n for k, (n, _) in levels.items() if k > 1) // 50_000)
    if salts > 1:       # a language's phrases are ranked in shares first
        share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
        left = left.withColumn("rank", F.row_number().over(share)).where(F.col("rank") <= limit)
    left = left.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return left.where(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
