"""Language-model scores from a log-bilinear neural model trained with noise-contrastive estimation.

Tokens are lower-cased words (A-Z) and one end token a text. The most frequent training words are classes of
their own beside the end token; all other words fall in classes by a hash of their last two bytes. The model gives a class, after the two
classes before it, the score ``(left[c1] + near[c2]) . target[w] + bias[w]``; it is trained in numpy against
noise classes drawn from the unigram distribution. Because the exponential of the score factors into a part of
each context class, all normalisers are one matrix product, so every reported probability is normalised. A word
of a shared class further pays its smoothed share among the words of that class.

Work on the corpus: texts are tokenised once into blocks of a few MB (distinct words, and the tokens as places
among them), written as a table; counts of all training words are one aggregate over the blocks' distinct
words, and go back to the blocks by a join. Training starts from a bounded sample of blocks and then passes
over all blocks in parallel, each task from the same start; the tasks' parameters are averaged by tokens.

Defined results: a null or empty text is one end token; without training rows every word is unknown; rows
without an id are scored and belong to no fold, so they aren't trained on; repeated rows each count and are
scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbuf as tb
from .common import pieces, prepare, worker_cache, written

CLASSES, WIDTH = 2048, 16
BLOCK_BYTES = 6 << 20
NOISE, BATCH, RATE = 24, 4096, 0.1
SAMPLE_TOKENS, SAMPLE_PASSES = 1_500_000, 3
END_WORD = np.uint64(0x454E445F574F5244)      # the end token's place among word hashes
_END, _OTHER, ENDINGS = 0, 1, 64               # classes 1 to 64 are shared by the other words


def blocks(docs: DataFrame) -> DataFrame:
    """Blocks of ``docs (id, text, train)``: ``block``, the documents' ``ids``, ``train`` flags and token bounds
    ``off``, the distinct ``words`` (the block's most frequent first) with their counts ``n`` in training texts,
    and all ``tokens`` as places among them, packed."""
    def pack(number: int, ids: list, train: list, sizes: list, hashes: list) -> pa.RecordBatch:
        off = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(sizes, out=off[1:])
        words, tokens, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")         # small places for frequent words pack well
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words, tokens = words[order], place[tokens]
        flags = np.repeat(np.array(train, bool), sizes)
        counts = np.bincount(tokens[flags], minlength=len(words)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([ids], pa.list_(pa.int64())), pa.array([train], pa.list_(pa.bool_())),
             _one_list(off), _one_list(words.view(np.int64)), _one_list(counts),
             pa.array([_pack(tokens)], pa.binary())],
            ["block", "ids", "train", "off", "words", "n", "tokens"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("loglinear")
        number = TaskContext.get().partitionId() << 32
        ids, train, sizes, hashes, held = [], [], [], [], 0
        for b in pieces(batches, "text"):
            at = 0
            bid, btrain = b.column("id").to_pylist(), b.column("train").to_pylist()
            for g in tb.groups(b.column("text"), 1 << 18):
                w = tb.words(g)
                n = len(g.off) - 1
                key = w.hash & ~np.uint64(ENDINGS - 1) | _ending(g.data, w)
                # an end token after each document's words
                size = np.diff(w.off) + 1
                h = np.full(len(w.hash) + n, END_WORD)
                h[np.arange(len(w.hash)) + tb.segment(w.off)] = key
                ids += bid[at: at + n]
                train += [bool(t) for t in btrain[at: at + n]]
                sizes += size.tolist()
                hashes.append(h)
                held += len(g.data) + n
                at += n
                if held >= BLOCK_BYTES:
                    yield pack(number, ids, train, sizes, hashes)
                    number, ids, train, sizes, hashes, held = number + 1, [], [], [], [], 0
        if ids:
            yield pack(number, ids, train, sizes, hashes)

    return docs.mapInArrow(make, "block long, ids array<long>, train array<boolean>, off array<long>, words array<long>, n array<long>, tokens binary")


def _pack(tokens: np.ndarray) -> bytes:
    """Places as zstd-compressed byte planes, so that neither the table nor a shuffle holds their many zeros."""
    return pa.compress(np.ascontiguousarray(tokens.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _ending(data: np.ndarray, w: tb.Words) -> np.ndarray:
    """A code below ENDINGS of each word's last two bytes; it takes the place of the hash's last bits."""
    a = tb.LOWER_CODE[data[w.end - 1]] * tb.BASE + tb.LOWER_CODE[data[np.maximum(w.end - 2, w.start)]]
    return tb.mix(a) & np.uint64(ENDINGS - 1)


def _one_list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))


class Model:
    """Parameters, the classes' word hashes (ascending, with their class), and the corpus' counts."""

    def __init__(self, words: np.ndarray, classes: np.ndarray, size: int, unigram: np.ndarray, seed: int = 5):
        self.words, self.classes, self.size = words, classes, size
        rng = np.random.default_rng(seed)
        self.unigram = unigram
        self.others, self.kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)    # training tokens and words of the shared classes
        self.left, self.near, self.target = (rng.normal(0, 0.1, (size, WIDTH)).astype(np.float32) for _ in range(3))
        self.bias = np.log(unigram).astype(np.float32)

    def parameters(self) -> np.ndarray:
        return np.concatenate([self.left.ravel(), self.near.ravel(), self.target.ravel(), self.bias])

    def set_parameters(self, flat: np.ndarray) -> None:
        n = self.size * WIDTH
        self.left, self.near, self.target = (flat[i * n: (i + 1) * n].reshape(self.size, WIDTH).astype(np.float32) for i in range(3))
        self.bias = flat[3 * n:].astype(np.float32)

    def class_of(self, words: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        shared = _OTHER + (words & np.uint64(ENDINGS - 1)).astype(np.int64)
        return np.where(self.words[at] == words, self.classes[at], shared).astype(np.int32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(one, two, norm)``: a token's log probability is ``one[c1, w] + two[c2, w] - norm[c1, c2]``."""
        one = self.left @ self.target.T
        two = self.near @ self.target.T + self.bias
        a, b = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        norm = np.log(np.exp(one - a) @ np.exp(two - b).T) + a + b.T
        return one, two, norm


def contexts(classes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token; texts begin after end tokens."""
    near = np.empty_like(classes)
    near[1:] = classes[:-1]
    near[off[:-1]] = _END
    left = np.empty_like(classes)
    left[1:] = near[:-1]
    left[off[:-1]] = _END
    return left, near


def train_pass(m: Model, left: np.ndarray, near: np.ndarray, word: np.ndarray, state: list, rng, rate: float = RATE) -> None:
    """One pass of noise-contrastive estimation over the given tokens, in batches, with AdaGrad steps."""
    log_noise = np.log(NOISE * m.unigram).astype(np.float32)
    edges = np.cumsum(m.unigram)
    k = m.size
    for i in range(0, len(word), BATCH):
        a, b, w = left[i: i + BATCH], near[i: i + BATCH], word[i: i + BATCH]
        noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), k - 1)
        h = m.left[a] + m.near[b]
        tw, tn = m.target[w], m.target[noise]
        s = np.einsum("ij,ij->i", h, tw) + m.bias[w] - log_noise[w]
        z = h @ tn.T + (m.bias[noise] - log_noise[noise])
        gw = 1 / (1 + np.exp(np.minimum(s, 30)))                 # 1 - P(data)
        gn = -1 / (1 + np.exp(-np.maximum(z, -30)))
        dh = gw[:, None] * tw + gn @ tn
        for x, (param, at, grad) in enumerate(((m.left, a, dh), (m.near, b, dh))):
            _step(param, state[x], at, grad, k, rate)
        rows = np.concatenate([w, noise])
        _step(m.target, state[2], rows, np.concatenate([gw[:, None] * h, gn.T @ h]), k, rate)
        gb = np.bincount(rows, np.concatenate([gw, gn.sum(axis=0)]), k)
        state[3] += gb**2
        m.bias += (rate * gb / np.sqrt(state[3] + 1e-6)).astype(np.float32)


def _step(param, total, at, grad, k, rate) -> None:
    order = np.argsort(at, kind="stable")
    rows = at[order]
    begin = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    rows, g = rows[begin], np.add.reduceat(grad[order], begin, axis=0)
    total[rows] += g * g
    param[rows] += rate * g / np.sqrt(total[rows] + 1e-6)


def new_state(m: Model, start: float = 1.0) -> list:
    return [np.full((m.size, WIDTH), start, np.float32) for _ in range(3)] + [np.full(m.size, 10.0 * start)]


def _training_tokens(m: Model, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts and classes of a block's training tokens."""
    off = np.asarray(row["off"], np.int64)
    classes = m.class_of(np.asarray(row["words"], np.int64).view(np.uint64))[_unpack(row["tokens"], int(off[-1]))]
    left, near = contexts(classes, off)
    use = np.repeat(np.asarray(row["train"], bool), np.diff(off))
    return left[use], near[use], classes[use]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their number lists as arrays."""
    for b in batches:
        for i in range(b.num_rows):
            out = {}
            for c in b.schema.names:
                x = b.column(c)[i]
                out[c] = (None if not x.is_valid else x.values.to_numpy(zero_copy_only=False)
                          if pa.types.is_list(b.schema.field(c).type) and c != "ids" else x.as_py())
            yield out


def train(table: DataFrame, counts: DataFrame, total: int) -> Model:
    """The model over the blocks ``table``, given its training words' ``counts (word, c)``."""
    spark = table.sparkSession
    top = counts.where(F.col("word") != int(END_WORD.view(np.int64))).orderBy(F.desc("c"), "word").limit(CLASSES - 1 - ENDINGS).collect()
    ends = counts.where(F.col("word") == int(END_WORD.view(np.int64))).collect()
    words = np.array([END_WORD, *(np.int64(r["word"]).view(np.uint64) for r in top)], np.uint64)
    tokens, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in (counts.where(F.col("word") != int(END_WORD.view(np.int64))).groupBy(F.col("word").bitwiseAND(ENDINGS - 1).cast("int").alias("e"))
              .agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()):
        tokens[r["e"]], kinds[r["e"]] = r["c"], r["v"]
    for x, r in zip(words[1:], top):
        tokens[int(x) & (ENDINGS - 1)] -= r["c"]
        kinds[int(x) & (ENDINGS - 1)] -= 1
    seen = np.array([ends[0]["c"] if ends else 0, *tokens, *(r["c"] for r in top)], float)
    order = np.argsort(words)
    classes = np.append(_END, np.arange(ENDINGS + 1, ENDINGS + len(words)))[order]
    m = Model(words[order], classes, len(seen), (seen + 0.5) / (seen + 0.5).sum())
    m.others, m.kinds = tokens, kinds
    if not total:
        return m
    # a bounded sample of blocks for a start: about twice the wanted tokens, in one job
    share = min(1.0, 2 * SAMPLE_TOKENS / total)
    drawn = table.where(F.pmod(F.xxhash64("block"), F.lit(1 << 30)) <= int((1 << 30) * share)).select("block", "train", "off", "words", "tokens")
    parts = [_training_tokens(m, row.asDict()) for row in sorted(drawn.collect(), key=lambda row: row["block"])]
    rng, state = np.random.default_rng(17), new_state(m)
    if parts:
        a, b, w = (np.concatenate(x)[:SAMPLE_TOKENS] for x in zip(*parts))
        for p in range(SAMPLE_PASSES):
            mixed = rng.permutation(len(w))
            train_pass(m, a[mixed], b[mixed], w[mixed], state, rng)
    shared = spark.sparkContext.broadcast((m, state))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, memory = shared.value
        own = _copy(own)
        memory, n = [s.copy() for s in memory], 0
        rng = np.random.default_rng(TaskContext.get().partitionId())
        for row in _rows(batches):
            a, b, w = _training_tokens(own, row)
            mixed = rng.permutation(len(w))
            train_pass(own, a[mixed], b[mixed], w[mixed], memory, rng)
            n += len(w)
        if n:
            yield _packed(own.parameters().astype(np.float64) * n, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for row in _rows(batches):
            x = np.frombuffer(row["sums"], np.float64)
            total, n = (x.copy() if total is None else total + x), n + row["tokens"]
        if n:
            yield _packed(total, n)

    kind = "sums binary, tokens long"
    got = table.select("train", "off", "words", "tokens").mapInArrow(learn, kind).repartition(8).mapInArrow(add, kind).collect()
    m.set_parameters(sum(np.frombuffer(r["sums"], np.float64) for r in got) / sum(r["tokens"] for r in got))
    return m


def _packed(sums: np.ndarray, n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([n])], ["sums", "tokens"])


def _copy(m: Model) -> Model:
    own = Model.__new__(Model)
    own.__dict__.update(m.__dict__)
    own.set_parameters(m.parameters())
    return own


def _tables_of(m: Model) -> tuple:
    key = hash(m.parameters().tobytes())
    held = worker_cache("loglinear")
    if key not in held:
        held.clear()
        held[key] = m.tables()
    return held[key]


def scores(docs: DataFrame, train_rows, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row: log10 probabilities
    of the whole text under the smoothed unigram counts of the rows where ``train_rows`` holds, and under the
    model learned from them."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(train_rows, F.lit(False)).alias("train"))
    table = written(blocks(rows), "loglinear-blocks")
    pairs = table.select("block", F.posexplode(F.arrays_zip("words", "n")).alias("place", "x")).select(
        "block", "place", F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    counts = written(pairs.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "loglinear-counts")
    size = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, kinds = int(size["n"]), int(size["v"])
    m = train(table, counts, total)
    shared = spark.sparkContext.broadcast(m)

    known = (pairs.join(counts, "word").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", "c"))).alias("x"))
             .select("block", F.col("x.place").alias("place"), F.col("x.c").alias("c")))
    joined = table.select("block", "ids", "train", "off", "words", "tokens").join(known, "block", "left").drop("block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        one, two, norm = _tables_of(m)
        mass = m.others + 0.1 * (m.kinds + 1)
        for r in _rows(batches):
            words = np.asarray(r["words"], np.int64).view(np.uint64)
            c = np.zeros(len(words))
            if r["place"] is not None:
                c[r["place"]] = r["c"]
            off = np.asarray(r["off"], np.int64)
            tokens = _unpack(r["tokens"], int(off[-1]))
            of_class = m.class_of(words)
            base = np.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
            share = (c + 0.1) / mass[(words & np.uint64(ENDINGS - 1)).astype(np.int64)]
            within = np.where((of_class >= _OTHER) & (of_class < _OTHER + ENDINGS), np.log10(share), 0.0)
            cls = of_class[tokens]
            left, near = contexts(cls, off)
            lp = (one[left, cls] + two[near, cls] - norm[left, near]) / np.log(10) + within[tokens]
            start = off[:-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["ids"], pa.int64()), pa.array(~np.asarray(r["train"], bool)), pa.array(np.diff(off)),
                 pa.array(np.add.reduceat((c > 0)[tokens].astype(np.int64), start)), pa.array(np.full(len(start), total)),
                 pa.array(np.add.reduceat(base[tokens], start)), pa.array(np.add.reduceat(lp.astype(np.float64), start))], names)

    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    return joined.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
