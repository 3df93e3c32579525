"""Binary ensemble sweep by vote masks (M9 beyond E3's combo table).

A cell's votes are a bit mask of the members that vote 1, so all that a combo's counts need from the data is how many
cells have each mask, by language, label and gold. No data row fans out to combos:

* union: a combo ``S`` predicts 0 where the mask lies in its complement, so the counts of all combos are one subset-sum
  (zeta) transform of the mask counts, read backwards;
* majority: the transform carries the number of votes inside ``S``: bit by bit, a member left out adds its two halves,
  a member taken in shifts the half with its vote by one. The high bits' choices are blocks, so a block needs
  ``members * 2^LOW`` numbers at a time;
* subset accuracy needs whole rows: equal rows collapse in a histogram first. Under the union rule a row is right where
  ``S`` misses the masks of its negative labels and meets that of each positive one; by inclusion and exclusion that is
  a signed sum of subset conditions, again one zeta transform. Under the majority rule each distinct row is compared
  with all combos at once, as vectors.

Members that a language lacks don't count as bits there (E1). The combos are rows only in the result. Up to
``MAX_MEMBERS`` members; votes must be 0 or 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ensemble as E
from ..operators import metrics as M
from ..session import ship_package
from .leaderboard import row_signatures

MAX_MEMBERS = 20
LOW = 12                 # bits of a block of the majority transform
CHUNK = 1 << 14          # combos in a row of partial sums
KEEP = 64                # decision vectors that a task keeps


def thresholds(k: int, rule: str) -> np.ndarray:
    """The votes that each of the 2^k combos needs."""
    size = np.bitwise_count(np.arange(1 << k, dtype=np.uint32)).astype(np.int64)
    return size // 2 + 1 if rule == "majority" else np.ones(1 << k, np.int64)


def zeta(f: np.ndarray) -> np.ndarray:
    """Sums over all subsets: ``out[s]`` is the sum of ``f[m]`` with ``m`` inside ``s``."""
    f = f.copy()
    for b in range(len(f).bit_length() - 1):
        v = f.reshape(-1, 2, 1 << b)
        v[:, 1] += v[:, 0]
    return f


def positives(masks: np.ndarray, n: np.ndarray, k: int, rule: str) -> np.ndarray:
    """For each of the 2^k combos, how many of the cells (``n`` with each of the ``masks``) it predicts as 1."""
    if rule == "union":
        f = np.zeros(1 << k, np.int64)
        np.add.at(f, masks, n)
        return n.sum() - zeta(f)[::-1]
    low = min(k, LOW)
    need, out = thresholds(k, rule), np.empty(1 << k, np.int64)
    for high in range(1 << (k - low)):
        votes = np.zeros((k + 2, 1 << low), np.int64)       # by votes inside the combo
        np.add.at(votes, (np.bitwise_count((masks >> low) & high), masks & ((1 << low) - 1)), n)
        for b in range(low):
            v = votes.reshape(k + 2, -1, 2, 1 << b)
            out_, in_ = v[:, :, 0].copy(), v[:, :, 1].copy()
            v[:, :, 0] = out_ + in_
            v[:, :, 1] = out_
            v[1:, :, 1] += in_[:-1]
        least = np.cumsum(votes[::-1], axis=0)[::-1]
        at = slice(high << low, (high + 1) << low)
        out[at] = least[need[at], np.arange(1 << low)]
    return out


class Rows:
    """How many rows each combo gets right as a whole; rows are added with their labels' gold and masks."""

    def __init__(self, k: int, rule: str):
        self.k, self.rule, self.rows = k, rule, 0
        self.sums = np.zeros(1 << k, np.int64)
        self.need = thresholds(k, rule)
        self.all = np.arange(1 << k, dtype=np.uint32)
        self.kept: dict[int, np.ndarray] = {}

    def decides(self, mask: int) -> np.ndarray:
        if mask not in self.kept:
            if len(self.kept) >= KEEP:
                self.kept.clear()
            self.kept[mask] = np.bitwise_count(self.all & np.uint32(mask)) >= self.need
        return self.kept[mask]

    def add(self, gold: list[int], masks: list[int], n: int) -> None:
        self.rows += n
        if any(g not in (0, 1) for g in gold):
            return
        if self.rule == "union":
            missed, met = 0, set()
            for g, m in zip(gold, masks):
                if g:
                    met.add(m)
                else:
                    missed |= m
            terms = {missed: n}
            for m in met:                  # meets m: all combos less those that miss m too
                for t, w in list(terms.items()):
                    terms[t | m] = terms.get(t | m, 0) - w
            for t, w in terms.items():
                self.sums[t] += w
            return
        ok = np.ones(1 << self.k, bool)
        for g, m in set(zip(gold, masks)):
            ok &= self.decides(m) == bool(g)
        self.sums += n * ok

    def right(self) -> np.ndarray:
        # a term counts for the combos that miss its mask: those whose complement holds it
        return zeta(self.sums)[::-1] if self.rule == "union" else self.sums


def bits_of(present: int) -> list[int]:
    return [b for b in range(present.bit_length()) if present >> b & 1]


def squeeze(masks: np.ndarray, present: int) -> np.ndarray:
    """Masks over the present members only, in their order."""
    out = np.zeros(len(masks), np.int64)
    for i, b in enumerate(bits_of(present)):
        out |= (masks >> b & 1) << i
    return out


def spread(present: int) -> np.ndarray:
    """The full mask of each combo of the present members."""
    at = np.arange(1 << len(bits_of(present)), dtype=np.int64)
    out = np.zeros(len(at), np.int64)
    for i, b in enumerate(bits_of(present)):
        out |= (at >> i & 1) << b
    return out


def row_histogram(gold: DataFrame, pred: DataFrame, members: list[str], misaligned: str = "raise") -> DataFrame:
    """(lang, present, sig, n): equal rows, as sorted (label, gold, mask of the members that vote 1)."""
    rows, k = row_signatures(gold, pred, members, misaligned), len(members)
    pres = E.presence_by_language(pred, members)
    x = rows.join(pres, "lang") if isinstance(pres, DataFrame) else rows.withColumn("lang_pres", F.element_at(pres, F.col("lang")))
    x = x.where("lang_pres is not null")
    if misaligned == "raise":
        same = F.forall("sig", lambda e: E.votes_mask([e["votes"][i] for i in range(k)]) == F.col("lang_pres"))
        x = x.withColumn("lang_pres", F.when(same, F.col("lang_pres")).otherwise(E.misaligned_row("bigint")))
    plain = F.forall("sig", lambda e: F.forall(e["votes"], lambda v: F.coalesce(v, F.lit(0)).isin(0, 1)))
    x = x.withColumn("sig", F.when(plain, F.col("sig")).otherwise(F.raise_error(F.lit("votes must be 0 or 1")).cast(rows.schema["sig"].dataType)))
    ones = lambda e: E.votes_mask([F.when(e["votes"][i] == 1, 1) for i in range(k)])
    sig = F.transform("sig", lambda e: F.struct(e["label"].alias("label"), e["gold"].alias("gold"), ones(e).alias("mask")))
    return x.select("lang", F.col("lang_pres").alias("present"), sig.alias("sig")).groupBy("lang", "present", "sig").agg(F.count("*").alias("n"))


def per_language(gold: DataFrame, pred: DataFrame, members: list[str], rule: str = "majority", min_size: int = 2,
                 max_size: int | None = None, misaligned: str = "raise") -> DataFrame:
    """(combo, lang, 10 metrics) for every available (combo, language), as ``leaderboard.per_language`` gives them."""
    if len(members) > MAX_MEMBERS:
        raise ValueError(f"at most {MAX_MEMBERS} members")
    E.threshold(rule, 1)                                   # the rule is known
    spark = pred.sparkSession
    ship_package(spark)
    most = len(members) if max_size is None else max_size
    h = row_histogram(gold, pred, members, misaligned)

    def wanted(present: int) -> tuple[np.ndarray, np.ndarray]:
        full = spread(present)
        size = np.bitwise_count(full)
        at = np.flatnonzero((size >= min_size) & (size <= most))
        return at, full[at]

    def count(t: pa.Table) -> pa.Table:
        present = t["present"][0].as_py()
        at, full = wanted(present)
        g, n = np.asarray(t["gold"]), np.asarray(t["n"])
        mask, k = squeeze(np.asarray(t["mask"]), present), len(bits_of(present))
        tp, fp = (positives(mask[w], n[w], k, rule)[at] for w in (g >= 1, g < 1))
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * len(at), pa.string()), "mask": full, "label": pa.array([t["label"][0].as_py()] * len(at), pa.string()),
                         "tp": tp, "fp": fp, "fn": n[g >= 1].sum() - tp})

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in b.to_pylist())
        for (lang, present), group in groupby(rows, lambda r: (r["lang"], r["present"])):
            acc, at = Rows(len(bits_of(present)), rule), bits_of(present)
            for r in group:
                squeezed = [sum((e["mask"] >> b & 1) << i for i, b in enumerate(at)) for e in r["sig"]]
                acc.add([e["gold"] for e in r["sig"]], squeezed, r["n"])
            right = acc.right()
            for i in range(0, len(right), CHUNK):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "present": [present], "chunk": pa.array([i], pa.int64()), "rows": [acc.rows],
                                                  "right": pa.array([right[i: i + CHUNK]], pa.list_(pa.int64()))})

    def total(t: pa.Table) -> pa.Table:
        present, chunk, rows = t["present"][0].as_py(), t["chunk"][0].as_py(), sum(t["rows"].to_pylist())
        right = np.sum([np.asarray(x) for c in t["right"].chunks for x in c.to_numpy(zero_copy_only=False)], axis=0)
        at, full = wanted(present)
        here = (at >= chunk) & (at < chunk + len(right))
        m = int(here.sum())
        return pa.table({"lang": pa.array([t["lang"][0].as_py()] * m, pa.string()), "mask": full[here], "rows": pa.array([rows] * m, pa.int64()), "right": right[at[here] - chunk]})

    cells = h.select("lang", "present", "n", F.explode("sig").alias("e")).select("lang", "present", "n", "e.*")
    cells = cells.groupBy("lang", "present", "label", (F.col("gold") >= 1).cast("int").alias("gold"), "mask").agg(F.sum("n").alias("n"))
    counts = cells.groupBy("lang", "label").applyInArrow(count, "lang string, mask long, label string, tp long, fp long, fn long")
    # each distinct row costs 2^members steps: an explicit number of tasks keeps small bytes from sharing one
    spread_out = h.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig").sortWithinPartitions("lang", "present")
    parts = spread_out.mapInArrow(exact, "lang string, present long, chunk long, rows long, right array<long>")
    right = parts.groupBy("lang", "chunk").applyInArrow(total, "lang string, mask long, rows long, right long")
    per = M.multilabel_from_counts(counts, ["mask", "lang"]).join(right, ["mask", "lang"])
    name = F.concat_ws("_", *[F.when(F.col("mask").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(m)) for i, m in enumerate(members)])
    return per.withColumn("accuracy", M.sdiv(F.col("right"), F.col("rows"))).select(name.alias("combo"), "lang", *M.METRICS)
