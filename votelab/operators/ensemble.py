"""Ensembles over the long prediction table ``pred(lang, model, id, label, value)``.

A combo is a subset of the ordered member list, encoded as a bitmask over member positions.
The combo table is tiny (2^n - n - 1 rows for n members) and is broadcast; its size is known on
the driver from the member list and checked before any broadcast.

Rules (r = number of members in the combo):
* majority, binary:     1 if sum(votes) >= r // 2 + 1
* union, binary:        1 if sum(votes) >= 1
* majority, intensity:  max(values) if sum(values) >= r // 2 + 1 else 0   (the gate sums intensities)
* union, intensity:     max(values) if sum(values) >= 1 else 0
* binary union on intensities (test split): 1 if sum(values) > 0 else 0
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table

from ..functions.keys import shl, shr

# The combo table is a constant of the plan: at most this many combos (2^16), so up to 16 members with all
# sizes; more members need a ``max_size``. Beyond it the call is refused.
MAX_BROADCAST_COMBOS = 1 << 16
MAX_MEMBERS = 24

RULES = ("majority", "union")
KINDS = ("binary", "intensity", "binary_union")


def threshold(rule, r):
    """Vote threshold for a combo of ``r`` members (Column or int). ``rule`` is a rule name, or a
    string Column of rule names (several rules evaluated in one pass)."""
    if isinstance(rule, Column):
        r = r if isinstance(r, Column) else F.lit(r)
        return (F.when(rule == "majority", F.floor(r / 2).cast("int") + 1)
                .when(rule == "union", F.lit(1))
                .otherwise(F.raise_error(F.concat(F.lit("unknown rule "), rule)).cast("int")))
    if rule == "majority":
        return F.floor(r / 2).cast("int") + 1 if not isinstance(r, int) else r // 2 + 1
    if rule == "union":
        return F.lit(1) if not isinstance(r, int) else 1
    raise ValueError(f"unknown rule {rule!r}")


def n_combos(n: int, min_size: int = 2, max_size: int | None = None) -> int:
    from math import comb
    hi = n if max_size is None else min(max_size, n)
    return sum(comb(n, k) for k in range(min_size, hi + 1))


def members_frame(spark: SparkSession, members: list[str]) -> DataFrame:
    """(model, idx) for an ordered member list; idx is the bit position."""
    if len(members) > MAX_MEMBERS:
        raise ValueError(f"at most {MAX_MEMBERS} members")
    return local_table(spark, [(m, i) for i, m in enumerate(members)], "model string, idx int")


def members_from_data(pred: DataFrame) -> DataFrame:
    """(model, idx) for the models present in ``pred``, ordered by name (one small aggregate)."""
    ms = pred.select("model").distinct().limit(MAX_MEMBERS + 1).agg(F.array_sort(F.collect_list("model")).alias("ms"))
    return ms.select(F.posexplode("ms").alias("idx", "model")).select("model", F.col("idx").cast("int"))


def combos_from_members(members: DataFrame, min_size: int = 2, max_size: int | None = None) -> DataFrame:
    """Every subset of size min_size..max_size, named by joining member names with '_' in member order.

    Output: (combo string, mask long, r int, sel array<int>) where ``sel`` lists member positions.
    Generated with SQL expressions from one aggregated row: bitmasks 1..2^n-1, keep those with the
    wanted bit count. The member count is asserted in the plan itself (no action needed).
    """
    one = members.limit(MAX_MEMBERS + 1).agg(F.array_sort(F.collect_list(F.struct("idx", "model"))).alias("ms"))
    n = F.size("ms")
    guarded = one.select(
        F.when(n <= MAX_MEMBERS, F.col("ms")).otherwise(F.raise_error(F.lit("too many members"))).alias("ms"))
    masks = guarded.select("ms", F.explode(F.sequence(F.lit(1).cast("long"),
                                                      shl(1, F.size("ms")) - 1)).alias("mask"))
    hi = max_size if max_size is not None else MAX_MEMBERS
    picked = masks.where(F.bit_count("mask").between(min_size, hi)).select(
        "mask", F.filter("ms", lambda m: shr(F.col("mask"), m["idx"]).bitwiseAND(1) == 1).alias("sel"))
    return picked.select(
        F.array_join(F.transform("sel", lambda m: m["model"]), "_").alias("combo"),
        "mask",
        F.size("sel").alias("r"),
        F.transform("sel", lambda m: m["idx"]).alias("sel"))


def combo_rows_local(members: list[str], min_size: int = 2, max_size: int | None = None) -> list[tuple]:
    """(combo, mask, r, sel) for a known member list, in list order; the count is checked here."""
    if n_combos(len(members), min_size, max_size) > MAX_BROADCAST_COMBOS:
        raise ValueError("combo table too large to broadcast; pass fewer members or a max_size")
    hi = len(members) if max_size is None else min(max_size, len(members))
    rows = []
    for k in range(min_size, hi + 1):
        for sel in combinations(range(len(members)), k):
            rows.append(("_".join(members[i] for i in sel), sum(1 << i for i in sel), k, list(sel)))
    return rows


def combos_frame(spark: SparkSession, members: list[str], min_size: int = 2,
                 max_size: int | None = None) -> DataFrame:
    """Combo table for a known member list (a local relation; its size is checked)."""
    return local_table(spark, combo_rows_local(members, min_size, max_size),
                       "combo string, mask bigint, r int, sel array<int>")


def combos_array(members: list[str], min_size: int = 2, max_size: int | None = None):
    """The combo table as one constant array<struct<combo, mask, r>> column: each row can fan
    out to its combos with ``explode`` (no join). Size checked by :func:`combo_rows_local`."""
    items = []
    for combo, mask, r, _ in combo_rows_local(members, min_size, max_size):
        items.append(f"named_struct('combo', '{combo.replace(chr(39), chr(92) + chr(39))}', 'mask', {mask}L, "
                     f"'r', {r})")
    return F.expr("array(" + ", ".join(items) + ")")


def lang_presence(pred: DataFrame, members: DataFrame) -> DataFrame:
    """(lang, lang_pres): bitmask of the members with predictions per language. A 2-column partial
    aggregate over all predictions; one row per
    language, so it is safe to broadcast."""
    return pred.select("lang", "model").join(F.broadcast(members), "model") \
        .groupBy("lang").agg(F.bit_or(shl(1, F.col("idx"))).alias("lang_pres"))


# Languages whose member-presence masks may be inlined as a constant map; up to MAX_BROADCAST_LANGS
# (one ~50-byte row each) the presence table is broadcast, beyond it a plain join.
MAX_INLINE_LANGS = 4096
MAX_BROADCAST_LANGS = 1_000_000


def presence_by_language(pred: DataFrame, members: list[str]):
    """Per-language member-presence bitmask as a constant map Column when there are at most
    MAX_INLINE_LANGS languages (one small partial aggregate, read with a bounded ``limit``), else
    the (lang, lang_pres) DataFrame for a join: broadcast when a second bounded count proves it has
    at most MAX_BROADCAST_LANGS rows (so data-sized rows are never shuffled by language), else plain."""
    mdf = members_frame(pred.sparkSession, members)
    pres = lang_presence(pred, mdf).where("lang is not null")
    rows = pres.limit(MAX_INLINE_LANGS + 1).collect()
    if len(rows) > MAX_INLINE_LANGS:
        if pres.limit(MAX_BROADCAST_LANGS + 1).count() <= MAX_BROADCAST_LANGS:
            return F.broadcast(pres)
        return pres
    if not rows:
        return F.create_map().cast("map<string,bigint>")
    return F.create_map(*[x for r in rows for x in (F.lit(r.lang), F.lit(r.lang_pres).cast("long"))])


def combo_members(combos: DataFrame, members: DataFrame) -> DataFrame:
    """Long form (combo, mask, r, model, idx) of a combo table."""
    return combos.select("combo", "mask", "r", F.explode("sel").alias("idx")).join(F.broadcast(members), "idx")


def availability(pred: DataFrame, member_list: list[str], min_size: int = 2,
                 max_size: int | None = None) -> DataFrame:
    """(combo, lang, r, n_present, available). A combo is evaluated on a language only if every
    member has predictions for it. Each language row fans out to the (checked, constant) combo list."""
    members = members_frame(pred.sparkSession, member_list)
    x = lang_presence(pred, members).select("lang", "lang_pres",
                                            F.explode(combos_array(member_list, min_size, max_size)).alias("c"))
    hit = F.col("c.mask").bitwiseAND(F.col("lang_pres"))
    return x.select(F.col("c.combo").alias("combo"), "lang", F.col("c.r").alias("r"),
                    F.bit_count(hit).cast("int").alias("n_present"), (hit == F.col("c.mask")).alias("available"))


def vote_exploded(pred: DataFrame, member_list: list[str], rule: str = "majority",
                  kind: str = "binary") -> DataFrame:
    """E4-E7, E9 in the simple (exploded) form: each prediction row joins the combos it belongs to
    (broadcast equi-join on model), then one aggregate per (combo, lang, id, label). Only available
    (combo, lang) pairs are produced. Output: (combo, lang, id, label, value)."""
    spark = pred.sparkSession
    cm = combo_members(combos_frame(spark, member_list), members_frame(spark, member_list))
    avail = availability(pred, member_list).where("available").select("combo", "lang")
    x = pred.join(F.broadcast(cm.select("combo", "r", "model")), "model")
    agg = x.groupBy("combo", "r", "lang", "id", "label").agg(
        F.sum("value").alias("s"), F.max("value").alias("mx"))
    agg = agg.join(avail, ["combo", "lang"], "left_semi")  # combos x languages; AQE picks the strategy by size
    return agg.select("combo", "lang", "id", "label", decide(rule, kind, F.col("s"), F.col("mx"), F.col("r")).alias("value"))


def decide(rule: str, kind: str, s, mx, r):
    """The ensemble decision from the vote sum ``s``, the max ``mx`` and the member count ``r``."""
    if kind == "binary_union":
        return F.when(s > 0, 1).otherwise(0)
    thr = threshold(rule, r)
    if kind == "binary":
        return F.when(s >= thr, 1).otherwise(0)
    if kind == "intensity":
        return F.when(s >= thr, mx).otherwise(0).cast("int")
    raise ValueError(f"unknown kind {kind!r}")


def votes_mask(votes: list[Column]) -> Column:
    """The bits of the members that have a vote."""
    mask = F.lit(0).cast("long")
    for k, v in enumerate(votes):
        mask = mask + F.when(v.isNotNull(), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
    return mask


def vote_sum_max(votes: list[Column], mask: Column) -> tuple[Column, Column]:
    """Sum and maximum of the votes of the members in ``mask``; a missing vote is 0."""
    mine = [F.when(mask.bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.coalesce(v, F.lit(0))) for k, v in enumerate(votes)]
    total = F.lit(0)
    for v in mine:
        total = total + F.coalesce(v, F.lit(0))
    return total, F.coalesce(F.greatest(*mine, F.lit(None).cast("int")), F.lit(0))


def misaligned_row(kind) -> Column:
    """Ends the query."""
    return F.raise_error(F.lit("members are not aligned: a cell is repeated, or a member with predictions in the "
                               "language lacks it (see alignment_violations; misaligned='zero' to vote anyway)")).cast(kind)


def _fixed_votes(pred: DataFrame, models: list[str]) -> tuple[DataFrame, list[Column]]:
    """The rows of ``models`` in the languages where all of them predict (E1), and the vote of each in an aggregate."""
    pres = presence_by_language(pred, models)
    x = pred.where(F.col("model").isin(models))
    x = x.join(pres, "lang") if isinstance(pres, DataFrame) else x.withColumn("lang_pres", F.element_at(pres, F.col("lang")))
    x = x.where(F.col("lang_pres") == (1 << len(models)) - 1)
    return x, [F.max(F.when(F.col("model") == m, F.col("value").cast("int"))).alias(f"v{k}") for k, m in enumerate(models)]


def _fixed_decision(n: int, rule: str, kind: str, misaligned: str) -> Column:
    votes = [F.col(f"v{k}") for k in range(n)]
    s, mx = vote_sum_max(votes, F.lit((1 << n) - 1).cast("long"))
    value = decide(rule, kind, s, mx, F.lit(n)).cast("int")
    if misaligned == "raise":
        value = F.when((votes_mask(votes) == (1 << n) - 1) & (F.col("rows") == n), value).otherwise(misaligned_row("int"))
    return value


def vote_fixed(pred: DataFrame, models: list[str], rule: str = "majority", kind: str = "binary",
               misaligned: str = "raise") -> DataFrame:
    """One given combo (lang, id, label, value) in the languages where every member predicts. The members
    must be aligned (E2): by default a repeated cell, or one that a member lacks, ends the query; with
    ``misaligned="zero"`` a missing vote is 0 and a repeated cell counts once, at its largest value."""
    x, votes = _fixed_votes(pred, models)
    agg = x.groupBy("lang", "id", "label").agg(*votes, F.count("*").alias("rows"))
    return agg.select("lang", "id", "label", _fixed_decision(len(models), rule, kind, misaligned).alias("value"))


def vote_fixed_paired(pred: DataFrame, gold: DataFrame, models: list[str], rule: str = "majority",
                      kind: str = "binary", misaligned: str = "raise") -> DataFrame:
    """E8/E9 aligned with gold in the same aggregate: (lang, id, label, gold, value) for the cells that
    the members and the gold have. Gold rows ride along with a NULL model, so one shuffle replaces
    the vote aggregate plus a join with gold. ``misaligned``: see :func:`vote_fixed`."""
    x, votes = _fixed_votes(pred, models)
    member = F.col("model").isNotNull()
    g = gold.select("lang", "id", "label", F.lit(None).cast("string").alias("model"), "value")
    agg = g.unionByName(x.select("lang", "id", "label", "model", "value")).groupBy("lang", "id", "label").agg(
        F.max(F.when(~member, F.col("value"))).alias("gold"), *votes, F.count(F.when(member, 1)).alias("rows"))
    return agg.where((F.col("rows") > 0) & F.col("gold").isNotNull()).select(
        "lang", "id", "label", F.col("gold").cast("int").alias("gold"),
        _fixed_decision(len(models), rule, kind, misaligned).alias("value"))


def fingerprints(pred: DataFrame) -> DataFrame:
    """(lang, model, n, h1, h2): order-free fingerprints of the multiset of a model's cells ``(id, label)`` in a
    language: the count and two independent sums of 64-bit hashes. One partial aggregate; a row per task and group
    is all that is shuffled."""
    def total(*cols) -> Column:
        return F.sum(F.xxhash64(*cols).cast("decimal(20,0)"))
    return pred.groupBy("lang", "model").agg(
        F.count("*").alias("n"), total(F.lit(1), "id", "label", F.col("id").isNull()).alias("h1"),
        total(F.lit(2), "label", "id", F.col("label").isNull()).alias("h2"))


def _language_key() -> Column:
    return F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n"))


def misaligned_languages(pred: DataFrame) -> list[str | None] | None:
    """The languages whose members can't be proved aligned: their members' fingerprints differ, or agree on cells that
    are repeated. Where they agree, one member stands for all of them, so only its cells are counted one by one.
    None if there are too many languages to name."""
    most = MAX_INLINE_LANGS * MAX_MEMBERS
    found = fingerprints(pred).limit(most + 1).collect()
    if len(found) > most:
        return None
    prints: dict[str | None, dict] = {}
    for r in found:
        prints.setdefault(r["lang"], {})[r["model"]] = (r["n"], r["h1"], r["h2"])
    bad = [lang for lang, own in prints.items() if len(set(own.values())) > 1]
    stands = [(lang, own) for lang, own in prints.items() if lang not in bad]
    if not stands:
        return bad
    one = F.create_map(*[F.lit(x) for lang, own in stands for x in ("n" if lang is None else f"l{lang}", max(own, key=lambda m: m or ""))])
    repeated = pred.where(F.col("model").eqNullSafe(F.element_at(one, _language_key()))).groupBy("lang", "id", "label").count().where("count > 1")
    return bad + [r["lang"] for r in repeated.select("lang").distinct().collect()]


def alignment_violations(pred: DataFrame) -> DataFrame:
    """(kind, lang, model, id, n). ``duplicate``: a (lang, model, id, label) cell occurs n > 1
    times. ``missing``: a model with rows in the language has no rows for this id. Empty means the
    members are aligned; callers raise otherwise (see :func:`assert_aligned`).

    Languages whose members have equal fingerprints and no repeated cell hold no violation; only the others'
    rows are listed one by one, so aligned data is never shuffled whole."""
    bad = misaligned_languages(pred)
    if bad is not None:
        keys = ["n" if lang is None else f"l{lang}" for lang in bad]
        pred = pred.where(_language_key().isin(keys) if keys else F.lit(False))
    return list_violations(pred)


def list_violations(pred: DataFrame) -> DataFrame:
    """The exact listing of :func:`alignment_violations`, over all rows given."""
    dup = pred.groupBy("lang", "model", "id", "label").count().where("count > 1") \
        .groupBy("lang", "model", "id").agg(F.max("count").alias("n")) \
        .select(F.lit("duplicate").alias("kind"), "lang", "model", "id", F.col("n").cast("long"))
    per_id = pred.groupBy("lang", "id").agg(F.collect_set("model").alias("ms"))
    per_lang = pred.select("lang", "model").groupBy("lang").agg(F.collect_set("model").alias("all_ms"))
    # per_lang has one row per language; AQE broadcasts it once its measured size is small.
    miss = per_id.join(per_lang, "lang").select(
        "lang", "id", F.explode(F.array_except("all_ms", "ms")).alias("model"))
    miss = miss.select(F.lit("missing").alias("kind"), "lang", "model", "id", F.lit(0).cast("long").alias("n"))
    return dup.unionByName(miss)


def assert_aligned(pred: DataFrame) -> None:
    bad = alignment_violations(pred).limit(5).collect()
    if bad:
        raise ValueError(f"members are not aligned: {bad}")
