"""Ensemble sweep + evaluation for every combo in one job (the compact plan).

Plan, for gold ``(lang, id, label, value)`` and predictions ``(lang, model, id, label, value)``:

1. gold and predictions are unioned and aggregated per row ``(lang, id)`` into the set of
   ``(label, member, value)`` entries, combined map-side before the shuffle, so copies of a cell
   collapse and a hot key costs one bounded set per task. This is the one shuffle proportional to the
   input rows; the per-cell votes and the row's sorted signature are then plain aggregates on that
   partitioning (no further exchange).
2. ``groupBy(lang, sig).count()`` collapses identical rows into a histogram; its partial
   aggregate runs map-side, so a hot signature (e.g. all zeros) costs one row per partition.
3. Each histogram row (bounded by the distinct signatures, not by the rows) fans out to the combos
   available in its language: the per-language member presence (a constant map for up to
   MAX_INLINE_LANGS languages, else an equi-join), then an ``explode`` of the constant combo list
   (size checked on the driver). No cross join.
4. Votes and decisions are bit-mask arithmetic over each row's labels (one array function a row, no
   Python), then partial aggregates per (combo, lang, label) feed the metric suite.

Members must be aligned (E2): a repeated cell, or one that a member of the language lacks, ends the
query unless ``misaligned="zero"`` is passed.

Subset accuracy comes from the same pass: a row's exactness is carried on its first label only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble as E
from ..operators import metrics as M


def row_signatures(gold: DataFrame, pred: DataFrame, members: list[str], misaligned: str = "raise") -> DataFrame:
    """(lang, id, sig): sig = sorted array<struct<label, gold, votes array<int>>> over the labels with
    gold, one vote slot per member (its max value for the cell, NULL when it has none).

    One shuffle, keyed by (lang, id): the row's entries ``(label, idx, value)`` (idx -1 = gold) are
    gathered with ``collect_set``, combined map-side, so copies of a cell collapse before the shuffle
    and a group of copies holding a third of the rows sends one bounded set per task (labels x
    (members + 1) x distinct values). The set is then exploded and decoded per cell and per row with
    plain aggregates keyed by supersets of (lang, id): the shuffle's partitioning already satisfies
    them, so they add no exchange, and they run in whole-stage codegen."""
    spark = pred.sparkSession
    mdf = F.broadcast(E.members_frame(spark, members))  # local relation, size checked
    g = gold.select("lang", "id", "label", F.lit(-1).alias("idx"), F.col("value").cast("int").alias("value"))
    p = pred.join(mdf, "model").select("lang", "id", "label", "idx", F.col("value").cast("int").alias("value"))
    rows = g.unionByName(p).groupBy("lang", "id").agg(F.collect_set(F.struct("label", "idx", "value")).alias("e"), F.count("*").alias("n"))
    if misaligned == "raise":
        # a repeated cell shows as more entries than the set has, or as two entries of one (label, idx)
        cells_of = F.array_distinct(F.transform("e", lambda x: F.struct(x["label"], x["idx"])))
        rows = rows.withColumn("e", F.when(F.col("n") == F.size(cells_of), F.col("e")).otherwise(E.misaligned_row(rows.schema["e"].dataType)))
    ent = rows.select("lang", "id", F.explode("e").alias("e")).select("lang", "id", "e.label", "e.idx", "e.value")
    cells = ent.groupBy("lang", "id", "label").agg(
        F.max(F.when(F.col("idx") == -1, F.col("value"))).alias("gold"),
        F.array(*[F.max(F.when(F.col("idx") == k, F.col("value"))) for k in range(len(members))]).alias("votes"))
    cells = cells.where(F.col("gold").isNotNull())
    return cells.groupBy("lang", "id").agg(
        F.array_sort(F.collect_list(F.struct("label", "gold", "votes"))).alias("sig"))


def histogram(gold: DataFrame, pred: DataFrame, members: list[str], misaligned: str = "raise") -> DataFrame:
    """(lang, sig, n): identical rows collapsed (partial aggregate map-side)."""
    return row_signatures(gold, pred, members, misaligned).groupBy("lang", "sig").agg(F.count("*").alias("n"))


def with_combos(rows: DataFrame, pred: DataFrame, members: list[str], min_size: int = 2,
                max_size: int | None = None, aligned=None) -> DataFrame:
    """E1 + fan-out: each row (keyed by ``lang``) is expanded to the combos available in its language:
    the language's member-presence mask (a constant map, or a join when there are very many
    languages), then an ``explode`` of the constant, size-checked combo list, kept where every
    member is present. No cross join, and no shuffle when the masks are inlined. Rows without a
    language have no members and drop out. ``aligned``: a condition on ``rows`` and ``lang_pres``; a row
    that breaks it ends the query (E2)."""
    pres = E.presence_by_language(pred, members)
    if isinstance(pres, DataFrame):
        x = rows.join(pres, "lang")
    else:
        x = rows.withColumn("lang_pres", F.element_at(pres, F.col("lang")))
    if aligned is not None:
        x = x.withColumn("lang_pres", F.when(F.col("lang_pres").isNull() | aligned, F.col("lang_pres")).otherwise(E.misaligned_row("bigint")))
    x = x.withColumn("c", F.explode(E.combos_array(members, min_size, max_size)))
    x = x.where(F.col("c.mask").bitwiseAND(F.col("lang_pres")) == F.col("c.mask"))
    return x.select(*[c for c in rows.columns], F.col("c.combo").alias("combo"), F.col("c.r").alias("r"),
                    F.col("c.mask").alias("mask"))


def _decisions(rule: str, kind: str, n: int):
    """Per-row array<struct<label, g, p>> for the combo on the row."""
    def one(e):
        s, mx = E.vote_sum_max([e["votes"][k] for k in range(n)], F.col("mask"))
        return F.struct(e["label"].alias("label"), e["gold"].alias("g"),
                        E.decide(rule, kind, s, mx, F.col("r")).alias("p"))
    return F.transform("sig", one)


def combo_rows(gold: DataFrame, pred: DataFrame, members: list[str], rule, kind: str,
               min_size: int = 2, max_size: int | None = None, misaligned: str = "raise") -> DataFrame:
    """(combo, lang, n, pos, label, g, p, exact): one row per (combo, histogram row, label). With a
    list of rules, each histogram row fans out to rules x combos in the same pass and the rows carry
    a leading ``rule`` column."""
    h = histogram(gold, pred, members, misaligned)
    # The histogram is small in bytes, so AQE would coalesce it into few tasks, but each row fans out
    # to every combo with per-row vote expressions: spread it over the cluster's cores first.
    h = h.repartition(pred.sparkSession.sparkContext.defaultParallelism)
    same = F.forall("sig", lambda e: E.votes_mask([e["votes"][k] for k in range(len(members))]) == F.col("lang_pres"))
    x = with_combos(h, pred, members, min_size, max_size, same if misaligned == "raise" else None)
    lead = []
    if isinstance(rule, (list, tuple)):
        x = x.withColumn("rule", F.explode(F.array(*[F.lit(r) for r in rule])))
        rule, lead = F.col("rule"), ["rule"]
    d = x.select(*lead, "combo", "lang", "n", _decisions(rule, kind, len(members)).alias("d"))
    d = d.withColumn("exact", F.forall("d", lambda t: t["g"] == t["p"]))
    # posexplode_outer: ``d`` is never empty, and the outer form avoids an inferred size(d) > 0
    # filter that would evaluate the vote expressions twice
    return d.select(*lead, "combo", "lang", "n", "exact", F.posexplode_outer("d").alias("pos", "t")) \
        .select(*lead, "combo", "lang", "n", "pos", "exact", "t.label", "t.g", "t.p")


def per_language(gold: DataFrame, pred: DataFrame, members: list[str], rule: str = "majority",
                 kind: str = "binary", min_size: int = 2, max_size: int | None = None,
                 misaligned: str = "raise") -> DataFrame:
    """(combo, lang, 10 metrics) for every available (combo, language). Binary combos beyond the size of the combo
    table are swept by vote masks (:mod:`votelab.plans.masks`)."""
    if kind == "binary" and E.n_combos(len(members), min_size, max_size) > E.MAX_BROADCAST_COMBOS:
        from . import masks
        return masks.per_language(gold, pred, members, rule, min_size, max_size, misaligned)
    rows = combo_rows(gold, pred, members, rule, kind, min_size, max_size, misaligned)
    keys = ["combo", "lang"]
    if kind == "binary" or kind == "binary_union":
        lc = rows.groupBy(*keys, "label").agg(
            F.sum(F.when((F.col("g") >= 1) & (F.col("p") >= 1), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("g") < 1) & (F.col("p") >= 1), F.col("n")).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("g") >= 1) & (F.col("p") < 1), F.col("n")).otherwise(0)).alias("fn"),
            F.sum(F.when(F.col("pos") == 0, F.col("n")).otherwise(0)).alias("rows"),
            F.sum(F.when((F.col("pos") == 0) & F.col("exact"), F.col("n")).otherwise(0)).alias("exact_rows"))
        return M.multilabel_from_counts(lc, keys, with_accuracy=True).select(*keys, *M.METRICS)
    # the fan-out rows are already weighted (gold, pred) pairs: they feed the per-class counts
    # directly, without an intermediate confusion-cube shuffle
    weighted = rows.select(*keys, "label", F.col("g").alias("gold"), F.col("p").alias("pred"), "n")
    return M.multiclass_report(weighted, keys).select(*keys, *M.METRICS)


def leaderboard(gold: DataFrame, pred: DataFrame, members: list[str], rule: str = "majority",
                kind: str = "binary", process: str | None = None, min_size: int = 2,
                max_size: int | None = None, misaligned: str = "raise") -> DataFrame:
    """M9: one row per combo, the ten metrics averaged over its languages (unweighted)."""
    per = per_language(gold, pred, members, rule, kind, min_size, max_size, misaligned)
    lb = M.average_over(per, ["combo"], M.METRICS)
    proc = process if process is not None else {"majority": "majority voting", "union": "union rule"}[rule]
    return lb.select(F.col("combo").alias("model"), *[f"avg_{m}" for m in M.METRICS],
                     F.lit(proc).alias("process"), "n_langs")


def pearson(gold: DataFrame, pred: DataFrame, members: list[str], rule="majority",
            min_size: int = 2, max_size: int | None = None, misaligned: str = "raise") -> DataFrame:
    """Per combo, mean over languages of the mean over labels of Pearson r (intensities). With a
    list of rules, all of them come from one pass (a leading ``rule`` column)."""
    rows = combo_rows(gold, pred, members, rule, "intensity", min_size, max_size, misaligned)
    lead = ["rule"] if isinstance(rule, (list, tuple)) else []
    weighted = rows.select(*lead, "combo", "lang", "label", F.col("g").alias("gold"), F.col("p").alias("pred"), "n")
    per_label = M.pearson_per_label(weighted, [*lead, "combo", "lang"])
    per_lang = per_label.groupBy(*lead, "combo", "lang").agg(F.avg("pearson").alias("pearson"))
    return per_lang.groupBy(*lead, "combo").agg(F.avg("pearson").alias("avg_pearson"),
                                                F.count("pearson").alias("n_langs"))


def ensemble_votes(pred: DataFrame, members: list[str], rule: str = "majority", kind: str = "binary",
                   min_size: int = 2, max_size: int | None = None, misaligned: str = "raise") -> DataFrame:
    """E4-E7 (compact): (combo, lang, id, label, value) for every available (combo, language).

    One shuffle groups the member values of a cell into vote columns (bounded state: one max per
    member); each cell then fans out to its language's available combos in-stage, so the output is
    written without a second data-sized shuffle (the exploded form shuffles ~15 rows per cell). The
    decisions are plain arithmetic on the vote columns and the combo's bit mask. ``misaligned``: see
    :func:`votelab.operators.ensemble.vote_fixed`."""
    spark: SparkSession = pred.sparkSession
    mdf = F.broadcast(E.members_frame(spark, members))
    p = pred.join(mdf, "model")
    names = [f"v{k}" for k in range(len(members))]
    cells = p.groupBy("lang", "id", "label").agg(
        *[F.max(F.when(F.col("idx") == k, F.col("value").cast("int"))).alias(v) for k, v in enumerate(names)],
        F.count("*").alias("n"))
    votes = [F.col(v) for v in names]
    have = E.votes_mask(votes)
    same = (have == F.col("lang_pres")) & (F.bit_count(have) == F.col("n"))
    x = with_combos(cells, pred, members, min_size, max_size, same if misaligned == "raise" else None)
    s, mx = E.vote_sum_max(votes, F.col("mask"))
    return x.select("combo", "lang", "id", "label", E.decide(rule, kind, s, mx, F.col("r")).cast("int").alias("value"))
