"""Gold x prediction pairs for per-model evaluation (M1-M6, M15-M17) without a data-sized join.

The plain form joins predictions with gold on ``(lang, id, label)`` (two sorted shuffles) and then
groups the pairs again per ``(model, lang, id)`` for subset accuracy (a third). Here both tables
are unioned and aggregated once per row ``(lang, id)`` into the set of ``(label, model, value)``
entries (gold has a NULL model). The set is combined map-side, so copies collapse before the shuffle,
and it is bounded by labels x (models + 1) x distinct values. The set is then folded per cell and per
(row, model) by aggregates on the same partitioning (no further exchange). Identical (model, row)
signatures collapse in a histogram, and each histogram row becomes weighted pairs: the labels with
gold where the model has a value (the inner-join rule), plus whether the model got the whole row
right. Every metric is then a partial aggregate over the weighted pairs.

A duplicated cell counts once, with the max of its values (``alignment_violations`` reports it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M


def weighted_pairs(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(model, lang, n, pos, exact, rtp, rfp, rfn, rcells, label, gold, pred): ``n`` identical
    (lang, id) rows of one model per line; one line per paired label (``pos`` = its position in the
    row, so ``pos = 0`` counts each row once); ``exact`` = the model got every paired label of the row
    right; ``r*`` = the row's tp / fp / fn / paired-cell counts.

    One shuffle of the data rows, keyed by (lang, id) and combined map-side (copies collapse). The
    per-cell and per-(row, model) folds after it are aggregates keyed by supersets of (lang, id), so
    the shuffle's partitioning serves them without another exchange."""
    g = gold.select("lang", "id", "label", F.lit(None).cast("string").alias("model"),
                    F.col("value").cast("int").alias("value"))
    p = pred.select("lang", "id", "label", "model", F.col("value").cast("int").alias("value"))
    rows = g.unionByName(p).groupBy("lang", "id").agg(F.collect_set(F.struct("label", "model", "value")).alias("e"))
    ent = rows.select("lang", "id", F.explode("e").alias("e")).select("lang", "id", "e.label", "e.model", "e.value")
    # one value per (cell, source): the max of its copies
    src = ent.groupBy("lang", "id", "label", "model").agg(F.max("value").alias("v"))
    member = F.col("model").isNotNull()
    cells = src.groupBy("lang", "id", "label").agg(
        F.max(F.when(~member, F.col("v"))).alias("gold"),
        F.collect_list(F.when(member, F.struct("model", F.col("v").alias("pred")))).alias("preds"))
    paired = cells.where(F.col("gold").isNotNull()).select("lang", "id", "label", "gold", F.explode("preds").alias("p"))
    per_row = paired.groupBy("lang", "id", F.col("p.model").alias("model")).agg(
        F.array_sort(F.collect_list(F.struct("label", "gold", F.col("p.pred").alias("pred")))).alias("sig"))
    h = per_row.groupBy("model", "lang", "sig").agg(F.count("*").alias("n"))

    def count(cond):
        return F.size(F.filter("sig", cond))

    # per-row flags and counts of the model's paired cells (M4, M11/M12), on histogram rows
    x = h.select("model", "lang", "n", "sig", F.forall("sig", lambda c: c["gold"] == c["pred"]).alias("exact"),
                 count(lambda c: (c["gold"] >= 1) & (c["pred"] >= 1)).alias("rtp"),
                 count(lambda c: (c["gold"] < 1) & (c["pred"] >= 1)).alias("rfp"),
                 count(lambda c: (c["gold"] >= 1) & (c["pred"] < 1)).alias("rfn"),
                 F.size("sig").alias("rcells"))
    return x.select("model", "lang", "n", "exact", "rtp", "rfp", "rfn", "rcells",
                    F.posexplode("sig").alias("pos", "c")).select(
        "model", "lang", "n", "pos", "exact", "rtp", "rfp", "rfn", "rcells", "c.label",
        F.col("c.gold").alias("gold"), F.col("c.pred").alias("pred"))


def label_counts(wp: DataFrame, keys: list[str]) -> DataFrame:
    """keys + label -> tp, fp, fn, tn, n (weighted), plus rows / exact_rows counted once per row."""
    g, p, n = F.col("gold") >= 1, F.col("pred") >= 1, F.col("n")
    first = F.col("pos") == 0
    return wp.groupBy(*keys, "label").agg(
        F.sum(F.when(g & p, n).otherwise(0)).alias("tp"),
        F.sum(F.when(~g & p, n).otherwise(0)).alias("fp"),
        F.sum(F.when(g & ~p, n).otherwise(0)).alias("fn"),
        F.sum(F.when(~g & ~p, n).otherwise(0)).alias("tn"),
        F.sum(n).alias("n"),
        F.sum(F.when(first, n).otherwise(0)).alias("rows"),
        F.sum(F.when(first & F.col("exact"), n).otherwise(0)).alias("exact_rows"))


def multilabel_report(wp: DataFrame, keys: list[str]) -> DataFrame:
    """M1-M4: keys -> the ten metrics and the number of evaluated rows."""
    return M.multilabel_from_counts(label_counts(wp, keys), keys, with_accuracy=True) \
        .select(*keys, *M.METRICS, "n_rows")


def subset_accuracy(wp: DataFrame, keys: list[str]) -> DataFrame:
    """M4: keys -> share of rows whose paired labels are all right, and the row count."""
    first = F.col("pos") == 0
    agg = wp.where(first).groupBy(*keys).agg(
        F.sum(F.when(F.col("exact"), F.col("n")).otherwise(0)).alias("exact_rows"), F.sum("n").alias("n_rows"))
    return agg.select(*keys, M.sdiv(F.col("exact_rows"), F.col("n_rows")).alias("accuracy"), "n_rows")


def confusion_cube(wp: DataFrame, keys: list[str]) -> DataFrame:
    """keys + label + gold + pred -> n (weighted), for the multiclass report (M5/M6)."""
    return M.confusion_cube(wp, keys, weight="n")


def training_metrics(wp: DataFrame, keys: list[str]) -> DataFrame:
    """M11-M13 from weighted pairs, rows pooled over languages: overall_accuracy (subset),
    samples_accuracy (cells), overall_f1 (macro over labels), samples_f1 (F1 per row, mean; 0 for a
    row with no positive in gold and prediction)."""
    n = F.col("n")
    f_row = M.sdiv(2 * F.col("rtp"), 2 * F.col("rtp") + F.col("rfp") + F.col("rfn"))
    lc = label_counts(wp, keys)
    per = lc.select(*keys, M.sdiv(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f"))
    macro = per.groupBy(*keys).agg(F.avg("f").alias("overall_f1"))
    rows = wp.where(F.col("pos") == 0).groupBy(*keys).agg(
        M.sdiv(F.sum(F.when(F.col("exact"), n).otherwise(0)), F.sum(n)).alias("overall_accuracy"),
        M.sdiv(F.sum((F.col("rcells") - F.col("rfp") - F.col("rfn")) * n), F.sum(F.col("rcells") * n))
        .alias("samples_accuracy"),
        M.sdiv(F.sum(f_row * n), F.sum(n)).alias("samples_f1"))
    return rows.join(macro, keys).select(*keys, "overall_accuracy", "samples_accuracy", "overall_f1", "samples_f1")
