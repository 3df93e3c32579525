"""The metric suite as aggregations.

Everything is computed from additive counts, so each step is a partial (map-side) aggregate and the
shuffles carry one row per group and partition, whatever the data size or key skew.

Conventions (zero_division = 0):
* precision tp/(tp+fp), recall tp/(tp+fn), F1 2tp/(2tp+fp+fn); 0 when the denominator is 0
* macro: plain mean over labels (or classes); micro: ratios of sums; weighted: mean weighted by gold
  support, 0 when the total support is 0
* multilabel (binary labels): the labels are the classes; accuracy is subset accuracy per row
* multiclass (intensities): per label column, the classes are the values seen in gold or prediction;
  metrics per column, then the unweighted mean over the columns of that language
* averages over languages are unweighted
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["f1_macro", "precision_macro", "recall_macro", "f1_micro", "precision_micro", "recall_micro",
           "f1_weighted", "precision_weighted", "recall_weighted", "accuracy"]


def sdiv(num, den) -> Column:
    """num / den as double, 0 when den is 0."""
    num = num if isinstance(num, Column) else F.lit(num)
    den = den if isinstance(den, Column) else F.lit(den)
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _prf(tp, fp, fn):
    return sdiv(tp, tp + fp), sdiv(tp, tp + fn), sdiv(2 * tp, 2 * tp + fp + fn)


def _w(w):
    return F.lit(1).cast("long") if w is None else F.col(w).cast("long")


def label_counts(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred",
                 weight: str | None = None) -> DataFrame:
    """keys + label -> tp, fp, fn, tn, n (binary 0/1 values; anything >= 1 counts as positive)."""
    g = F.col(gold) >= 1
    p = F.col(pred) >= 1
    w = _w(weight)
    return df.groupBy(*keys, "label").agg(
        F.sum(F.when(g & p, w).otherwise(0)).alias("tp"),
        F.sum(F.when(~g & p, w).otherwise(0)).alias("fp"),
        F.sum(F.when(g & ~p, w).otherwise(0)).alias("fn"),
        F.sum(F.when(~g & ~p, w).otherwise(0)).alias("tn"),
        F.sum(w).alias("n"))


def multilabel_from_counts(lc: DataFrame, keys: list[str], with_accuracy: bool = False) -> DataFrame:
    """M1-M3 from per-label counts: keys -> 9 metrics and the label count. With ``with_accuracy``,
    ``lc`` also carries ``rows`` / ``exact_rows`` (counted on one label per row) and subset accuracy
    and the row count (``n_rows``) come out of the same aggregate (M4)."""
    P, R, F1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    sup = F.col("tp") + F.col("fn")
    extra = ["rows", "exact_rows"] if with_accuracy else []
    per = lc.select(*keys, "tp", "fp", "fn", sup.alias("sup"), P.alias("p"), R.alias("r"), F1.alias("f"), *extra)
    aggs = [F.sum(c).alias(c) for c in extra]
    agg = per.groupBy(*keys).agg(
        F.avg("f").alias("f1_macro"), F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"),
        F.sum("tp").alias("TP"), F.sum("fp").alias("FP"), F.sum("fn").alias("FN"), F.sum("sup").alias("S"),
        F.sum(F.col("f") * F.col("sup")).alias("wf"), F.sum(F.col("p") * F.col("sup")).alias("wp"),
        F.sum(F.col("r") * F.col("sup")).alias("wr"), F.count("*").alias("n_labels"), *aggs)
    mp, mr, mf = _prf(F.col("TP"), F.col("FP"), F.col("FN"))
    acc = [sdiv(F.col("exact_rows"), F.col("rows")).alias("accuracy"),
           F.col("rows").alias("n_rows")] if with_accuracy else []
    return agg.select(*keys, "f1_macro", "precision_macro", "recall_macro",
                      mf.alias("f1_micro"), mp.alias("precision_micro"), mr.alias("recall_micro"),
                      sdiv(F.col("wf"), F.col("S")).alias("f1_weighted"),
                      sdiv(F.col("wp"), F.col("S")).alias("precision_weighted"),
                      sdiv(F.col("wr"), F.col("S")).alias("recall_weighted"), *acc, "n_labels")


def subset_accuracy(pairs: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """M4: keys -> share of rows (ids) whose whole label row is equal. Two partial aggregates."""
    rows = pairs.groupBy(*keys, "id").agg(F.min((F.col(gold) == F.col(pred)).cast("int")).alias("ok"))
    return rows.groupBy(*keys).agg(F.avg(F.col("ok").cast("double")).alias("accuracy"),
                                   F.count("*").alias("n_rows"))


def multilabel_report(pairs: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """M1-M4 on aligned pairs (keys..., id, label, gold, pred): keys -> 10 metrics."""
    m = multilabel_from_counts(label_counts(pairs, keys, gold, pred), keys)
    a = subset_accuracy(pairs, keys, gold, pred)
    return m.join(a, keys).select(*keys, *METRICS, "n_rows")


def confusion_cube(df: DataFrame, keys: list[str], gold: str = "gold", pred: str = "pred",
                   weight: str | None = None) -> DataFrame:
    """keys + label + gold + pred -> n. Small: classes^2 rows per label."""
    return df.groupBy(*keys, "label", F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(
        F.sum(_w(weight)).alias("n"))


def multiclass_per_label(cube: DataFrame, keys: list[str]) -> DataFrame:
    """M5/M6 per label column: keys + label -> 10 metrics (micro = accuracy). ``cube`` holds weighted
    (gold, pred, n) rows; they need not be unique per (gold, pred)."""
    sides = F.explode(F.array(
        F.struct(F.col("gold").alias("c"), F.col("n").alias("sup"), F.lit(0).cast("long").alias("pc"),
                 F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("sup"), F.col("n").alias("pc"),
                 F.lit(0).cast("long").alias("tp"))))
    cls = cube.select(*keys, "label", sides.alias("x")).groupBy(*keys, "label", F.col("x.c").alias("c")).agg(
        F.sum("x.sup").alias("sup"), F.sum("x.pc").alias("pc"), F.sum("x.tp").alias("tp"))
    p, r = sdiv(F.col("tp"), F.col("pc")), sdiv(F.col("tp"), F.col("sup"))
    f = sdiv(2 * F.col("tp"), F.col("pc") + F.col("sup"))
    per = cls.select(*keys, "label", "sup", "tp", p.alias("p"), r.alias("r"), f.alias("f"))
    agg = per.groupBy(*keys, "label").agg(
        F.avg("f").alias("f1_macro"), F.avg("p").alias("precision_macro"), F.avg("r").alias("recall_macro"),
        F.sum("tp").alias("TP"), F.sum("sup").alias("S"),
        F.sum(F.col("f") * F.col("sup")).alias("wf"), F.sum(F.col("p") * F.col("sup")).alias("wp"),
        F.sum(F.col("r") * F.col("sup")).alias("wr"))
    acc = sdiv(F.col("TP"), F.col("S"))
    return agg.select(*keys, "label", "f1_macro", "precision_macro", "recall_macro",
                      acc.alias("f1_micro"), acc.alias("precision_micro"), acc.alias("recall_micro"),
                      sdiv(F.col("wf"), F.col("S")).alias("f1_weighted"),
                      sdiv(F.col("wp"), F.col("S")).alias("precision_weighted"),
                      sdiv(F.col("wr"), F.col("S")).alias("recall_weighted"), acc.alias("accuracy"))


def multiclass_report(cube: DataFrame, keys: list[str]) -> DataFrame:
    """keys -> mean over label columns of the per-label multiclass metrics."""
    per = multiclass_per_label(cube, keys)
    return per.groupBy(*keys).agg(*[F.avg(m).alias(m) for m in METRICS], F.count("*").alias("n_labels"))


def pearson_per_label(cube: DataFrame, keys: list[str]) -> DataFrame:
    """Keys + label -> Pearson r of gold vs prediction from moments of weighted (gold, pred, n)
    rows; NULL if a side is constant."""
    g, p, n = F.col("gold").cast("double"), F.col("pred").cast("double"), F.col("n").cast("double")
    m = cube.groupBy(*keys, "label").agg(
        F.sum(n).alias("_k"), F.sum(g * n).alias("_sx"), F.sum(p * n).alias("_sy"),
        F.sum(g * g * n).alias("_sxx"), F.sum(p * p * n).alias("_syy"), F.sum(g * p * n).alias("_sxy"))
    k, sx, sy = F.col("_k"), F.col("_sx"), F.col("_sy")
    num = k * F.col("_sxy") - sx * sy
    vx = k * F.col("_sxx") - sx * sx
    vy = k * F.col("_syy") - sy * sy
    r = F.when((vx > 0) & (vy > 0), num / F.sqrt(vx * vy))
    return m.select(*keys, "label", r.alias("pearson"))


def per_label_long(lc: DataFrame, keys: list[str]) -> DataFrame:
    """M7: per-label positive-class precision, recall, F1 and accuracy as long rows
    (keys..., label, metric, value)."""
    P, R, F1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    acc = sdiv(F.col("tp") + F.col("tn"), F.col("n"))
    x = lc.select(*keys, "label", F.explode(F.array(
        F.struct(F.lit("precision").alias("metric"), P.alias("value")),
        F.struct(F.lit("recall").alias("metric"), R.alias("value")),
        F.struct(F.lit("f1").alias("metric"), F1.alias("value")),
        F.struct(F.lit("accuracy").alias("metric"), acc.alias("value")))).alias("m"))
    return x.select(*keys, "label", "m.metric", "m.value")


def per_label_support(lc: DataFrame, keys: list[str]) -> DataFrame:
    """Classification-report rows: per label precision, recall, F1 and gold support."""
    P, R, F1 = _prf(F.col("tp"), F.col("fp"), F.col("fn"))
    return lc.select(*keys, "label", P.alias("precision"), R.alias("recall"), F1.alias("f1"),
                     (F.col("tp") + F.col("fn")).alias("support"))


def average_over(df: DataFrame, keys: list[str], cols: list[str], prefix: str = "avg_") -> DataFrame:
    """M9: unweighted mean over the remaining key (languages), plus how many were averaged."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(prefix + c) for c in cols], F.count("*").alias("n_langs"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (sums are order-dependent in the last bits)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])
