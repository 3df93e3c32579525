"""Registered queries over the fixture views (see :mod:`votelab.sources.fixtures`).

Each query is what a user of the engine writes: load gold / predictions, call the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..operators import metrics as M
from ..registry import register
from ..sources import fixtures as fx
from . import leaderboard as L
from . import masks
from . import paired as PA

MEMBERS = [m for m, _, _ in fx.MEMBERS]
# Fixed combos of the per-label reports and the test-split ensembles (three members, list order).
FIXED_COMBO = ["m1", "m2", "m3"]
FIXED_PAIR = ["m2", "m3"]
FIXED_PAIR_UNION = ["m1", "m3"]


def _r(df: DataFrame) -> DataFrame:
    return M.round_doubles(df, 6)


def _wpairs(spark: SparkSession, sf: str, kind: str = "binary", models: list[str] | None = None) -> DataFrame:
    """The same pairs as weighted lines from one (lang, id) aggregate (see :mod:`.paired`)."""
    p = fx.pred_table(spark, sf, kind)
    if models is not None:
        p = p.where(F.col("model").isin(models))
    return PA.weighted_pairs(fx.gold_table(spark, sf, kind), p)


# ---------------------------------------------------------------- M9 leaderboards (flagship)

@register("leaderboard_majority", lambda: O.leaderboard_sql("majority", "binary"))
def leaderboard_majority(spark: SparkSession, sf: str) -> DataFrame:
    """M9 + E3/E4 (flagship): binary majority of every combo of >= 2 members, ten metrics averaged
    over the languages each combo is available in."""
    return _r(L.leaderboard(fx.gold_table(spark, sf), fx.pred_table(spark, sf), MEMBERS, "majority", "binary"))


@register("leaderboard_union", lambda: O.leaderboard_sql("union", "binary"))
def leaderboard_union(spark: SparkSession, sf: str) -> DataFrame:
    """M9 + E5: binary union of every combo, averaged over languages."""
    return _r(L.leaderboard(fx.gold_table(spark, sf), fx.pred_table(spark, sf), MEMBERS, "union", "binary"))


@register("leaderboard_majority_intensity", lambda: O.leaderboard_sql("majority", "intensity"))
def leaderboard_majority_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """M9 + E6 + M5/M6: intensity majority of every combo, multiclass metrics per label column."""
    return _r(L.leaderboard(fx.gold_table(spark, sf, "intensity"), fx.pred_table(spark, sf, "intensity"),
                            MEMBERS, "majority", "intensity"))


@register("leaderboard_union_intensity", lambda: O.leaderboard_sql("union", "intensity"))
def leaderboard_union_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """M9 + E7 + M5/M6: intensity union of every combo, multiclass metrics per label column."""
    return _r(L.leaderboard(fx.gold_table(spark, sf, "intensity"), fx.pred_table(spark, sf, "intensity"),
                            MEMBERS, "union", "intensity"))


def _by_masks(spark: SparkSession, sf: str, rule: str) -> DataFrame:
    per = masks.per_language(fx.gold_table(spark, sf), fx.pred_table(spark, sf), MEMBERS, rule)
    lb = M.average_over(per, ["combo"], M.METRICS)
    return _r(lb.select(F.col("combo").alias("model"), *[f"avg_{m}" for m in M.METRICS],
                        F.lit({"majority": "majority voting", "union": "union rule"}[rule]).alias("process"), "n_langs"))


@register("leaderboard_masks", lambda: O.leaderboard_sql("majority", "binary"))
def leaderboard_masks(spark: SparkSession, sf: str) -> DataFrame:
    """M9, majority, every combo's counts by the transform over vote masks (the way beyond 2^16 combos)."""
    return _by_masks(spark, sf, "majority")


@register("leaderboard_masks_union", lambda: O.leaderboard_sql("union", "binary"))
def leaderboard_masks_union(spark: SparkSession, sf: str) -> DataFrame:
    """M9, union rule, every combo's counts by the transform over vote masks."""
    return _by_masks(spark, sf, "union")


@register("leaderboard_models", lambda: O.leaderboard_sql("majority", "binary", "single model", 1, 1))
def leaderboard_models(spark: SparkSession, sf: str) -> DataFrame:
    """Every member alone (combos of size 1), averaged over languages."""
    return _r(L.leaderboard(fx.gold_table(spark, sf), fx.pred_table(spark, sf), MEMBERS, "majority", "binary",
                            process="single model", min_size=1, max_size=1))


@register("eval_models_intensity", lambda: O.leaderboard_sql("majority", "intensity", "single model", 1, 1))
def eval_models_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """M15, track B: every member alone, multiclass metrics per label column, averaged."""
    return _r(L.leaderboard(fx.gold_table(spark, sf, "intensity"), fx.pred_table(spark, sf, "intensity"),
                            MEMBERS, "majority", "intensity", process="single model", min_size=1, max_size=1))


@register("pearson_intensity", lambda: O.pearson_sql())
def pearson_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """Mean Pearson r per combo for both rules (intensities)."""
    g, p = fx.gold_table(spark, sf, "intensity"), fx.pred_table(spark, sf, "intensity")
    both = L.pearson(g, p, MEMBERS, ["majority", "union"])  # both rules in one pass
    process = F.when(F.col("rule") == "majority", F.lit("majority voting")).otherwise(F.lit("union rule"))
    return _r(both.select(F.col("combo").alias("model"), "avg_pearson", "n_langs", process.alias("process")))


# ---------------------------------------------------------------- M1-M6, M15 per language

@register("eval_models", lambda: O.eval_models_sql())
def eval_models(spark: SparkSession, sf: str) -> DataFrame:
    """Per (model, lang) the ten metrics, one job for all models (one shuffle of the data rows)."""
    return _r(PA.multilabel_report(_wpairs(spark, sf), ["model", "lang"]))


@register("multilabel_prf", lambda: O.multilabel_prf_sql())
def multilabel_prf(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M3: macro / micro / weighted precision, recall, F1 per (model, lang)."""
    return _r(M.multilabel_from_counts(PA.label_counts(_wpairs(spark, sf), ["model", "lang"]), ["model", "lang"]))


@register("subset_accuracy", lambda: O.subset_accuracy_sql())
def subset_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """M4: whole-row accuracy per (model, lang)."""
    return _r(PA.subset_accuracy(_wpairs(spark, sf), ["model", "lang"]))


@register("multiclass_prf", lambda: O.multiclass_prf_sql())
def multiclass_prf(spark: SparkSession, sf: str) -> DataFrame:
    """M5/M6: per (model, lang) multiclass metrics per label column, averaged over the columns."""
    # the weighted (gold, pred, n) lines feed the per-class counts directly (no cube shuffle)
    wp = _wpairs(spark, sf, "intensity").select("model", "lang", "label", "gold", "pred", "n")
    return _r(M.multiclass_report(wp, ["model", "lang"]))
