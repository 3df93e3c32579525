"""Deterministic 80/20 train/test split, and the training-side metrics.

The split is a pure function of the id (md5 of '42|id' below 0x33333333 -> test, i.e. 20 %), so it is
re-runnable, independent of partitioning and survives lost executors. The exact permutation of the
original library split is not reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import metrics as M

SEED = 42
TEST_BELOW = "33333333"  # 0x33333333 / 2^32 = 0.2


def split_column(id_col="id", seed: int = SEED) -> Column:
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col).cast("string")))
    return F.when(F.substring(key, 1, 8) < TEST_BELOW, F.lit("test")).otherwise(F.lit("train"))


def with_split(df: DataFrame, id_col: str = "id", seed: int = SEED) -> DataFrame:
    return df.withColumn("split", split_column(id_col, seed))


def label_counts_by_split(pool: DataFrame, labels: list[str]) -> DataFrame:
    """Positive count per label and split: (label, train, test)."""
    s = with_split(pool)
    long = s.select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("v"))
                                                  for c in labels])).alias("x"))
    return long.groupBy(F.col("x.label").alias("label")).pivot("split", ["train", "test"]).agg(
        F.sum("x.v").cast("long"))


def training_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """M11-M13 on (keys..., id, label, gold, pred) 0/1 pairs, every row pooled over languages:
    overall_accuracy (subset), samples_accuracy (cells), overall_f1 (macro over labels),
    samples_f1 (F1 per row, mean; 0 for a row with no positive in gold and prediction)."""
    g, p = F.col("gold") >= 1, F.col("pred") >= 1
    rows = pairs.groupBy(*keys, "lang", "id").agg(
        F.sum(F.when(g & p, 1).otherwise(0)).alias("tp"), F.sum(F.when(~g & p, 1).otherwise(0)).alias("fp"),
        F.sum(F.when(g & ~p, 1).otherwise(0)).alias("fn"), F.count("*").alias("cells"),
        F.min((F.col("gold") == F.col("pred")).cast("int")).alias("ok"))
    f_row = M.sdiv(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    per_rows = rows.groupBy(*keys).agg(
        F.avg(F.col("ok").cast("double")).alias("overall_accuracy"),
        M.sdiv(F.sum(F.col("cells") - F.col("fp") - F.col("fn")), F.sum("cells")).alias("samples_accuracy"),
        F.avg(f_row).alias("samples_f1"))
    macro = M.multilabel_from_counts(M.label_counts(pairs, keys), keys).select(
        *keys, F.col("f1_macro").alias("overall_f1"))
    return per_rows.join(macro, keys).select(*keys, "overall_accuracy", "samples_accuracy", "overall_f1",
                                             "samples_f1")
