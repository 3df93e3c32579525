"""Gates: which inputs to process (S8 missing models, S9 resume, S10 file-name keys)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table

PRED_PREFIX = "pred_"
NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # the folder of rows whose key is null


def lang_from_file(path: Column, strip_prefix: bool = True) -> Column:
    """The language key of a gold or prediction file. A Hive-style folder ``lang=<x>`` (what a
    partitioned Spark write produces) wins; otherwise the file (or part-file folder) name without
    '.csv' and, for prediction files, without the 'pred_' prefix (optional: some outputs lack it)."""
    hive = F.regexp_extract(path, r"/lang=([^/]+)/", 1)
    base = F.regexp_extract(path, r"([^/]+?)\.csv(/[^/]*)?$", 1)
    base = F.regexp_replace(base, f"^{PRED_PREFIX}", "") if strip_prefix else base
    return F.when(hive == NO_KEY, None).when(hive != "", hive).otherwise(base)


def model_from_file(path: Column) -> Column:
    """The model key: a ``model=<x>`` folder, else the folder holding the prediction file."""
    hive = F.regexp_extract(path, r"/model=([^/]+)/", 1)
    return F.when(hive != "", hive).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+\.csv(/[^/]*)?$", 1))


def available_models(spark: SparkSession, requested: list[str], pred: DataFrame) -> DataFrame:
    """(model, available) for a requested model list; a model without predictions is skipped."""
    req = local_table(spark, [(m,) for m in requested], "model string")
    present = pred.select("model").distinct().withColumn("available", F.lit(True))
    return req.join(present, "model", "left").select(
        "model", F.coalesce("available", F.lit(False)).alias("available"))


def pending(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """S9 (batch form): inputs whose output keys are not in ``done`` (a left anti join)."""
    return inputs.join(done.select(*keys), keys, "left_anti")
