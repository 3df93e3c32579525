"""Readers for the driver's parquet tables; only the needed columns reach the scan.

The DataFrame handle of a table is kept per session and path: a DataFrame is an immutable plan,
so reusing it saves the repeated file listing and footer read of ``spark.read.parquet`` while every
query still gets its own column pruning and filter pushdown.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

_HANDLES: dict[tuple[int, str], DataFrame] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = table_path(sf_dir, name)
    key = (id(spark), path)
    df = _HANDLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = spark.read.parquet(path)
        _HANDLES[key] = df
    return df
