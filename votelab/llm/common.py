"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, ship_package


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers (once per application)."""
    ship_package(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: later reads survive a lost executor and do not
    compute it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more."""
    for t in tables:
        jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What one operator keeps in this Python worker between tasks. What other operators left there goes, so that a
    reused worker holds one operator's tables and caches at a time."""
    for other in [k for k in _caches if k != owner]:
        del _caches[other]
    return _caches.setdefault(owner, {})


def fresh(prefix: str) -> str:
    """A column name that no caller's column clashes with."""
    return f"__{prefix}_{uuid.uuid4().hex[:8]}"


def crc_mod(doc_id, m: int):
    """crc32 of the id's decimal text, modulo ``m``: the fixed folds of training and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % m


def repeats_ids(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether rows share an id (nulls aside)."""
    return not docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty()


def with_text_ids(docs: DataFrame, out: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with a column ``out`` that tells rows of one id and different texts apart: the id itself for the least
    text of an id, and a number from 2^62 on, a hash of id and text, for the others. Null ids stay null, and equal
    rows stay equal."""
    own = F.col(doc_id).cast("long")
    if not repeats_ids(docs, doc_id):
        return docs.withColumn(out, own)
    key, least = fresh("key"), fresh("least")
    # a row an id that occurs with several texts
    first = docs.groupBy(F.col(doc_id).alias(key)).agg(F.min(text).alias(least), F.max(F.xxhash64(text)).alias("h"), F.min(F.xxhash64(text)).alias("l"))
    first = written(first.where(F.col(key).isNotNull() & (F.col("h") != F.col("l"))).select(key, least), "text-ids")
    other = F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)
    same = F.col(key).isNull() | F.col(text).eqNullSafe(F.col(least))
    return docs.join(first, docs[doc_id] == F.col(key), "left").withColumn(out, F.when(same, own).otherwise(other)).drop(key, least)


def pieces(batches: Iterator[pa.RecordBatch], col: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most about ``most`` bytes of ``col``, or one longer value."""
    for b in batches:
        i, n = 0, b.num_rows
        if n == 0:
            continue
        length = pc.list_value_length if pa.types.is_list(b.column(col).type) else pc.binary_length
        size = np.cumsum(np.maximum(np.asarray(length(b.column(col)).fill_null(0)).astype(np.int64), 1))
        while i < n:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + most, side="right")))
            yield b.slice(i, j - i)
            i = j


def extend(df: DataFrame, owner: str, read: str, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list],
           most: int = 8 << 20) -> DataFrame:
    """``df`` with new columns that ``compute`` derives from slices of at most about ``most`` bytes of the column
    ``read``. A new column takes the place of one of the same name (in any letter case)."""
    prepare(df.sparkSession)
    new = [f.name for f in fields]
    kept = [f for f in df.schema.fields if f.name.lower() not in {n.lower() for n in new}]
    names = [f.name for f in kept]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        for b in pieces(batches, read, most):
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *compute(b)], [*names, *new])

    return df.mapInArrow(make, T.StructType([*kept, *fields]))
