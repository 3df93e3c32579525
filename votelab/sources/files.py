"""File sources and sinks for label tables.

Layout of the files the engine reads (CSV, header row, quoted texts may hold commas and newlines):

* gold:        ``<dir>/<lang>.csv``                with columns ``id, text, <labels of that language>``
* predictions: ``<root>/<model>/pred_<lang>.csv``  with columns ``id, <labels>`` (prefix optional)

Reading a directory of CSV files with different headers in one ``spark.read.csv`` maps later files
by position (a file headed ``id,fear,joy`` silently swaps joy and fear). So the scan reads only the
header line of each file (the same driver-side work Spark's own header handling does), groups the
files by header, issues one read per distinct header, and unions the long forms by name. Label
values are never inferred: they are read as strings and coerced explicitly. Files with texts, which
may hold line breaks, are read whole by Spark's multi-line reader up to ``SPLIT_OVER`` bytes and in
byte ranges (``csv_splits``) beyond, so a large file is many tasks' work; both give the same rows.
"""

from __future__ import annotations

import csv
import hashlib
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import coerce_label
from . import csv_splits
from .gates import lang_from_file, model_from_file

ATTEMPT = "__attempt"  # partition column of appended results

CSV_OPTIONS = {"header": "true", "escape": '"', "quote": '"', "mode": "FAILFAST"}


# Bytes beyond which a file with texts is read in ranges; a smaller one is a fair task's work.
SPLIT_OVER = 64 << 20


def has_text(header: tuple[str, ...]) -> bool:
    return any(c.lower() == "text" for c in header)


def read_group(spark: SparkSession, header: tuple[str, ...], files: dict[str, int], split_over: int | None = None) -> DataFrame:
    """The string columns of ``files`` (path: bytes) of one ``header``, and ``__path``. Only texts hold line breaks: files
    without a text column are split by Spark's own reader."""
    large = [f for f, size in files.items() if has_text(header) and size > (SPLIT_OVER if split_over is None else split_over)]
    small = [f for f in files if f not in set(large)]
    parts = [csv_splits.read(spark, large, header, CSV_OPTIONS)] if large else []
    if small:
        schema = ", ".join(f"`{c}` string" for c in header)
        df = spark.read.options(**CSV_OPTIONS, multiLine=str(has_text(header)).lower()).schema(schema).csv(small)
        parts.append(df.select("*", F.col("_metadata.file_path").alias("__path")))
    return reduce(DataFrame.unionAll, parts)


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p.getFileSystem(spark._jsc.hadoopConfiguration())


def list_files(spark: SparkSession, pattern) -> dict[str, int]:
    """Paths and sizes of the files matching a glob, or any of several (Hadoop file system: local, HDFS or object store
    alike)."""
    found = {}
    for p in [pattern] if isinstance(pattern, str) else pattern:
        jvm, fs = _fs(spark, p)
        found.update((st.getPath().toString(), st.getLen()) for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(p)) or [] if st.isFile())
    return dict(sorted(found.items()))


def read_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The header row of one CSV file (first line only)."""
    jvm, fs = _fs(spark, path)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(path))
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        line = reader.readLine() or ""
    finally:
        stream.close()
    return tuple(c.strip() for c in next(csv.reader([line.lstrip("\ufeff")]), []))


# Concurrent header reads: each is one small read of a file's first line, so many files cost
# round trips to the file system, not data; bounded so an object store is not flooded.
HEADER_READ_THREADS = 32


def group_by_header(spark: SparkSession, files: dict[str, int]) -> dict[tuple[str, ...], dict[str, int]]:
    """``{header: {path: bytes}}``; a file without a line has no header and is in no group."""
    groups: dict[tuple[str, ...], dict[str, int]] = {}
    with ThreadPoolExecutor(max_workers=max(1, min(HEADER_READ_THREADS, len(files)))) as pool:
        headers = list(pool.map(lambda f: read_header(spark, f), files))
    for f, h in zip(files, headers):
        if h:
            groups.setdefault(h, {})[f] = files[f]
    return groups


def scan_long(spark: SparkSession, pattern, model_from_dir: bool = False, missing_as_zero: bool = False) -> DataFrame:
    """Every CSV matching ``pattern`` as long rows (lang, [model,] id, label, value).

    ``lang`` comes from a ``lang=<x>`` folder (partitioned Spark output) or else the file name without
    '.csv' and without a leading 'pred_'; ``model`` (optional) likewise from ``model=<x>`` or the
    parent folder. Labels are the columns other than id/text, lower-cased; a file
    without label columns contributes no rows (P5), and neither does an empty cell: an absent label is
    not a 0 (``missing_as_zero``: the training reading, in which it is)."""
    files = list_files(spark, pattern)
    parts = []
    for header, group in group_by_header(spark, files).items():
        df = read_group(spark, header, group)
        path = F.col("__path")
        keys = [lang_from_file(path).alias("lang")]
        if model_from_dir:
            keys.append(model_from_file(path).alias("model"))
        labels = [c for c in header if c.lower() not in ("id", "text")]
        if not labels:
            continue
        base = df.select(*keys, F.col(f"`{next(c for c in header if c.lower() == 'id')}`").alias("id"), *[F.col(f"`{c}`") for c in labels])
        items = F.array(*[F.struct(F.lit(c.lower()).alias("label"), F.col(f"`{c}`").alias("v")) for c in labels])
        long = base.select(*[k for k in base.columns if k in ("lang", "model", "id")], F.explode(items).alias("x"))
        if not missing_as_zero:
            long = long.where(F.coalesce(F.trim("x.v"), F.lit("")) != "")
        parts.append(long.select(*[c for c in long.columns if c != "x"], F.col("x.label").alias("label"),
                                 coerce_label(F.col("x.v")).alias("value")))
    if not parts:
        raise ValueError(f"no label files under {pattern}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_texts(spark: SparkSession, pattern: str, split_over: int | None = None) -> DataFrame:
    """The (lang, id, text) part of gold files (what a scorer may read, P2); files of more than ``split_over`` bytes
    (default: ``SPLIT_OVER``) are read in ranges."""
    files = list_files(spark, pattern)
    parts = [spark.sql("SELECT CAST(NULL AS STRING) AS lang, CAST(NULL AS STRING) AS id, CAST(NULL AS STRING) AS text WHERE false")]
    for header, group in group_by_header(spark, files).items():
        if "text" not in [c.lower() for c in header]:
            continue
        df = read_group(spark, header, group, split_over)
        idc = next(c for c in header if c.lower() == "id")
        txt = next(c for c in header if c.lower() == "text")
        parts.append(df.select(lang_from_file(F.col("__path")).alias("lang"),
                               F.col(f"`{idc}`").alias("id"), F.col(f"`{txt}`").alias("text")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_pool(spark: SparkSession, pattern) -> DataFrame:
    """S1 + S2: every gold file with labels as one wide training pool (lang, id, text, labels...): headers
    lower-cased, files unioned by name, labels coerced, a missing label 0 (P7, P8)."""
    files = list_files(spark, pattern)
    parts = []
    for header, group in group_by_header(spark, files).items():
        low = [c.lower() for c in header]
        if not set(low) - {"id", "text"}:
            continue
        df = read_group(spark, header, group)
        parts.append(df.select(lang_from_file(F.col("__path")).alias("lang"),
                               *[F.col(f"`{c}`").alias(c.lower()) for c in header]))
    if not parts:
        raise ValueError(f"no label files under {pattern}")
    pool = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "text" not in pool.columns:
        pool = pool.withColumn("text", F.lit(None).cast("string"))
    labels = [c for c in pool.columns if c not in ("lang", "id", "text")]
    return pool.select("lang", "id", "text", *[coerce_label(F.col(f"`{c}`")).alias(c) for c in labels])


# ---------------------------------------------------------------- sinks

def write_wide_csv(long_df: DataFrame, path: str, labels: list[str] | None = None, keys: tuple[str, ...] = ("lang",),
                   extra: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Wide label files (id, [extra...], labels...) partitioned by ``keys`` (one folder per model /
    language). Each folder has the label columns that its rows have, in the order of ``labels`` (default:
    by name): folders are written together per distinct label set, which a small aggregate (a row per
    folder) finds. A repeated cell keeps its largest value."""
    have = long_df.groupBy(*keys).agg(F.array_sort(F.collect_set("label")).alias("__have"))
    sets = [r["__have"] for r in have.select("__have").distinct().collect()]
    place = {lab: i for i, lab in enumerate(labels or [])}
    on = [f"__k{i}" for i in range(len(keys))]
    for own in sorted(sets):
        mine = have.where(F.col("__have") == F.array(*[F.lit(x) for x in own])).select(*[F.col(k).alias(o) for k, o in zip(keys, on)])
        same = [F.col(k).eqNullSafe(F.col(o)) for k, o in zip(keys, on)]
        rows = long_df.join(mine, same, "left_semi") if len(sets) > 1 else long_df
        wide = rows.groupBy(*keys, "id", *extra).pivot("label", sorted(own, key=lambda x: (place.get(x, len(place)), x))).agg(F.max("value"))
        wide.write.mode(mode).partitionBy(*keys).options(header="true", escape='"').csv(path)
        mode = "append"


def write_predictions(pred: DataFrame, path: str) -> None:
    """S4 (columnar): long predictions as parquet partitioned by model and language, so a later
    filter on either prunes whole folders."""
    pred.write.mode("overwrite").partitionBy("model", "lang").parquet(path)


def _manifest(path: str, run_id: str) -> str:
    return f"{path}/commits/{hashlib.sha256(run_id.encode()).hexdigest()}.json"


def append_results(df: DataFrame, path: str, run_id: str) -> bool:
    """Result rows of a run, tagged with its id. A new run adds its rows to those of earlier ones; a run that is
    retried adds nothing more. Each attempt writes a folder of its own, and a manifest file that only one attempt of
    a run can create makes it count, so attempts that failed or came second are never read. Returns whether this
    attempt counts. A column ``run_id`` of ``df`` gives way."""
    spark, manifest = df.sparkSession, _manifest(path, run_id)
    jvm, fs = _fs(spark, manifest)
    target = jvm.org.apache.hadoop.fs.Path(manifest)
    if fs.exists(target):
        return False
    attempt = f"a{uuid.uuid4().hex}"
    df.withColumn("run_id", F.lit(run_id)).write.parquet(f"{path}/rows/{ATTEMPT}={attempt}")
    try:
        out = fs.create(target, False)
    except Py4JJavaError:
        if fs.exists(target):
            return False
        raise
    try:
        out.write(bytearray(json.dumps({"run_id": run_id, ATTEMPT: attempt}).encode()))
    finally:
        out.close()
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all runs that ``append_results`` committed to ``path``. Folders of other attempts are pruned."""
    counted = spark.read.schema(f"run_id string, {ATTEMPT} string").json(f"{path}/commits").select(ATTEMPT)
    return spark.read.option("mergeSchema", "true").parquet(f"{path}/rows").join(counted, ATTEMPT, "left_semi").drop(ATTEMPT)


def overwrite_results(df: DataFrame, path: str, partition_cols: list[str]) -> None:
    """Replace only the partitions present in ``df`` (per combo / per model), keep the rest."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_cols).parquet(path)
