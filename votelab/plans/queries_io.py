"""Registered round-trip queries for the file sources and sinks.

Each call writes the fixture tables to a fresh folder under the shared checkpoint folder
(``spark.checkpoint.dir``), then reads them back with the engine's scanner.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..registry import ORACLE, register
from ..session import scratch_path
from ..sources import files as IO
from ..sources import fixtures as fx
from ..sources.tables import read_table
from . import leaderboard as L
from . import queries_ops as QO
from .queries import MEMBERS, _r

W = fx.with_ctes


def write_gold_tree(spark: SparkSession, sf: str) -> str:
    """Gold files per language with the header quirks the scanner must survive: upper-case
    header (de), permuted columns (fr), a missing label (es), whole texts with commas, quotes and
    newlines, and one language without label columns (page URLs as 'xx')."""
    root = scratch_path(spark, "gold-csv")
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "text")
    lab = read_table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    g = d.join(lab, "id")
    shapes = {
        "de": [F.col("id").alias("ID"), F.col("text").alias("TEXT"), F.col("quality").alias("QUALITY"),
               F.col("toxic").alias("TOXIC")],
        "es": ["id", "text", "quality"],
        "fr": ["id", "toxic", "text", "quality"],
    }
    special = F.coalesce(F.col("lang").isin(*shapes), F.lit(False))
    parts = [(F.col("lang") == lang, cols) for lang, cols in shapes.items()] + [(~special, ["id", "text", "quality", "toxic"])]
    for mine, cols in parts:
        g.where(mine).select("lang", *cols) \
            .write.mode("append").partitionBy("lang").options(header="true", escape='"').csv(root)
    pages = read_table(spark, sf, "pages").select(F.lit("xx").alias("lang"), F.col("page_id").alias("id"),
                                                  F.col("url").alias("text"))
    pages.write.mode("append").partitionBy("lang").options(header="true", escape='"').csv(root)
    return root


@register("scan_gold_long", W("SELECT lang, id, label, gold AS value FROM gold "
                              "WHERE NOT coalesce(lang = 'es' AND label = 'toxic', false)"))
def scan_gold_long(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of gold CSV files with differing headers, read one header group at a time and
    unpivoted to (lang, id, label, value); the language without labels yields no rows."""
    root = write_gold_tree(spark, sf)
    long = IO.scan_long(spark, f"{root}/*/part-*.csv")
    return long.select("lang", F.col("id").cast("long").alias("id"), "label", "value")


@register("scan_texts", W("SELECT lang, id, text FROM texts_raw UNION ALL SELECT 'xx', page_id, url FROM pages",
                          {"texts_raw": "SELECT d.lang, d.doc_id AS id, d.text FROM documents d "
                                        "JOIN labels l ON l.doc_id = d.doc_id"}))
def scan_texts(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + P2: the (lang, id, text) part of the same files (texts round-trip whole)."""
    root = write_gold_tree(spark, sf)
    return IO.scan_texts(spark, f"{root}/*/part-*.csv").select(
        "lang", F.col("id").cast("long").alias("id"), "text")


@register("scan_texts_ranges", lambda: ORACLE["scan_texts"])
def scan_texts_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + P2: the same files read in byte ranges, as files over 64 MB are."""
    root = write_gold_tree(spark, sf)
    return IO.scan_texts(spark, f"{root}/*/part-*.csv", split_over=0).select("lang", F.col("id").cast("long").alias("id"), "text")


@register("scan_predictions", W("SELECT lang, model, id, label, pred AS value FROM pred "
                                "WHERE NOT coalesce(lang = 'es' AND label = 'toxic', false)"))
def scan_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S4 + S8: wide prediction files per (model, language) written by a partitioned write
    (m2 with permuted columns, no m4/es files, no 'toxic' in es), scanned back to the long model; the
    label that a language lacks stays absent."""
    root = scratch_path(spark, "pred-csv")
    p = fx.pred_table(spark, sf).where(~F.coalesce((F.col("lang") == "es") & (F.col("label") == "toxic"), F.lit(False)))
    IO.write_wide_csv(p.where(F.col("model") != "m2"), root, ["quality", "toxic"], keys=("model", "lang"))
    IO.write_wide_csv(p.where(F.col("model") == "m2"), root, ["toxic", "quality"], keys=("model", "lang"), mode="append")
    long = IO.scan_long(spark, f"{root}/*/*/part-*.csv", model_from_dir=True)
    return long.select("lang", "model", F.col("id").cast("long").alias("id"), "label", "value")


@register("sink_predictions", W("SELECT lang, model, id, label, pred AS value FROM pred"))
def sink_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions written as parquet partitioned by (model, lang) and read back whole (a filter on
    one model prunes to its folders, see the tests)."""
    root = scratch_path(spark, "pred-parquet")
    IO.write_predictions(fx.pred_table(spark, sf), root)
    return spark.read.parquet(root).select("lang", "model", "id", "label", "value")


@register("train_pool_from_files", W("SELECT lang, id, text, quality, toxic FROM file_pool", {
    "file_pool": "SELECT d.lang, d.doc_id AS id, d.text, CAST(l.quality AS INTEGER) AS quality, "
                 "CAST(CASE WHEN d.lang = 'es' THEN 0 ELSE l.toxic END AS INTEGER) AS toxic "
                 "FROM documents d JOIN labels l ON l.doc_id = d.doc_id"}))
def train_pool_from_files(spark: SparkSession, sf: str) -> DataFrame:
    """S1 + S2 + P8: a folder of gold files with differing headers to one wide training pool; a label that a
    file lacks is 0 there. Files without label columns are no training files."""
    root = write_gold_tree(spark, sf)
    pool = IO.scan_pool(spark, f"{root}/*/part-*.csv")
    return pool.select("lang", F.col("id").cast("long").alias("id"), "text", "quality", "toxic")


@register("sink_append", lambda: (
    f"SELECT *, 'r1' AS run_id FROM ({O.leaderboard_sql('majority', 'binary')}) "
    f"UNION ALL SELECT *, 'r2' AS run_id FROM ({O.leaderboard_sql('majority', 'binary')})"))
def sink_append(spark: SparkSession, sf: str) -> DataFrame:
    """Leaderboard rows appended under two run ids (re-runs add rows, nothing is lost), the second of them retried
    (which adds none)."""
    root = scratch_path(spark, "results-append")
    lb = _r(L.leaderboard(fx.gold_table(spark, sf), fx.pred_table(spark, sf), MEMBERS, "majority"))
    IO.append_results(lb, root, "r1")
    IO.append_results(lb, root, "r2")
    IO.append_results(lb, root, "r2")
    return IO.read_results(spark, root)


@register("sink_results", lambda: (
    f"SELECT * FROM ({O.per_language_sql('majority', 'binary')}) WHERE NOT starts_with(combo, 'm1_') "
    f"UNION ALL SELECT * FROM ({O.per_language_sql('union', 'binary')}) WHERE starts_with(combo, 'm1_')"))
def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per-language results partitioned by combo; a second run overwrites only the combos it
    recomputes (here: union-rule results for the combos with m1), the other partitions stay."""
    root = scratch_path(spark, "results-combo")
    g, p = fx.gold_table(spark, sf), fx.pred_table(spark, sf)
    IO.overwrite_results(_r(L.per_language(g, p, MEMBERS, "majority")), root, ["combo"])
    again = _r(L.per_language(g, p, MEMBERS, "union")).where(F.col("combo").startswith("m1_"))
    IO.overwrite_results(again, root, ["combo"])
    return spark.read.parquet(root)


def _sunk(spark: SparkSession, rows: DataFrame, name: str, by: str) -> DataFrame:
    root = scratch_path(spark, name)
    IO.overwrite_results(rows, root, [by])
    return spark.read.parquet(root).select(*rows.columns)


@register("sink_per_label", lambda: ORACLE["per_label_report"])
def sink_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + M7: the long per-label rows of the fixed union, written by language and read back."""
    return _sunk(spark, QO.per_label_report(spark, sf), "per-label", "lang")


@register("sink_per_label_average", lambda: ORACLE["per_label_average"])
def sink_per_label_average(spark: SparkSession, sf: str) -> DataFrame:
    """S7 + M10: their mean over languages, written by metric and read back."""
    return _sunk(spark, QO.per_label_average(spark, sf), "per-label-average", "metric")
