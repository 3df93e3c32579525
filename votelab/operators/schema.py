"""Schema operators: wide label files to the long model and back.

A gold or prediction file is wide: ``id``, optionally ``text``, then one column per label; the label
set is whatever columns a file has (per language). The engine works on the long model
``(lang, id, label, value)`` where an absent label simply has no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_COLUMNS = ("id", "text")


def lower_columns(df: DataFrame) -> DataFrame:
    """Lower-case every column name."""
    return df.toDF(*[c.lower() for c in df.columns])


def label_columns(df: DataFrame, keep: tuple[str, ...] = ("lang",)) -> list[str]:
    """Target labels = columns other than id/text (case-insensitive) and the key columns."""
    skip = {c.lower() for c in ID_COLUMNS} | {c.lower() for c in keep}
    return [c for c in df.columns if c.lower() not in skip]


def hide_gold(df: DataFrame, keep: tuple[str, ...] = ("lang",)) -> DataFrame:
    """Keep only the key columns, id and text (what a scorer may see)."""
    want = [c for c in df.columns if c.lower() in set(ID_COLUMNS) | set(keep)]
    return df.select(*want)


def coerce_label(c) -> Column:
    """Non-numeric -> 0, numeric -> truncated int (text '0.9' -> 0, 'x' -> 0, null -> 0, 'nan' -> 0)."""
    c = F.col(c) if isinstance(c, str) else c
    d = c.cast("string").try_cast("double")
    return F.coalesce(F.nanvl(d, F.lit(0.0)), F.lit(0.0)).try_cast("int")


def to_long(df: DataFrame, keys: list[str], labels: list[str] | None = None, value: str = "value",
            with_pos: bool = False) -> DataFrame:
    """Unpivot the label columns to (keys..., label, value[, pos]); label names lower-cased.
    ``pos`` is the label's position among the label columns (the label index order)."""
    labels = labels if labels is not None else label_columns(df, tuple(keys))
    if not labels:
        cols = [*keys, F.lit(None).cast("string").alias("label"), F.lit(None).alias(value)]
        if with_pos:
            cols.append(F.lit(None).cast("int").alias("pos"))
        return df.select(*cols).where(F.lit(False))
    items = [F.struct(F.lit(lab.lower()).alias("label"), F.col(lab).alias(value), F.lit(i).alias("pos"))
             for i, lab in enumerate(labels)]
    x = df.select(*keys, F.explode(F.array(*items)).alias("x"))
    out = [*keys, F.col("x.label").alias("label"), F.col(f"x.{value}").alias(value)]
    if with_pos:
        out.append(F.col("x.pos").alias("pos"))
    return x.select(*out)


def keyed(df: DataFrame, lang: str | None) -> DataFrame:
    """P7 and the file key: lower-case headers, ``lang`` from the key (None: the frame's own column)."""
    low = lower_columns(df)
    return low if lang is None else low.withColumn("lang", F.lit(lang))


def union_files(frames: list[DataFrame]) -> DataFrame:
    """Row-wise concat with column union (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def train_pool(frames: dict[str | None, DataFrame]) -> DataFrame:
    """S2 + P7 + P8: every per-language file, headers lower-cased, unioned by name, labels coerced.
    Missing labels become 0 here (training semantics). Adds ``lang`` from the file key; a frame with
    key None brings its own ``lang`` column."""
    lowered = [keyed(df, lang) for lang, df in frames.items()]
    pool = union_files(lowered)
    labels = label_columns(pool)
    return pool.select("lang", "id", "text", *[coerce_label(c).alias(c) for c in labels])


def long_per_file(frames: dict[str | None, DataFrame], coerce: bool = True) -> DataFrame:
    """Each file unpivoted on its own label set, then unioned: (lang, id, label, value).
    Absent labels have no rows (evaluation semantics)."""
    parts = []
    for lang, df in frames.items():
        low = keyed(df, lang)
        labels = label_columns(low)
        lf = to_long(low, ["lang", "id"], labels)
        if coerce:
            lf = lf.withColumn("value", coerce_label("value"))
        parts.append(lf)
    return reduce(lambda a, b: a.unionByName(b), parts)


def label_catalog(long_df: DataFrame) -> DataFrame:
    """(lang, label) pairs present in the data (a small distinct aggregate)."""
    return long_df.select("lang", "label").distinct()


def label_index(pool: DataFrame) -> DataFrame:
    """(idx, label) in the pool's column order, computed from the unpivoted data."""
    labels = label_columns(pool)
    lf = to_long(pool, ["id"], labels, with_pos=True)
    per = lf.groupBy("label").agg(F.min("pos").alias("idx"))
    return per.select(F.col("idx").cast("int").alias("idx"), "label")


def label_vector(pool: DataFrame) -> DataFrame:
    """P10 + P11: (id, Tweet, labels array<double>) in label index order; no shuffle."""
    labels = label_columns(pool)
    return pool.select("id", F.col("text").alias("Tweet"),
                       F.array(*[F.col(c).cast("double") for c in labels]).alias("labels"))


def process_name(flags: dict) -> Column:
    """Run-variant name = the names of the set flags joined by '_' in flag order (nulls skipped).
    A flag is a Python bool or a boolean Column (per-row variants)."""
    def on(v):
        return v if isinstance(v, Column) else F.lit(bool(v))
    return F.concat_ws("_", *[F.when(on(v), F.lit(k)) for k, v in flags.items()])


def restrict_labels(pred: DataFrame, catalog: DataFrame) -> DataFrame:
    """Keep only the (lang, label) cells the gold has: a filter on the constant lang -> labels map
    when the catalog is small (bounded read), else a size-checked broadcast semi join."""
    from ..functions.decode import in_language_labels
    return in_language_labels(pred, catalog)


def langs_without_labels(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """P5: per language of the inputs, how many labels its gold has; 0 means the language is skipped."""
    langs = texts.select("lang").distinct()
    n = catalog.groupBy("lang").agg(F.count("*").alias("n_labels"))
    out = langs.join(n, "lang", "left").select("lang", F.coalesce("n_labels", F.lit(0)).cast("long").alias("n_labels"))
    return out.withColumn("skipped", F.col("n_labels") == 0)
