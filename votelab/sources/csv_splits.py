"""Quoted CSV files with line breaks in their texts, read in byte ranges.

Spark's multi-line CSV reader gives a whole file to one task. Here the text source deals out the lines of byte ranges
(its splits), and the records are put together from them:

1. a partial aggregate counts the quotes of each split; their running sum over a file tells which splits begin inside
   a quoted field (a quoted quote counts twice, so parity is all that matters);
2. every task walks its splits' lines with that start and joins the lines of each record;
3. where a record crosses the end of a split, its pieces, at most two a split, are gathered in a second walk and meet in
   a shuffle of their own. No other text is shuffled.

``from_csv`` then parses the records, so quoting and columns are Spark's own. Records end with LF or CRLF (a file of
lone CRs is one line). As in Spark's reader, line breaks inside quotes stay as they are in a record that ends with LF,
and CRLF becomes LF in one that ends with CRLF (here the record decides, there the file's first line). A quote stands in quoted fields only, as every CSV
writer leaves it. Empty lines are no records, as in Spark's reader. A file without a line has no rows. One that ends
inside quotes gives its open record to the parser as it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ship_package

FOUND = "path string, start long, first boolean, kind int, record string"
WHOLE, OPENS, GOES_ON = 0, 1, 2       # a whole record; the beginning of one; lines of one begun in an earlier split


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    # only LF ends a line of the text source: a CR may belong to a text
    lines = spark.read.option("lineSep", "\n").text(files)
    at = [F.col(f"_metadata.file_{c}") for c in ("path", "block_start", "block_length")]
    return lines.select(F.xxhash64(*at).alias("split"), at[0].alias("path"), at[1].alias("start"), "value")


def split_starts(lines: DataFrame) -> DataFrame:
    """``(split, inside, crossed)`` of every split that holds a line: does it begin inside quotes, and does a record cross
    one of its ends?"""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    counted = lines.groupBy("split", "path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    # a row a split; the running sum is over one file's splits
    upto = F.sum("odd").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1
    inside = upto != (F.col("odd") == 1)
    return counted.select("split", inside.alias("inside"), (inside | upto).alias("crossed"))


class _Split:
    """The records of one split, fed with its lines batch by batch."""

    def __init__(self, path: str, start: int, inside: bool):
        self.path, self.start = path, start
        self.first = start == 0              # the next record to begin is the file's first
        self.inside = inside                 # the open record began in an earlier split
        self.open: list[str] = []            # lines of the open record
        self.quoted = inside

    def feed(self, lines: pa.Array) -> Iterator[tuple[int, pa.Array]]:
        quotes = np.asarray(pc.count_substring(lines, '"')).astype(np.int64)
        after = (np.cumsum(quotes) + self.quoted) % 2 == 1
        ends = np.flatnonzero(~after)        # lines that end a record
        if self.quoted:                      # the first lines go on with the open record
            last = int(ends[0]) + 1 if len(ends) else len(lines)
            self.open += lines.slice(0, last).to_pylist()
            if not len(ends):
                return
            yield self._close()
            lines, ends = lines.slice(last), ends[1:] - last
        whole = int(ends[-1]) + 1 if len(ends) else 0
        if whole:
            off = np.append(0, ends + 1).astype(np.int32)
            yield WHOLE, pc.binary_join(pa.ListArray.from_arrays(pa.array(off), lines.slice(0, whole)), "\n")
        if whole < len(lines):
            self.open = lines.slice(whole).to_pylist()
        self.quoted = bool(self.open)

    def _close(self) -> tuple[int, pa.Array]:
        record, kind = "\n".join(self.open), GOES_ON if self.inside else WHOLE
        self.open, self.inside, self.quoted = [], False, False
        return kind, pa.array([record])

    def finish(self) -> Iterator[tuple[int, pa.Array]]:
        """What is left when the split ends: lines of a record that goes on in the next one."""
        if self.quoted and self.open:
            yield (GOES_ON if self.inside else OPENS), pa.array(["\n".join(self.open)])


def _walk(batches: Iterator[pa.RecordBatch], splits: np.ndarray, inside: np.ndarray, want) -> Iterator[pa.RecordBatch]:
    """The records and pieces that ``want`` names, of the splits ``splits`` (ascending), lines of others unread."""
    split = at = None

    def rows(got: Iterator[tuple[int, pa.Array]]) -> Iterator[pa.RecordBatch]:
        for kind, records in got:
            n, first = len(records), np.zeros(len(records), bool)
            if n and kind != GOES_ON:
                first[0], split.first = split.first, False
            if n and kind in want:
                yield pa.RecordBatch.from_arrays([pa.array([split.path] * n, pa.string()), pa.array(np.full(n, split.start)), pa.array(first),
                                                  pa.array(np.full(n, kind, np.int32)), records.cast(pa.string())],
                                                 ["path", "start", "first", "kind", "record"])

    for b in batches:
        keys = np.asarray(b.column("split"))
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for i, j in zip(cuts, cuts[1:]):
            if i == j:
                continue
            if keys[i] != at:
                if split is not None:
                    yield from rows(split.finish())
                at, p = keys[i], int(np.searchsorted(splits, keys[i]))
                known = p < len(splits) and splits[p] == at
                split = _Split(b.column("path")[i].as_py(), b.column("start")[i].as_py(), bool(inside[p])) if known else None
                if not known and WHOLE in want:
                    raise ValueError("the splits changed between two reads; set spark.sql.files.minPartitionNum")
            if split is not None:
                yield from rows(split.feed(b.column("value").slice(i, j - i)))
    if split is not None:
        yield from rows(split.finish())


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """``(path, record)``: the CSV records of ``files`` without their header records, one string each."""
    ship_package(spark)
    lines = _lines(spark, files)
    # nine bytes a split on the driver and in the tasks, which the scan's own list of splits outweighs
    starts = split_starts(lines).toPandas().sort_values("split")
    shared = spark.sparkContext.broadcast(tuple(starts[c].to_numpy() for c in ("split", "inside")))
    got = lines.mapInArrow(lambda b: _walk(b, *shared.value, (WHOLE,)), FOUND).where("not first").select("path", "record")
    crossed = starts[starts["crossed"]]
    if len(crossed):
        some = spark.sparkContext.broadcast(tuple(crossed[c].to_numpy() for c in ("split", "inside")))
        pieces = lines.mapInArrow(lambda b: _walk(b, *some.value, (OPENS, GOES_ON)), FOUND)
        begun = F.count(F.when(F.col("kind") == OPENS, 1)).over(Window.partitionBy("path").orderBy("start", F.col("kind").desc()))
        joined = pieces.withColumn("n", begun).groupBy("path", "n").agg(
            F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("start", "kind", "record"))).alias("x"))
        got = got.unionByName(joined.where("not first").select("path", F.array_join("x.record", "\n").alias("record")))
    record = F.col("record")
    plain = F.when(F.right(record, F.lit(1)) == "\r", F.replace(F.left(record, F.length(record) - 1), F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    return got.select("path", plain.alias("record")).where("record != ''")


def read(spark: SparkSession, files: list[str], header: tuple[str, ...], options: dict[str, str]) -> DataFrame:
    """The string columns ``header`` of ``files``, and ``__path``."""
    schema = ", ".join(f"`{c}` string" for c in header)
    opts = {**{k: v for k, v in options.items() if k != "header"}, "multiLine": "true"}
    parsed = F.from_csv("record", schema, opts)
    return records(spark, files).select(F.col("path").alias("__path"), parsed.alias("r")).select(*[F.col(f"r.`{c}`") for c in header], "__path")
