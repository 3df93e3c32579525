"""CSV files in byte ranges against Spark's multi-line reader."""

import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from votelab.sources import csv_splits
from votelab.sources import files as IO

HEADER = ("id", "text", "joy")


@pytest.fixture
def small_splits(spark):
    """Splits of about 8 kB, as many as a file of some GB has at the usual size."""
    conf = {"spark.sql.files.maxPartitionBytes": "8000", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def _file(name: str, rows: list[tuple], end: str, header: str = "id,text,joy") -> str:
    d = tempfile.mkdtemp(prefix="votelab-split-")
    path = os.path.join(d, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(header + end)
        for i, text, joy in rows:
            f.write(f"{i},{text},{joy}{end}")
    return path


def _texts(rng: random.Random, n: int, br: str) -> list[tuple]:
    pool = ['"a, b"', '"say ""hi"""', f'"two{br}lines"', f'"{br}{br}"', f'"""{br}"""', "plain", "", '""', "héé 日本", f'"1,{br}2,x{br}3,""{br}"',
            '"' + f"long ""q"" {br}".replace('"', '""') * 300 + '"', '"' + "x" * 5000 + '"', " spaced ", '"' + f"{br}9,fake,0" * 400 + '"']
    return [(i, rng.choice(pool[:10] if rng.random() < 0.95 else pool), i % 2) for i in range(n)]


def _both(spark, paths: list[str]):
    df = spark.read.options(**IO.CSV_OPTIONS, multiLine="true").schema(", ".join(f"{c} string" for c in HEADER)).csv(paths)
    want = sorted(df.select(*HEADER).collect(), key=str)
    return want, csv_splits.read(spark, paths, HEADER, IO.CSV_OPTIONS)


@pytest.mark.parametrize("end, br, seed", [("\n", "\n", 1), ("\r\n", "\r\n", 2), ("\r\n", "\n", 3), ("\n", "\n", 4)])
def test_ranges_equal_the_multi_line_reader(spark, small_splits, end, br, seed):
    rng = random.Random(seed)
    paths = [_file(f"f{k}.csv", _texts(rng, n, br), end) for k, n in enumerate((1500, 3, 0))]
    want, got = _both(spark, paths)
    assert got.rdd.getNumPartitions() > 5
    rows = sorted(got.select(*HEADER).collect(), key=str)
    assert len(rows) == 1503 and rows == want
    assert {r[0].rsplit("/", 1)[1] for r in got.select("__path").distinct().collect()} == {"f0.csv", "f1.csv"}


def test_one_file_is_the_work_of_many_tasks(spark, small_splits):
    path = _file("one.csv", [(i, f'"line {i}\nbreak"', 1) for i in range(4000)], "\n")
    got = csv_splits.read(spark, [path], HEADER, IO.CSV_OPTIONS)
    tasks = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) >= 8 and sum(t["count"] for t in tasks) == 4000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" in plan and "FileScan csv" not in plan


def test_records_longer_than_several_splits_come_together(spark, small_splits):
    rows = [(1, '"' + "a\n" * 9000 + '"', 1), (2, "x", 0), (3, '"' + 'b""\n' * 5000 + '"', 1), (4, '"' + "c\n" * 4000 + '"', 0)]
    want, got = _both(spark, [_file("long.csv", rows, "\n")])
    assert sorted(got.select(*HEADER).collect(), key=str) == want and len(want) == 4


def test_header_with_a_line_break_and_empty_lines(spark, small_splits):
    path = _file("h.csv", [(1, '"a\nb"', 1)], "\n", header='id,"text\nof it",joy')
    with open(path, "a", encoding="utf-8") as f:
        f.write("\n\n2,b,0\n\n")
    got = csv_splits.read(spark, [path], HEADER, IO.CSV_OPTIONS)
    assert sorted((r.id, r.text, r.joy) for r in got.collect()) == [("1", "a\nb", "1"), ("2", "b", "0")]
    empty = _file("e.csv", [], "")
    open(empty, "w").close()
    assert csv_splits.read(spark, [empty], HEADER, IO.CSV_OPTIONS).count() == 0


def test_scanner_reads_large_files_in_ranges(spark, small_splits, monkeypatch):
    rows = _texts(random.Random(9), 600, "\n")
    path = _file("eng.csv", rows, "\n")
    small = os.path.join(os.path.dirname(path), "deu.csv")
    with open(small, "w", encoding="utf-8") as f:
        f.write('text,JOY,ID\n"x\ny",1,7\n')
    open(os.path.join(os.path.dirname(path), "none.csv"), "w").close()
    pattern = os.path.dirname(path) + "/*.csv"
    read = lambda: [sorted(df.collect(), key=str) for df in (IO.scan_long(spark, pattern), IO.scan_texts(spark, pattern),
                                                             IO.scan_pool(spark, pattern))]
    want = read()
    monkeypatch.setattr(IO, "SPLIT_OVER", 1000)
    assert read() == want and len(want[0]) == 601
