"""Embedding whitening against plain integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelab.llm import whitening
from votelab.llm.queries import QUERIES


def plain(vectors):
    """Exact moments by Python integers; eigenvectors by numpy."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = np.array([[(n * sum(r[i] * r[j] for r in x) - s[i] * s[j]) / (n * n) for j in range(d)] for i in range(d)])
    return x, n, s, v


def test_scatter_is_exact_for_small_and_huge_entries():
    rng = np.random.default_rng(1)
    for rows, top in ((1, 5), (63, 9), (64, 1 << 20), (130, 1 << 50), (77, (1 << 62) - 1)):
        z = rng.integers(-top, top, (rows, 5))
        z[:, 3] = 7
        got = whitening.scatter(z)
        one = np.column_stack([z.astype(object), np.ones(rows, object)])
        assert (got == one.T.dot(one)).all()


def test_query_equals_plain_arithmetic(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    x, n, s, v = plain([r["embedding"] for r in rows])
    out = QUERIES["op13_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 32 * len(rows)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    dev = {r["vec_id"]: sum((n * a - b) ** 2 for a, b in zip(y, s)) for r, y in zip(rows, x)}
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    got = np.zeros((len(rows), 32))
    for r in out:
        assert r["n"] == n and r["deviation"] == dev[r["vec_id"]] and r["identity_error"] < 1e-9
        assert abs(r["explained"] - values[r["component"] - 1] / np.trace(v)) < 1e-12
        got[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    want = (np.array(x, float) - np.array(s) / n) @ vectors[:, :32] / np.sqrt(values[:32])
    sign = np.sign((got * want).sum(axis=0))
    assert np.abs(got * sign - want).max() < 1e-7


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(a) for a in rng.normal(size=4)], "old") for i in range(40)]
    bad = [(100, None, "a"), (101, [1.0, None, 2.0, 3.0], "a"), (102, [1.0, float("nan"), 2.0, 3.0], "a"),
           (103, [1.0, float("inf"), 2.0, 3.0], "a"), (104, [1.0, 2.0], "a"), (105, [], "a")]
    more = [(None, [0.5, 0.5, 0.5, 0.5], "b"), (3, good[3][1], "b"), (3, good[3][1], "b")]
    return spark.createDataFrame(good + bad + more, "vec_id long, embedding array<double>, whitened string")


def test_odd_rows_clashing_columns_and_blocks(spark, odd, monkeypatch):
    rows = whitening.usable_rows(odd)
    assert rows.count() == 43
    m = whitening.train(rows, components=3)
    out = whitening.whiten(rows, m)
    assert sorted(out.columns) == ["deviation", "embedding", "vec_id", "whitened"]
    x, n, s, v = plain([r["embedding"] for r in rows.collect()])
    assert m.n == n and [t + 1_000_000 * n for t in m.total] == s
    assert sorted(r["deviation"] for r in out.collect()) == sorted(sum((n * a - b) ** 2 for a, b in zip(y, s)) for y in x)
    assert whitening.identity_error(rows, m) < 1e-9
    again = whitening.totals(rows.repartition(7), 4)
    assert (again == whitening.totals(rows.coalesce(1), 4)).all()


def test_degenerate_tables(spark, odd):
    for df in (odd.limit(0), odd.where("vec_id = 100")):
        rows = whitening.usable_rows(df)
        m = whitening.train(rows)
        assert m.n == 0 and whitening.whiten(rows, m).count() == 0 and whitening.identity_error(rows, m) == 0
    one = whitening.usable_rows(odd.where("vec_id = 3"))
    m = whitening.train(one)
    out = whitening.whiten(one, m).collect()
    assert len(out) == 3 and all(r["deviation"] == 0 and set(r["whitened"]) == {0.0} for r in out)
    # a dimension that is another's double: its component is not usable
    flat = spark.range(50).select(F.array(*[(F.hash("id", F.lit(k)) % 10).cast("double") for k in (1, 1, 2)]).alias("embedding"))
    m = whitening.train(flat)
    assert m.usable.sum() == 2 and whitening.identity_error(flat, m) < 1e-9


def test_entries_that_need_more_than_64_bits(spark):
    df = spark.createDataFrame([([1e17, 3.0],), ([-1e17, 5.0],), ([1e300, 4.0],)], "embedding array<double>")
    m = whitening.train(whitening.usable_rows(df))
    assert m.n == 3 and all(r["deviation"] is None for r in whitening.whiten(df, m).collect())
