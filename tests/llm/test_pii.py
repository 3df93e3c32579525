"""Personal data: base spans against Python's re, positions, disguised forms, odd rows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelab.llm import pii
from votelab.llm.queries import QUERIES

ORDER = ["email", "ip", "card", "phone", "secret", "ssn"]


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    """The base spans, as the contract's patterns read."""
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m)
    for kind, pattern, ok in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15)):
        out += [(m.start(), ORDER.index(kind), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(out)


def said(spans):
    return ",".join(f"{ORDER[k]}:{s}:{e}" for s, k, e in spans)


def check(rows):
    for r in rows:
        want = plain(r["text"])
        got = [(s["start"], ORDER.index(s["kind"]), s["end"]) for s in r["spans"]]
        assert [g for g, s in zip(got, r["spans"]) if s["base"]] == want, r["text"]
        assert got == sorted(got)
        for (s, _, e), x in zip(got, r["spans"]):
            assert 0 <= s < e <= len(r["text"])
            if not x["base"]:
                assert not any(s < e2 and s2 < e for s2, _, e2 in want)


FIXED = [None, "", " ", "a@b.c_d@e.f", "x@y.z@w.v.u", "a@b..c a@b.c. .@-.-", "1.2.3.4.5.6.7.8 300.1.1.1 0000255.01.2.3 1.2.3", "é日本 4111 1111 1111 1111 😀 +49 (30) 1234-567 8",
         "+1 ((((((((((( x", "4111-1111-1111-1111-1 4111 1111 1111 1112", "+1 (212) 555-0100 trl.85@mail6.example.com 10.0.0.1", "😀a@b.cd", "9" * 900,
         "a" * 900 + "@", "x@" + "a.b" * 1000, "1.1" * 500, "- " * 500 + "+12 " + "( " * 500, "0 " * 400, "a.b@c.d " * 300, "1+2+3 @ . + 4"]
#: Very long texts and their number of base spans; the plain patterns would take time with the square of their length.
LONG = [("9" * 300_000, 0), ("a" * 300_000 + "@", 0), ("x@" + "a.b" * 100_000, 1), ("1.1" * 50_000, 12_500), ("- " * 50_000 + "+12 " + "( " * 50_000, 0),
        ("0 " * 40_000, 0), ("a.b@c.d " * 3_000, 3_000)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), sample_texts=4000)


def test_base_spans_equal_plain_patterns(spark, model):
    rng = np.random.default_rng(4)
    parts = ["1", "22", "255", "4111", "1111", ".", "-", " ", "@", "+", "(", ")", "a", "b.c", "%", "é", "😀", "_", "\n", ", "]
    texts = FIXED + ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(2500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    check([r for r in pii.spans(df, model, keep_text=True).collect() if r["text"]])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pii.spans(docs, model, keep_text=True).collect()
    assert len(rows) == docs.count()
    check([r for r in rows if r["text"]])


def test_very_long_texts(spark, model):
    df = spark.createDataFrame(LONG, "text string, n int")
    for r in pii.spans(df, model).collect():
        assert sum(s["base"] for s in r["spans"]) == r["n"]


def test_query_digests(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op12_pii"](spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(texts)
    for t in texts:
        want, r = plain(t["text"]), rows[t["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(said(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in ORDER[:4]] == [sum(ORDER[x[1]] == k for x in want) for k in ORDER[:4]]
        assert set(said(want).split(",")) <= set(r["spans"].split(","))


def test_disguised_forms_are_added_and_prose_is_left_alone(spark, model):
    yes = {"write to jo.doe (at) mail (dot) example (dot) com now": "email", "call (212) 555-0173 today": "phone", "pay with 4111.1111.1111.1111 please": "card",
           'set token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f" here': "secret", "the key 9c8b45435718dcc700c184a7e303cdc64c6a8f7f is": "secret",
           "his number 212-55-0173 was": "ssn"}
    no = ["version 4.0 of 2024-05-06, section 3.1.2", "at home dot the i", "paid 4111.1111.1111.1112 units", "it was 1234 and 56789 of 300.300.1.1", "10-20-30 and 5:6",
          "the token : of esteem", "http://example/path-to-a-thing"]
    df = spark.createDataFrame([(t, k) for t, k in yes.items()] + [(t, None) for t in no], "text string, kind string")
    for r in pii.spans(df, model, keep_text=True).collect():
        assert [s["kind"] for s in r["spans"]] == ([r["kind"]] if r["kind"] else []), r


def test_scores_as_sql_equal_the_trees(spark, model):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("text").alias("t"))
    found = pii.candidates(df, "t", []).where("gen is not null").select(*[c.alias(f) for f, c in pii.features().items()])
    rows = found.withColumn("margin", pii.margin(model.trees)).collect()
    x = np.array([r[:-1] for r in rows])
    assert np.allclose([r["margin"] for r in rows], model.trees.margins(x), atol=1e-9)
    assert len(model.trees.roots) > 5


def test_odd_rows_clashing_columns_and_degenerate_training(spark, model):
    rows = [(1, "a@b.cd", "old", "x"), (1, "a@b.cd", "old", "x"), (None, None, "old", None), (2, "", None, None), (3, "1.2.3.4 a@b.cd", "m", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, SPANS string, gen string").withColumn("m", F.lit(1)).withColumn("start", F.lit(2))
    out = pii.spans(df, model)
    assert sorted(out.columns) == ["doc_id", "gen", "m", "spans", "start"]
    assert sorted(((r["doc_id"] or 0), len(r["spans"])) for r in out.collect()) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 2)]
    assert pii.spans(df.limit(0), model).count() == 0
    for few in (df.limit(0), df.where("text is null"), df.where("doc_id = 1")):
        m = pii.train(few)
        assert [len(r["spans"]) for r in pii.spans(df.where("doc_id = 3"), m).collect()] == [2]
    assert pii.spans(df.select("text"), model).count() == 5


def test_redaction(spark, model):
    df = spark.createDataFrame([("mail a@b.cd or 10.0.0.1, é +1 (212) 555-0100.",), ("none",), (None,), ("",)], "text string")
    out = pii.spans(df, model, keep_text=True).select(pii.redact(F.col("text"), F.col("spans")).alias("t"))
    assert sorted(r["t"] for r in out.collect()) == ["", "", "mail [email] or [ip], é [phone].", "none"]


def test_no_python_in_the_plan(spark, model):
    plan = pii.spans(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), model)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
