"""Alignment verdicts by fingerprints against the exact listing."""

import random

import pytest
from pyspark.sql import functions as F

from votelab.operators import ensemble as E

SCHEMA = "lang string, model string, id long, label string, value int"


def table(spark, faults=(), langs=("en", "de", None), models=("a", "b", "c")):
    rows = [(g, m, i, v, 1) for g in langs for m in models for i in range(8) for v in ("x", "y")]
    for f in faults:
        rows = f(rows)
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def without(*cells):
    return lambda rows: [r for r in rows if r[:4] not in cells]


def twice(cond):
    return lambda rows: rows + [r for r in rows if cond(r)]


FAULTS = {
    "one missing cell": ([without(("en", "b", 3, "x"))], {"en"}),
    "one missing id": ([without(("de", "a", 3, "x"), ("de", "a", 3, "y"))], {"de"}),
    "one doubled cell": ([twice(lambda r: r[:4] == ("en", "c", 0, "y"))], {"en"}),
    "swapped cells of equal number": ([lambda rows: [(*r[:2], 99, *r[3:]) if r[:4] == (None, "a", 1, "x") else r for r in rows]], {None}),
    "one missing, another doubled": ([without(("en", "b", 3, "x")), twice(lambda r: r[:4] == ("en", "b", 4, "x"))], {"en"}),
    "a cell doubled in every member": ([twice(lambda r: r[0] == "de" and r[2] == 5 and r[3] == "x")], {"de"}),
    "null ids and labels": ([lambda rows: rows + [("en", "a", None, "x", 1), ("en", "b", 7, None, 1), ("en", "c", None, None, 1)]], {"en"}),
    "a null model": ([lambda rows: rows + [("de", None, 1, "x", 1)]], {"de"}),
}


@pytest.mark.parametrize("name", FAULTS)
def test_faults_are_found_and_listed_as_by_the_exact_listing(spark, name):
    faults, langs = FAULTS[name]
    df = table(spark, faults)
    assert set(E.misaligned_languages(df)) == langs
    assert listed(E.alignment_violations(df)) == listed(E.list_violations(df))


def test_aligned_members_need_no_listing(spark):
    df = table(spark)
    assert E.misaligned_languages(df) == []
    assert listed(E.alignment_violations(df)) == [] == listed(E.list_violations(df))
    assert E.misaligned_languages(df.where("model = 'a'")) == []
    assert E.misaligned_languages(df.limit(0)) == [] and listed(E.alignment_violations(df.limit(0))) == []
    E.assert_aligned(df)


def test_fingerprints_shuffle_only_partial_sums(spark):
    plan = E.fingerprints(table(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(lang") == 1 and "partial_count" in plan and "partial_sum" in plan


def test_many_languages_fall_back_to_the_whole_listing(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_INLINE_LANGS", 0)
    df = table(spark, FAULTS["one missing id"][0])
    assert E.misaligned_languages(df) is None
    assert listed(E.alignment_violations(df)) == listed(E.list_violations(df)) != []


def test_order_of_rows_does_not_matter(spark):
    df = table(spark)
    assert listed(E.fingerprints(df)) == listed(E.fingerprints(df.orderBy(F.rand(1))))
