"""The sweep by vote masks against plain counting and against the row sweep."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from votelab.operators import ensemble as E
from votelab.plans import leaderboard as L
from votelab.plans import masks

MEMBERS = ["a", "b", "c", "d", "e"]


def tables(spark, members, langs, ids, labels=("x", "y", "z"), seed=1, lacks=()):
    rnd = random.Random(seed)
    gold = [(g, i, v, rnd.randint(0, 1)) for g in langs for i in range(ids) for v in labels]
    pred = [(g, m, i, v, int(rnd.random() < 0.4)) for g in langs for m in members if (g, m) not in lacks for i in range(ids) for v in labels]
    return (spark.createDataFrame(gold, "lang string, id long, label string, value int"),
            spark.createDataFrame(pred, "lang string, model string, id long, label string, value int"))


def test_transforms_equal_plain_counting():
    rng = np.random.default_rng(3)
    for k, low in ((1, 12), (4, 12), (6, 2)):
        masks.LOW, was = low, masks.LOW
        m, n = rng.integers(0, 1 << k, 50), rng.integers(1, 9, 50)
        for rule in ("majority", "union"):
            got = masks.positives(m, n, k, rule)
            for s in range(1 << k):
                need = s.bit_count() // 2 + 1 if rule == "majority" else 1
                assert got[s] == sum(int(c) for x, c in zip(m, n) if (int(x) & s).bit_count() >= need)
            acc, rows = masks.Rows(k, rule), []
            for _ in range(30):
                g, x, c = rng.integers(0, 2, 3).tolist(), rng.integers(0, 1 << k, 3).tolist(), int(rng.integers(1, 5))
                acc.add(g, x, c)
                rows.append((g, x, c))
            right = acc.right()
            for s in range(1 << k):
                need = s.bit_count() // 2 + 1 if rule == "majority" else 1
                assert right[s] == sum(c for g, x, c in rows if all(int((y & s).bit_count() >= need) == z for z, y in zip(g, x)))
        masks.LOW = was
    f = rng.integers(0, 9, 32)
    assert all(masks.zeta(f)[s] == sum(f[m] for m in range(32) if m & s == m) for s in range(32))


@pytest.mark.parametrize("rule", ["majority", "union"])
def test_equals_the_row_sweep(spark, rule):
    gold, pred = tables(spark, MEMBERS, ["en", "de", "fr"], 40, lacks={("de", "b"), ("fr", "a"), ("fr", "e")})
    gold = gold.where("not (lang = 'en' and label = 'z')")
    for kw in ({}, {"min_size": 1, "max_size": 3}):
        want = {(r["combo"], r["lang"]): r for r in L.per_language(gold, pred, MEMBERS, rule, **kw).collect()}
        got = {(r["combo"], r["lang"]): r for r in masks.per_language(gold, pred, MEMBERS, rule, **kw).collect()}
        assert got.keys() == want.keys() and len(got) > 20
        for key, r in want.items():
            assert [got[key][c] for c in r.asDict() if c not in ("combo", "lang")] == pytest.approx([v for c, v in r.asDict().items() if c not in ("combo", "lang")])


def test_more_members_than_the_combo_table_holds(spark):
    members = [f"m{i:02}" for i in range(17)]
    assert E.n_combos(17) > E.MAX_BROADCAST_COMBOS
    gold, pred = tables(spark, members, ["en"], 12, ("x", "y"))
    g = {(r["id"], r["label"]): r["value"] for r in gold.collect()}
    v = {(r["id"], r["label"], r["model"]): r["value"] for r in pred.collect()}
    for rule in ("majority", "union"):
        out = L.leaderboard(gold, pred, members, rule).where(F.col("avg_accuracy").isNotNull())
        assert out.count() == 2**17 - 18
        pick = [list(c) for c in list(combinations(members, 2))[:5]] + [members, members[:8], members[3:16:2]]
        got = {r["model"]: r for r in out.where(F.col("model").isin(["_".join(c) for c in pick])).collect()}
        for c in pick:
            need = len(c) // 2 + 1 if rule == "majority" else 1
            p = {cell: int(sum(v[(*cell, m)] for m in c) >= need) for cell in g}
            tp, fp, fn = (sum(g[x] == a and p[x] == b for x in g) for a, b in ((1, 1), (0, 1), (1, 0)))
            assert got["_".join(c)]["avg_f1_micro"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
            assert got["_".join(c)]["avg_accuracy"] == pytest.approx(np.mean([all(p[i, y] == g[i, y] for y in ("x", "y")) for i in range(12)]))
    with pytest.raises(ValueError, match="at most 20"):
        L.leaderboard(gold, pred, [f"m{i}" for i in range(21)])


def test_misaligned_members_and_other_votes_end_the_sweep(spark):
    gold, pred = tables(spark, MEMBERS[:3], ["en"], 5)
    lacking = pred.where("not (model = 'b' and id = 2 and label = 'x')")
    with pytest.raises(Exception, match="not aligned"):
        masks.per_language(gold, lacking, MEMBERS[:3]).collect()
    want = {tuple(r) for r in L.per_language(gold, lacking, MEMBERS[:3], misaligned="zero").collect()}
    assert {tuple(r) for r in masks.per_language(gold, lacking, MEMBERS[:3], misaligned="zero").collect()} == want
    with pytest.raises(Exception, match="votes must be 0 or 1"):
        masks.per_language(gold, pred.withColumn("value", F.lit(2)), MEMBERS[:3]).collect()
    with pytest.raises(ValueError, match="unknown rule"):
        masks.per_language(gold, pred, MEMBERS[:3], "some")
    assert masks.per_language(gold.limit(0), pred.limit(0), MEMBERS[:3]).count() == 0
