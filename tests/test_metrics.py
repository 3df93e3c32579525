"""Metric suite: zero division, multiclass classes, brute force cross-checks, invariants."""

import random

import pytest
from pyspark.sql import functions as F

from votelab.operators import metrics as M
from votelab.plans import leaderboard as L
from votelab.sources import fixtures as fx

SF = "/root/testdata/sf0.001"
MEMBERS = [m for m, _, _ in fx.MEMBERS]


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "g string, lang string, id long, label string, gold int, pred int")


def _brute_multilabel(rows):
    """Plain-Python reference: rows of (id, label, gold, pred) for one group."""
    labels = sorted({r[1] for r in rows})
    out = {}
    per = []
    T = FP = FN = 0
    for lab in labels:
        tp = sum(1 for r in rows if r[1] == lab and r[2] == 1 and r[3] == 1)
        fp = sum(1 for r in rows if r[1] == lab and r[2] == 0 and r[3] == 1)
        fn = sum(1 for r in rows if r[1] == lab and r[2] == 1 and r[3] == 0)
        p = tp / (tp + fp) if tp + fp else 0.0
        rc = tp / (tp + fn) if tp + fn else 0.0
        f = 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        per.append((p, rc, f, tp + fn))
        T, FP, FN = T + tp, FP + fp, FN + fn
    n = len(per)
    out["precision_macro"] = sum(x[0] for x in per) / n
    out["recall_macro"] = sum(x[1] for x in per) / n
    out["f1_macro"] = sum(x[2] for x in per) / n
    out["precision_micro"] = T / (T + FP) if T + FP else 0.0
    out["recall_micro"] = T / (T + FN) if T + FN else 0.0
    out["f1_micro"] = 2 * T / (2 * T + FP + FN) if 2 * T + FP + FN else 0.0
    S = sum(x[3] for x in per)
    out["precision_weighted"] = sum(x[0] * x[3] for x in per) / S if S else 0.0
    out["recall_weighted"] = sum(x[1] * x[3] for x in per) / S if S else 0.0
    out["f1_weighted"] = sum(x[2] * x[3] for x in per) / S if S else 0.0
    ids = {r[0] for r in rows}
    out["accuracy"] = sum(all(r[2] == r[3] for r in rows if r[0] == i) for i in ids) / len(ids)
    return out


def test_zero_division_label_counts_in_macro(spark):
    rows = [("g", "en", 1, "a", 1, 1), ("g", "en", 1, "b", 0, 0), ("g", "en", 2, "a", 0, 0), ("g", "en", 2, "b", 0, 0)]
    r = M.multilabel_report(_pairs(spark, rows), ["g", "lang"]).collect()[0]
    assert r.f1_macro == pytest.approx(0.5)  # label b: no positive anywhere -> 0, still averaged
    assert r.precision_macro == pytest.approx(0.5)
    assert r.f1_micro == pytest.approx(1.0)
    assert r.f1_weighted == pytest.approx(1.0)
    assert r.accuracy == pytest.approx(1.0)


def test_random_multilabel_against_brute_force(spark):
    rnd = random.Random(7)
    rows = [("g", "en", i, lab, rnd.randint(0, 1), rnd.randint(0, 1)) for i in range(60) for lab in "abcd"]
    rows += [("g", "en", 99, "e", 0, 0)]
    got = M.multilabel_report(_pairs(spark, rows), ["g", "lang"]).collect()[0].asDict()
    want = _brute_multilabel([(r[2], r[3], r[4], r[5]) for r in rows])
    for k, v in want.items():
        assert got[k] == pytest.approx(v), k


def test_multiclass_classes_from_gold_or_pred(spark):
    rows = [("g", "en", 1, "x", 0, 0), ("g", "en", 2, "x", 0, 1), ("g", "en", 3, "x", 3, 3)]
    cube = M.confusion_cube(_pairs(spark, rows), ["g", "lang"])
    r = M.multiclass_report(cube, ["g", "lang"]).collect()[0]
    assert r.f1_macro == pytest.approx((2 / 3 + 0 + 1) / 3)
    assert r.f1_micro == pytest.approx(2 / 3)
    assert r.accuracy == pytest.approx(2 / 3)
    assert r.recall_weighted == pytest.approx(2 / 3)


def test_samples_f1_zero_for_empty_rows(spark):
    from votelab.operators.split import training_metrics
    rows = [("m", "en", 1, "a", 0, 0), ("m", "en", 1, "b", 0, 0), ("m", "en", 2, "a", 1, 1), ("m", "en", 2, "b", 0, 0)]
    df = spark.createDataFrame(rows, "model string, lang string, id long, label string, gold int, pred int")
    r = training_metrics(df, ["model"]).collect()[0]
    assert r.samples_f1 == pytest.approx(0.5)
    assert r.overall_accuracy == pytest.approx(1.0)
    assert r.samples_accuracy == pytest.approx(1.0)


def test_pearson_constant_is_null(spark):
    cube = spark.createDataFrame([("k", "x", 1, 0, 3), ("k", "x", 1, 1, 2)], "k string, label string, gold int, pred int, n long")
    r = M.pearson_per_label(cube, ["k"]).collect()[0]
    assert r.pearson is None


def test_leaderboard_invariants(spark):
    g, p = fx.gold_table(spark, SF), fx.pred_table(spark, SF)
    maj = {r.model: r for r in L.leaderboard(g, p, MEMBERS, "majority").collect()}
    uni = {r.model: r for r in L.leaderboard(g, p, MEMBERS, "union").collect()}
    assert len(maj) == len(uni) == 26
    for k in maj:
        assert maj[k].avg_recall_micro == pytest.approx(maj[k].avg_recall_weighted)
        assert uni[k].avg_recall_micro >= maj[k].avg_recall_micro - 1e-12
    gb, pb = fx.gold_table(spark, SF, "intensity"), fx.pred_table(spark, SF, "intensity")
    for r in L.leaderboard(gb, pb, MEMBERS, "majority", "intensity").collect():
        assert r.avg_precision_micro == pytest.approx(r.avg_accuracy)
        assert r.avg_f1_micro == pytest.approx(r.avg_accuracy)
        assert r.avg_recall_weighted == pytest.approx(r.avg_accuracy)


def test_compact_leaderboard_matches_brute_force(spark):
    """Per (combo, lang) metrics of the compact plan against a plain-Python ensemble + metrics."""
    g, p = fx.gold_table(spark, SF), fx.pred_table(spark, SF)
    per = {(r.combo, r.lang): r for r in L.per_language(g, p, MEMBERS, "majority").collect()}
    gold = {(r.lang, r.id, r.label): r.value for r in g.collect()}
    preds = {}
    for r in p.collect():
        preds.setdefault((r.lang, r.id, r.label), {})[r.model] = r.value
    langs_models = {}
    for (lang, _, _), d in preds.items():
        langs_models.setdefault(lang, set()).update(d)
    for combo in ("m1_m2", "m1_m3_m5", "m2_m4_m5", "m1_m2_m3_m4_m5"):
        ms = combo.split("_")
        thr = len(ms) // 2 + 1
        for lang in ("de", "en", "es", "fr"):
            if not set(ms) <= langs_models.get(lang, set()):
                assert (combo, lang) not in per
                continue
            rows = []
            for (lg, i, lab), gv in gold.items():
                if lg != lang:
                    continue
                s = sum(preds.get((lg, i, lab), {}).get(m, 0) for m in ms)
                rows.append((i, lab, gv, int(s >= thr)))
            want = _brute_multilabel(rows)
            got = per[(combo, lang)].asDict()
            for k, v in want.items():
                assert got[k] == pytest.approx(v), (combo, lang, k)


def test_rules_in_one_pass_equal_separate(spark):
    """Both rules fanned out in one pass (rule column) give each single-rule result."""
    gb, pb = fx.gold_table(spark, SF, "intensity"), fx.pred_table(spark, SF, "intensity")
    both = {(r.rule, r.combo): r for r in L.pearson(gb, pb, MEMBERS, ["majority", "union"]).collect()}
    for rule in ("majority", "union"):
        one = {r.combo: r for r in L.pearson(gb, pb, MEMBERS, rule).collect()}
        assert {c for (ru, c) in both if ru == rule} == set(one)
        for c, r in one.items():
            assert both[(rule, c)].n_langs == r.n_langs
            if r.avg_pearson is None:
                assert both[(rule, c)].avg_pearson is None
            else:
                assert both[(rule, c)].avg_pearson == pytest.approx(r.avg_pearson)
