"""Skew: a language holding most rows and one cell repeated hundreds of times must give the same
results as a plain-Python computation (duplicates collapse by max, a member without a value votes
0, a combo runs only where every member has the language)."""

import random

import pytest

from votelab.plans import leaderboard as L
from votelab.sources import gates as G
from test_metrics import _brute_multilabel

MEMBERS = ["m1", "m2", "m3"]
LABELS = {"hot": ["x", "y", "z"], "a": ["x", "y", "z"], "b": ["x", "y"]}
IDS = {"hot": 600, "a": 100, "b": 100}
HOT_DUPS = 400


def _skewed_tables():
    rnd = random.Random(7)
    gold, pred = [], []
    for lang, n in IDS.items():
        for i in range(n):
            for lab in LABELS[lang]:
                g = rnd.randint(0, 1)
                gold.append((lang, i, lab, g))
                for m in MEMBERS:
                    if m == "m3" and lang == "a":
                        continue  # m3 has no predictions for language a
                    if rnd.random() < 0.05:
                        continue  # an id this member lacks
                    pred.append((lang, m, i, lab, g if rnd.random() < 0.7 else 1 - g))
    # one hot cell repeated: zeros, and a single 1 among them (max -> 1)
    pred += [("hot", "m1", 0, "x", 0)] * HOT_DUPS + [("hot", "m1", 0, "x", 1)]
    assert sum(1 for r in pred if r[0] == "hot") > len(pred) / 3
    return gold, pred


def _brute(gold, pred, combo, rule):
    cells = {}
    for lang, m, i, lab, v in pred:
        k = (lang, i, lab)
        cells.setdefault(k, {})
        cells[k][m] = max(cells[k].get(m, 0), v)
    present = {}
    for lang, m, *_ in pred:
        present.setdefault(lang, set()).add(m)
    thr = len(combo) // 2 + 1 if rule == "majority" else 1
    out = {}
    for lang in IDS:
        if not set(combo) <= present.get(lang, set()):
            continue
        rows = []
        for lg, i, lab, g in gold:
            if lg != lang:
                continue
            s = sum(cells.get((lg, i, lab), {}).get(m, 0) for m in combo)
            rows.append((i, lab, g, int(s >= thr)))
        out[lang] = _brute_multilabel(rows)
    return out


@pytest.mark.parametrize("rule", ["majority", "union"])
def test_skewed_language_and_hot_cell(spark, rule):
    gold, pred = _skewed_tables()
    g = spark.createDataFrame(gold, "lang string, id long, label string, value int")
    p = spark.createDataFrame(pred, "lang string, model string, id long, label string, value int")
    got = {(r.combo, r.lang): r.asDict() for r in L.per_language(g, p, MEMBERS, rule, misaligned="zero").collect()}
    seen = set()
    for combo in (["m1", "m2"], ["m1", "m3"], ["m2", "m3"], ["m1", "m2", "m3"]):
        name = "_".join(combo)
        want = _brute(gold, pred, combo, rule)
        for lang, metrics in want.items():
            seen.add((name, lang))
            for k, v in metrics.items():
                assert got[(name, lang)][k] == pytest.approx(v), (name, lang, k)
    # combos with m3 are skipped on language a, nothing else is missing or extra
    assert set(got) == seen
    assert ("m1_m3", "a") not in got and ("m1_m2", "a") in got


def test_resume_gate_keeps_inputs_without_usable_output(spark):
    inputs = spark.createDataFrame([("de", 1), ("de", 2), ("en", 1), ("en", 3)], "lang string, id long")
    done = spark.createDataFrame([("de", 1), ("en", 3), ("fr", 9)], "lang string, id long")
    got = sorted(tuple(r) for r in G.pending(inputs, done, ["lang", "id"]).collect())
    assert got == [("de", 2), ("en", 1)]


def test_weighted_pairs_equal_join_path(spark):
    """Per-model reports from the one-shuffle weighted pairs equal the plain join path (missing cells
    are left out of both; no copies here, where the two differ by design)."""
    from votelab.operators import metrics as M
    from votelab.plans import paired as PA

    gold, pred = _skewed_tables()
    pred = pred[:-(HOT_DUPS + 1)]
    g = spark.createDataFrame(gold, "lang string, id long, label string, value int")
    p = spark.createDataFrame(pred, "lang string, model string, id long, label string, value int")
    pairs = p.withColumnRenamed("value", "pred").join(g.withColumnRenamed("value", "gold"), ["lang", "id", "label"])
    keys = ["model", "lang"]
    want = {(r.model, r.lang): r.asDict() for r in M.multilabel_report(pairs, keys).collect()}
    got = {(r.model, r.lang): r.asDict() for r in PA.multilabel_report(PA.weighted_pairs(g, p), keys).collect()}
    assert set(got) == set(want)
    for k, row in want.items():
        for m in M.METRICS + ["n_rows"]:
            assert got[k][m] == pytest.approx(row[m]), (k, m)
    cube_want = sorted(tuple(r) for r in M.confusion_cube(pairs, keys).collect())
    cube_got = sorted(tuple(r) for r in PA.confusion_cube(PA.weighted_pairs(g, p), keys).collect())
    assert cube_got == cube_want


@pytest.mark.parametrize("rule,kind", [("majority", "binary"), ("union", "binary"), ("majority", "intensity")])
def test_fixed_vote_paired_equals_vote_then_join(spark, rule, kind):
    from votelab.operators import ensemble as E

    gold, pred = _skewed_tables()
    pred = pred[:-(HOT_DUPS + 1)]
    gold = [r for r in gold if r[1] % 7]  # cells without gold
    g = spark.createDataFrame(gold, "lang string, id long, label string, value int")
    p = spark.createDataFrame(pred, "lang string, model string, id long, label string, value int")
    ms = ["m1", "m2", "m3"]
    want = sorted(tuple(r) for r in E.vote_fixed(p, ms, rule, kind, misaligned="zero").join(
        g.withColumnRenamed("value", "gold"), ["lang", "id", "label"]).select(
        "lang", "id", "label", "gold", "value").collect())
    got = sorted(tuple(r) for r in E.vote_fixed_paired(p, g, ms, rule, kind, misaligned="zero").collect())
    assert got == want and len(got) > 0


def test_training_metrics_weighted_equal_join_path(spark):
    """M11-M13 from weighted pairs equal the per-row form over joined pairs (rows with no positive
    included)."""
    from votelab.operators.split import training_metrics
    from votelab.plans import paired as PA

    gold, pred = _skewed_tables()
    pred = pred[:-(HOT_DUPS + 1)]
    gold += [("b", 1000 + i, lab, 0) for i in range(20) for lab in ("x", "y")]
    pred += [("b", m, 1000 + i, lab, 0) for i in range(20) for lab in ("x", "y") for m in MEMBERS]
    g = spark.createDataFrame(gold, "lang string, id long, label string, value int")
    p = spark.createDataFrame(pred, "lang string, model string, id long, label string, value int")
    pairs = p.withColumnRenamed("value", "pred").join(g.withColumnRenamed("value", "gold"), ["lang", "id", "label"])
    want = {r.model: r.asDict() for r in training_metrics(pairs, ["model"]).collect()}
    got = {r.model: r.asDict() for r in PA.training_metrics(PA.weighted_pairs(g, p), ["model"]).collect()}
    assert set(got) == set(want) == set(MEMBERS)
    for m, row in want.items():
        for k in ("overall_accuracy", "samples_accuracy", "overall_f1", "samples_f1"):
            assert got[m][k] == pytest.approx(row[k]), (m, k)


def test_language_label_fanout_inline_equals_join(spark, monkeypatch):
    """The constant-map fan-out / filter and the broadcast-join fallback give the same rows and columns."""
    from votelab.functions import decode as D

    rows = spark.createDataFrame([("de", 1, "x"), ("de", 2, "z"), ("fr", 3, "x"), ("it", 4, "x")],
                                 "lang string, id long, label string")
    keys = rows.select("lang", "id").distinct()
    cat = spark.createDataFrame([("de", "x"), ("de", "y"), ("fr", "x")], "lang string, label string")

    def run():
        fan = D.with_language_labels(keys, cat)
        kept = D.in_language_labels(rows, cat)
        return (fan.columns, sorted(map(tuple, fan.collect())), kept.columns, sorted(map(tuple, kept.collect())))

    inline = run()
    monkeypatch.setattr(D, "MAX_INLINE_CATALOG", 0)
    assert run() == inline
    assert inline[1] == [("de", 1, "x"), ("de", 1, "y"), ("de", 2, "x"), ("de", 2, "y"), ("fr", 3, "x")]
    assert inline[3] == [("de", 1, "x"), ("fr", 3, "x")]
