"""Edge rules on tiny literal tables (decision thresholds, decoders, parsers, text)."""

import pytest
from pyspark.sql import functions as F

from votelab.functions import decode as D
from votelab.functions import text as X
from votelab.operators import ensemble as E
from votelab.operators import schema as S
from votelab.plans import leaderboard as L


def _votes(spark, rows, members):
    """rows: list of (id, [values per member]) -> long pred table for one language and label."""
    data = [("xx", m, i, "joy", v) for i, vals in rows for m, v in zip(members, vals)]
    return spark.createDataFrame(data, "lang string, model string, id long, label string, value int")


@pytest.mark.parametrize("r, rows, want", [
    (2, [(1, [1, 0]), (2, [1, 1])], {1: 0, 2: 1}),
    (3, [(1, [1, 1, 0]), (2, [1, 0, 0])], {1: 1, 2: 0}),
    (4, [(1, [1, 1, 0, 0]), (2, [1, 1, 1, 0])], {1: 0, 2: 1}),
])
def test_majority_threshold(spark, r, rows, want):
    members = [f"m{i}" for i in range(r)]
    out = L.ensemble_votes(_votes(spark, rows, members), members, "majority", "binary", min_size=r)
    got = {row.id: row.value for row in out.collect()}
    assert got == want


def test_intensity_gate_sums_values(spark):
    members = ["a", "b"]
    rows = [(1, [3, 0]), (2, [1, 0]), (3, [1, 1]), (4, [1, 2])]
    maj = L.ensemble_votes(_votes(spark, rows, members), members, "majority", "intensity")
    assert {r.id: r.value for r in maj.collect()} == {1: 3, 2: 0, 3: 1, 4: 2}
    uni = L.ensemble_votes(_votes(spark, [(1, [1, 0])], members), members, "union", "intensity")
    assert [r.value for r in uni.collect()] == [1]
    bu = E.vote_fixed(_votes(spark, [(1, [0, 3]), (2, [0, 0])], members), members, "union", "binary_union")
    assert {r.id: r.value for r in bu.collect()} == {1: 1, 2: 0}


def test_compact_votes_equal_exploded(spark):
    from votelab.sources import fixtures as fx
    sf = "/root/testdata/sf0.001"
    members = [m for m, _, _ in fx.MEMBERS]
    for kind in ("binary", "intensity"):
        pred = fx.pred_table(spark, sf, kind)
        for rule in ("majority", "union"):
            a = L.ensemble_votes(pred, members, rule, kind)
            b = E.vote_exploded(pred, members, rule, kind)
            assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_combo_count_and_names(spark):
    members = ["x", "y", "z", "w"]
    c = E.combos_frame(spark, members)
    assert c.count() == 2 ** 4 - 4 - 1
    names = {r.combo for r in c.collect()}
    assert "x_y" in names and "y_z_w" in names and "x_y_z_w" in names
    d = E.combos_from_members(E.members_frame(spark, members))
    assert sorted(r.combo for r in d.collect()) != []
    assert d.count() == c.count()


def test_combo_size_guard(spark):
    with pytest.raises(ValueError):
        E.combos_frame(spark, [f"m{i}" for i in range(20)])


def _one(spark, expr, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"v {typ}")
    return df.select(expr(F.col("v")).alias("o")).collect()[0].o


@pytest.mark.parametrize("score, want", [(0.5, 0), (0.5000001, 1), (0.4, 0), (0.9, 1)])
def test_score_threshold_strict(spark, score, want):
    assert _one(spark, D.score_to_binary, score, "double") == want


def test_logit_threshold_inclusive(spark):
    assert _one(spark, D.logit_to_binary, 0.0, "double") == 1
    assert _one(spark, D.logit_to_binary, -1e-9, "double") == 0


@pytest.mark.parametrize("score, want", [(1 / 6, 0), (0.5, 2), (5 / 6, 2), (1.0, 3), (0.0, 0)])
def test_half_even_rounding(spark, score, want):
    assert _one(spark, D.score_to_intensity, score, "double") == want


def _parse_labels(spark, content):
    items = _one(spark, D.label_list, content)
    return items


def test_label_list_parse(spark):
    assert set(_parse_labels(spark, "joy, fear ")) >= {"joy", "fear"}
    assert "joy" not in _parse_labels(spark, "joy.")
    assert _parse_labels(spark, "") == [""]


def test_reply_content(spark):
    assert _one(spark, D.reply_content, '{"error":"busy"}') == ""
    assert _one(spark, D.reply_content, "not json") == ""
    assert _one(spark, D.reply_content, '{"choices":[{"message":{"content":"Joy, FEAR"}}]}') == "joy, fear"


@pytest.mark.parametrize("content, label, want", [
    ("joy(2)., fear (3)", "joy", 0),
    ("joy(2)., fear (3)", "fear", 3),
    ("joy(9), joy(1)", "joy", 1),
    ("joy(-1), fear(+2)", "joy", -1),
    ("joy(-1), fear(+2)", "fear", 2),
    ("joy(2)(3)", "joy", 0),
    ("joy)2(1)", "joy", 0),
    ("fear(1))", "fear", 1),
    ("surprise(0003)", "surprise", 3),
    ("", "joy", 0),
])
def test_intensity_parse(spark, content, label, want):
    df = spark.createDataFrame([(content, label)], "c string, l string")
    got = df.select(D.intensity_for(D.intensity_pairs("c"), F.col("l")).alias("o")).collect()[0].o
    assert got == want


@pytest.mark.parametrize("raw, want", [("1", 1), ("0.9", 0), ("x", 0), (None, 0), ("", 0), ("1e0", 1),
                                       ("nan", 0), ("-1.7", -1), ("1.9", 1)])
def test_coercion(spark, raw, want):
    assert _one(spark, S.coerce_label, raw) == want


def test_emoticons(spark):
    assert _one(spark, X.replace_emoticons, ":( ;:)") == " sad  ; happy "
    assert _one(spark, X.replace_emoticons, "http://x") == "http confused /x"
    assert _one(spark, X.replace_emoticons, ":d") == ":d"


def test_emojis(spark):
    assert _one(spark, X.replace_emojis, "ab\U0001F600cd") == "ab grinning_face cd"
    assert _one(spark, X.replace_emojis, "none here") == "none here"
    assert _one(spark, X.replace_emojis, "\U0001F44D\U0001F44D") == " thumbs_up_sign  thumbs_up_sign "


def test_truncate_words(spark):
    text = " ".join(f"w{i}" for i in range(600))
    out = _one(spark, lambda c: X.truncate_words(c, 512), "  " + text + "\n")
    assert out.split(" ") == [f"w{i}" for i in range(512)]
    assert _one(spark, lambda c: X.truncate_words(c, 512), "a \t b") == "a b"


def test_process_name(spark):
    df = spark.range(1).select(S.process_name({"baseline": True, "preprocessing": False,
                                               "augmentation": True}).alias("p"))
    assert df.collect()[0].p == "baseline_augmentation"


def test_strip_is_unicode(spark):
    assert _one(spark, D.py_strip, "  joy \t") == "joy"
