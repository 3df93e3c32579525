"""Alignment, languages, absent labels, several scorers: cases that must not pass silently."""

import tempfile

import pytest
from pyspark.sql import functions as F

from votelab.functions import decode as D
from votelab.functions import text as X
from votelab.operators import ensemble as E
from votelab.operators import schema as S
from votelab.operators.scoring import LexiconScorer, score_texts
from votelab.plans import leaderboard as L
from votelab.session import ensure_checkpoint_dir
from votelab.sources import files as IO

ROWS = [("xx", m, i, lab, (i + k) % 2) for k, m in enumerate(("a", "b", "c")) for i in range(4) for lab in ("p", "q")]
KIND = "lang string, model string, id long, label string, value int"


def _tables(spark, rows):
    pred = spark.createDataFrame(rows, KIND)
    gold = pred.where("model = 'a'").drop("model")
    return pred, gold


@pytest.mark.parametrize("fault", ["missing", "repeated", "differing"])
def test_misaligned_members_end_every_vote(spark, fault):
    rows = [r for r in ROWS if fault != "missing" or r[1:3] != ("b", 2)]
    rows += [] if fault == "missing" else [("xx", "b", 2, "p", 1 if fault == "repeated" else 0)]
    pred, gold = _tables(spark, rows)
    calls = [lambda **k: L.ensemble_votes(pred, ["a", "b", "c"], **k), lambda **k: E.vote_fixed(pred, ["a", "b", "c"], **k),
             lambda **k: E.vote_fixed_paired(pred, gold, ["a", "b", "c"], **k), lambda **k: L.per_language(gold, pred, ["a", "b", "c"], **k)]
    for call in calls:
        with pytest.raises(Exception, match="not aligned"):
            call().collect()
        assert call(misaligned="zero").collect()


@pytest.mark.parametrize("rule,kind", [("majority", "binary"), ("union", "intensity")])
def test_both_vote_paths_agree_on_misaligned_members(spark, rule, kind):
    rows = [r for r in ROWS if r[1:3] != ("b", 2)] + [("xx", "c", 1, "p", 2), (None, "a", 1, "p", 1), ("yy", "a", 1, "p", 1)]
    pred, _ = _tables(spark, rows)
    sweep = L.ensemble_votes(pred, ["a", "b", "c"], rule, kind, misaligned="zero").where("combo = 'a_b_c'").drop("combo")
    fixed = E.vote_fixed(pred, ["a", "b", "c"], rule, kind, misaligned="zero")
    rows = lambda df: sorted(map(tuple, df.select("lang", "id", "label", "value").collect()))
    assert rows(sweep) == rows(fixed) and len(rows(fixed)) == 8


def test_null_language_has_one_rule_on_every_path(spark, monkeypatch):
    pred, _ = _tables(spark, ROWS + [(None, m, 1, "p", 1) for m in "abc"])
    got = lambda: sorted(map(tuple, L.ensemble_votes(pred, ["a", "b", "c"]).collect()))
    inline = got()
    monkeypatch.setattr(E, "MAX_INLINE_LANGS", 0)
    assert got() == inline and all(r[1] == "xx" for r in inline)
    catalog = spark.createDataFrame([("xx", "p"), (None, "p")], "lang string, label string")
    keys = spark.createDataFrame([("xx", 1), (None, 2)], "lang string, id long")
    fan = lambda: [tuple(r) for r in D.with_language_labels(keys, catalog).collect()]
    assert fan() == [("xx", 1, "p")]
    monkeypatch.setattr(D, "MAX_INLINE_CATALOG", 0)
    assert fan() == [("xx", 1, "p")]


def test_pool_reads_every_language(spark, monkeypatch):
    from votelab.sources import fixtures as fx

    tables = {"documents": spark.createDataFrame([(1, "it", "a"), (2, None, "b"), (3, "es", "c"), (4, "de", "d"), (5, "en", "e")], "doc_id long, lang string, text string"),
              "labels": spark.createDataFrame([(i, 1, 1) for i in range(1, 6)], "doc_id long, quality int, toxic int")}
    monkeypatch.setattr(fx, "read_table", lambda spark, sf, name: tables[name])
    frames = fx.train_raw_by_lang(spark, "")
    pool = {r["id"]: (r["lang"], r["toxic"]) for r in S.train_pool(frames).collect()}
    assert pool == {1: ("it", 1), 2: (None, 1), 3: ("es", 0), 4: ("de", 1), 5: ("en", 1)}
    long = {(r["id"], r["label"]) for r in S.long_per_file(frames).collect()}
    assert long == {(i, lab) for i in range(1, 6) for lab in ("quality", "toxic")} - {(3, "toxic")}


def test_absent_labels_stay_absent_in_csv(spark):
    d = tempfile.mkdtemp(prefix="votelab-wide-")
    rows = [("de", 1, "joy", 1), ("de", 1, "fear", 0), ("es", 2, "joy", 1), (None, 3, "fear", 1), (None, 3, "joy", 0)]
    long = spark.createDataFrame(rows, "lang string, id long, label string, value int")
    IO.write_wide_csv(long, d)
    back = IO.scan_long(spark, f"{d}/*/part-*.csv")
    assert sorted(((r.lang or "", int(r.id), r.label, r.value) for r in back.collect())) == sorted((a or "", b, c, v) for a, b, c, v in rows)
    pool = {int(r.id): (r.joy, r.fear) for r in IO.scan_pool(spark, f"{d}/*/part-*.csv").collect()}
    assert pool == {1: (1, 0), 2: (1, 0), 3: (0, 1)}


def test_two_scorers_in_one_session_and_in_one_pass(spark):
    texts = spark.createDataFrame([("en", 1, "aaa bbb bbb")], "lang string, id long, text string")
    one, two = (lambda: LexiconScorer({"x": ["aaa"]}, "one")), (lambda: LexiconScorer({"y": ["bbb"]}, "two"))
    first = [tuple(r) for r in score_texts(texts, one).collect()]
    second = [tuple(r) for r in score_texts(texts, two).collect()]
    assert first[0][1:4] == ("one", 1, "x") and second[0][1:4] == ("two", 1, "y")
    assert sorted(tuple(r) for r in score_texts(texts, [one, two]).collect()) == sorted(first + second)


def test_texts_without_scores_get_zeros(spark):
    scores = spark.createDataFrame([("en", "m", 1, "Joy", 0.9), ("en", "m", 1, "joy", 0.1), ("en", "m", 1, "odd", 0.9)], "lang string, model string, id long, label string, score double")
    catalog = spark.createDataFrame([("en", "joy"), ("en", "fear")], "lang string, label string")
    texts = spark.createDataFrame([("en", 1), ("en", 2), ("xx", 3)], "lang string, id long")
    got = {(r.model, r.id, r.label): r.value for r in D.decode_scores(scores, catalog, "binary", texts, ["m", "n"]).collect()}
    assert got == {(m, i, lab): int((m, i, lab) == ("m", 1, "joy")) for m in "mn" for i in (1, 2) for lab in ("joy", "fear")}


def test_emoji_dictionary_longest_sequence_first(spark):
    thumbs, tone, heart, family = "\U0001F44D", "\U0001F44D\U0001F3FD", "\u2764", "\U0001F468\u200D\U0001F469"
    names = [(thumbs, "thumbs"), (tone, "thumbs_medium"), (heart, "heart"), (family, "family")]
    text = f"a{tone}b{thumbs}c{heart}d{family}e\U0001F600"
    got = spark.createDataFrame([(text,)], "t string").select(X.replace_emojis("t", names).alias("x")).first().x
    assert got == "a thumbs_medium b thumbs c heart d family e\U0001F600"


def test_large_intensity_is_kept(spark):
    got = spark.range(1).select(D.intensity_for(D.intensity_pairs(F.lit("joy(3), joy(99999999999)")), F.lit("joy")).alias("v")).first().v
    assert got == 99999999999


def test_scratch_folder_must_be_given_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "yarn"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
