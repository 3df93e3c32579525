"""The closed-form trainer (T4) against plain counting, and its accuracy on texts that it has not seen."""

import math
import random
import re
from collections import Counter

import pytest

from votelab.operators import bayes as NB

LABELS = ["good", "bad"]
SCHEMA = "lang string, id long, text string, good int, bad int"


def plain(train, test):
    out = {}
    words = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split(r"[\x20\x09-\x0d]+", t or "") if w]
    micro = lambda a, b: round(math.log(a / b) * 1e6)
    for k, lab in enumerate(LABELS):
        n, n1 = Counter(), Counter()
        pos = sum(r[3 + k] == 1 for r in train)
        for r in train:
            for w in words(r[2]):
                n[w] += 1
                n1[w] += r[3 + k] == 1
        v, total, total1 = len(n), sum(n.values()), sum(n1.values())
        odds = {w: micro(n1[w] + 1, total1 + v) - micro(n[w] - n1[w] + 1, total - total1 + v) for w in n}
        for r in test:
            out[r[0], r[1], lab] = micro(pos + 1, len(train) - pos + 1) + sum(odds.get(w, 0) for w in words(r[2]))
    return out


def rows(n, seed, first=0):
    rnd, out = random.Random(seed), []
    for i in range(first, first + n):
        good, bad = rnd.randint(0, 1), rnd.randint(0, 1)
        text = " ".join(rnd.choice(["The", "a", "of\t", "é"] + ["fine", "Nice"] * good + ["vile\n", "awful"] * bad) for _ in range(rnd.randint(3, 30)))
        out.append((rnd.choice(["en", "de", None]), i, text, good, None if bad == 0 and rnd.random() < 0.5 else bad))
    return out


@pytest.mark.parametrize("hot", [1, 10, 10_000])
def test_scores_equal_plain_counting(spark, monkeypatch, hot):
    """With few, some and all words broadcast."""
    monkeypatch.setattr(NB, "HOT", hot)
    train = rows(80, 1) + [("en", 900, None, 1, 0), ("en", 901, "", 0, 1), ("en", 902, "long " * 20_000, 1, 1)]
    test = rows(40, 2, 200) + [("en", 990, None, 0, 0), ("en", 991, " \n", 0, 0), (None, 992, "unseen words", 0, 0), ("en", 993, "the " * 20_000, 0, 0)]
    model = NB.fit(spark.createDataFrame(train, SCHEMA), LABELS)
    got = {(r["lang"], r["id"], r["label"]): r["log_odds"] for r in NB.score(spark.createDataFrame(test, SCHEMA), model, LABELS).collect()}
    assert got == plain(train, test)


def test_held_out_accuracy(spark):
    model = NB.fit(spark.createDataFrame(rows(300, 3), SCHEMA), LABELS)
    test = rows(200, 4, 1000)
    truth = {(r[0], r[1], lab): int(r[3 + k] or 0) for r in test for k, lab in enumerate(LABELS)}
    out = NB.score(spark.createDataFrame(test, SCHEMA), model, LABELS).collect()
    assert sum(int(r["log_odds"] >= 0) == truth[r["lang"], r["id"], r["label"]] for r in out) / len(out) > 0.9


def test_empty_training_and_empty_input(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = NB.fit(none, LABELS)
    some = spark.createDataFrame(rows(3, 5), SCHEMA)
    assert {r["log_odds"] for r in NB.score(some, model, LABELS).collect()} == {0}
    assert NB.score(none, model, LABELS).count() == 0
