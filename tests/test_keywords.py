"""Keyword counts and emoji names against plain Python."""

import random
import re

import pandas as pd

from pyspark.sql import functions as F

from votelab.functions import text as X
from votelab.functions.keywords import Words
from votelab.operators.scoring import DEFAULT_LEXICON, LexiconScorer

ODD = ["", None, "kill", "KILL kill Kill", "killkill kill_ _kill kill1", "ékill killé kill-kill", "kill\x0bkill\x1ckill\x85kill kill",
       "a" * 3000, "kill " * 3000, "日本kill語", "Kill", "stupid idiot", "however,therefore;because"]


def _texts():
    rng = random.Random(1)
    parts = ["kill", "Hate", "research", "RESULTS", "the", "é", "-", "_", "1", " ", "\n", "\t", "  ", "日", "analysis", "analysisx", "abcdefghijklmnopq"]
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 60))) for _ in range(400)]


def test_counts_equal_a_regex():
    texts = _texts()
    w = Words(texts)
    assert w.spaced().tolist() == [len(re.findall(r"\S+", t or "", re.ASCII)) for t in texts]
    for keys in (["kill"], ["Kill", "hate", "analysis"], ["abcdefghijklmnopq", "research", "x"], ["1", "_", "absent"], []):
        pat = re.compile(r"\b(?:" + "|".join(keys) + r")\b", re.I | re.ASCII)
        assert w.hits(keys).tolist() == [len(pat.findall(t or "")) if keys else 0 for t in texts]
    assert Words([]).hits(["a"]).tolist() == [] and Words([None]).spaced().tolist() == [0]


def test_scores_equal_a_regex_a_label():
    texts = pd.Series([t or "" for t in _texts()])
    lexicon = {**DEFAULT_LEXICON, "phrase": ["the kill", "don't", "hate"]}
    got = LexiconScorer(lexicon).score(texts)
    for label, keys in lexicon.items():
        pat = re.compile(r"\b(?:" + "|".join(map(re.escape, keys)) + r")\b", re.I | re.ASCII)
        want = [1 - 0.5 ** (len(pat.findall(t)) * 100 / max(1, len(re.findall(r"\S+", t, re.ASCII)))) for t in texts]
        assert (got[label] - want).abs().max() < 1e-12


def _replaced(names: dict[str, str], text: str) -> str:
    pat = re.compile("|".join(re.escape(k) for k in sorted(names, key=len, reverse=True)))
    return pat.sub(lambda m: f" {names[m[0]]} ", text)


def test_emoji_tables_equal_a_dictionary(spark):
    rng = random.Random(2)
    wide = {"❤": "heart", "❤️": "red_heart", "\U0001F469‍\U0001F4BB": "technologist", "\U0001F1E9\U0001F1EA": "germany",
            "\U0001F469": "woman", "☺": "it's \\smiling", "\U0001FAFF": "last", "é": "letter"}
    for names in (dict(X.default_emoji_names()), wide, {k: v for k, v in wide.items() if len(k) > 1}, {"\U0001F469": "woman"}):
        pool = [*rng.sample(sorted(names), min(40, len(names))), "a", " ", "❤", "\U0001F469", "‍", "️", "x\n", "\U0001F4BB", "\U00010000"]
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(12))) for _ in range(150)] + ["", "plain"]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r.i: r.x for r in df.select("i", X.replace_emojis("t", tuple(names.items())).alias("x")).collect()}
        assert got == {i: _replaced(names, t) for i, t in enumerate(texts)}
    assert spark.range(1).select(X.replace_emojis(F.lit(None).cast("string")).alias("x")).first().x is None


def test_truncation_keeps_the_first_words(spark):
    texts = ["", "  ", " a  b\t\nc ", "a b c d", "\x0b\x0ca b\rc d e ", "a", "a b c ", "日 本 語 x y"]
    got = [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(X.truncate_words("t", 3).alias("x")).collect()]
    assert got == [" ".join(re.findall(r"\S+", t, re.ASCII)[:3]) for t in texts]
