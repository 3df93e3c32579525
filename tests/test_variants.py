"""Run variants (P13 + C3 + T3): the one-pass variant query against a pandas / plain-Python computation
on the smallest scale."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from votelab.functions import text as X
from votelab.operators import schema as S
from votelab.operators.scoring import DEFAULT_LEXICON, LexiconScorer
from votelab.plans import queries_models as Q
from votelab.sources import fixtures as fx
from test_metrics import _brute_multilabel

SF = "/root/testdata/sf0.001"


def test_process_name_from_columns(spark):
    df = spark.createDataFrame([(True, False, True), (False, False, False), (True, True, True)],
                               "baseline boolean, preprocessing boolean, augmentation boolean")
    names = [r.p for r in df.select(S.process_name({c: F.col(c) for c in df.columns}).alias("p")).collect()]
    assert names == ["baseline_augmentation", "", "baseline_preprocessing_augmentation"]


def test_eval_variants_against_pandas(spark):
    got = {r.process: r.asDict() for r in Q.eval_variants(spark, SF).collect()}
    assert set(got) == {"baseline_augmentation", "baseline_preprocessing_augmentation"}
    gold = {(r.lang, r.id, r.label): r.value for r in fx.gold_table(spark, SF).collect()}
    ids = {(lang, i) for lang, i, _ in gold}
    texts = [r for r in fx.texts(spark, SF).select(
        "lang", "id", X.truncate_words("text").alias("raw"),
        X.truncate_words(X.preprocess_text("text")).alias("pre")).collect() if (r.lang, r.id) in ids]
    scorer = LexiconScorer(DEFAULT_LEXICON)
    for process, col in (("baseline_augmentation", "raw"), ("baseline_preprocessing_augmentation", "pre")):
        sc = scorer.score(pd.Series([getattr(t, col) for t in texts]))
        per_lang = {}
        for k, t in enumerate(texts):
            for lab in DEFAULT_LEXICON:
                if (t.lang, t.id, lab) in gold:
                    per_lang.setdefault(t.lang, []).append(
                        (t.id, lab, gold[(t.lang, t.id, lab)], int(sc[lab].iloc[k] > 0.5)))
        want = [_brute_multilabel(rows) for rows in per_lang.values()]
        row = got[process]
        assert row["n_langs"] == len(want)
        for m in want[0]:
            assert row[f"avg_{m}"] == pytest.approx(sum(w[m] for w in want) / len(want), abs=1e-6), (process, m)
