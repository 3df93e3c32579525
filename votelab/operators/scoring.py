"""T3 batch scoring and T4 baseline training.

T3: texts ``(lang, id, text)`` -> long scores ``(lang, model, id, label, score)`` through pluggable
scorers run with ``mapInPandas``: Arrow batches in, one instance of each scorer per Python worker and
call (loaded on first use, not per row), long rows out. Several scorers share one pass over the texts. Preprocessing and truncation stay JVM-side before the
Python boundary. The default scorer is a small deterministic keyword lexicon standing in for a
transformer; real models are the caller's (any object with ``labels`` and ``score(texts)``). A scorer with a method
``score_words`` gets the batch's words instead, which are found once for all such scorers.

T4: the trainer is re-aimed at ``pyspark.ml``: RegexTokenizer -> HashingTF -> IDF -> one
LogisticRegression per label on the train split; probabilities of the held-out split become scores.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keywords import PLAIN, Words
from ..session import scratch_path, ship_package

SCORES_SCHEMA = "lang string, model string, id long, label string, score double"


class LexiconScorer:
    """score(label) = 1 - 0.5 ** hits, hits = keyword matches per 100 words (vectorised numpy). Keywords match whole
    words, without regard to the case of ASCII letters; those that are no single word are found by a regex."""

    def __init__(self, lexicon: dict[str, list[str]], name: str = "lexicon"):
        self.name = name
        self.labels = list(lexicon)
        self.lexicon = lexicon
        # alternatives of one regex exclude each other at a place, so such a list isn't split
        self.patterns = {lab: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.I | re.ASCII)
                         for lab, words in lexicon.items() if not all(map(PLAIN.fullmatch, words))}

    def score(self, texts: pd.Series) -> pd.DataFrame:
        return self.score_words(Words(texts), texts)

    def score_words(self, words: Words, texts: pd.Series) -> pd.DataFrame:
        per = 100.0 / np.maximum(words.spaced(), 1)
        out = {}
        for lab, keys in self.lexicon.items():
            n = texts.str.count(self.patterns[lab]).to_numpy() if lab in self.patterns else words.hits(keys)
            out[lab] = 1.0 - 0.5 ** (n * per)
        return pd.DataFrame(out, index=texts.index)


# The default lexicon of the stand-in scorer (labels of the fixture gold).
DEFAULT_LEXICON = {
    "quality": ["therefore", "because", "however", "research", "study", "analysis", "results", "method"],
    "toxic": ["hate", "stupid", "idiot", "kill", "damn", "ugly", "dumb", "trash"],
}

# Scorers of the calls a worker has served last, by call: a reused worker never hands one call's
# scorers to another.
_SCORERS: dict[str, list] = {}
_CALLS_KEPT = 4


def _scorers(call: str, factories: list) -> list:
    if call not in _SCORERS:
        while len(_SCORERS) >= _CALLS_KEPT:
            _SCORERS.pop(next(iter(_SCORERS)))
        _SCORERS[call] = [f() for f in factories]
    return _SCORERS[call]


def score_texts(texts: DataFrame, factory=None, preprocess: bool = True,
                max_words: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """Long scores for every text. ``factory`` is a function that builds a scorer, or a list of such
    functions: all of them score each text in the same pass. A scorer's ``name`` is its model name.
    ``carry`` names extra key columns passed through to the output (after ``id``)."""
    factories = list(factory) if isinstance(factory, (list, tuple)) else [factory or (lambda: LexiconScorer(DEFAULT_LEXICON))]
    call = uuid.uuid4().hex
    ship_package(texts.sparkSession)  # the batch function below runs this package's code in workers
    t = X.preprocess_text("text") if preprocess else F.col("text")
    prepared = texts.select("lang", F.col("id").cast("long").alias("id"), *carry,
                            X.truncate_words(t, max_words).alias("text"))
    keys = ["lang", "id", *carry]
    out_cols = ["lang", "model", "id", *carry, "label", "score"]
    schema = SCORES_SCHEMA
    if carry:
        types = {f.name: f.dataType.simpleString() for f in prepared.schema.fields}
        schema = ("lang string, model string, id long, " + ", ".join(f"{c} {types[c]}" for c in carry) +
                  ", label string, score double")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            texts = pdf["text"].fillna("")
            words = None
            for n, scorer in enumerate(_scorers(call, factories)):
                if hasattr(scorer, "score_words"):
                    words = words or Words(texts)
                    sc = scorer.score_words(words, texts)
                else:
                    sc = scorer.score(texts)
                for label in sc.columns:
                    long = pdf[keys].assign(label=label, score=sc[label].to_numpy(), model=getattr(scorer, "name", f"scorer{n}"))
                    yield long[out_cols]

    return prepared.mapInPandas(run, schema)


def train_baseline(pool: DataFrame, labels: list[str], split_col: str = "split", num_features: int = 1 << 18,
                   model_name: str = "tfidf-lr") -> DataFrame:
    """T4: fit one logistic regression per label on the train split; score the test split.
    Returns long scores (lang, model, id, label, score) of the held-out rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    # The pool is read and its texts are split into terms once: both splits' term counts are written to the shared
    # folder for the document frequencies, all label fits (each caches its own blocks) and the scoring.
    terms = Pipeline(stages=[
        RegexTokenizer(inputCol="text", outputCol="tokens", pattern=r"\W+", minTokenLength=2),
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=num_features),
    ])
    base = pool.withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    counted = terms.fit(base).transform(base.where(F.col(split_col).isin("train", "test"))).select(
        "lang", "id", split_col, "tf", *[F.col(lab).cast("double").alias(lab) for lab in labels])
    path = scratch_path(pool.sparkSession, "baseline-terms")
    counted.write.parquet(path)
    counted = pool.sparkSession.read.schema(counted.schema).parquet(path)
    train, test = (counted.where(F.col(split_col) == x) for x in ("train", "test"))
    fmodel = IDF(inputCol="tf", outputCol="features").fit(train)
    train_f = fmodel.transform(train).select("features", *labels)
    fitted = [LogisticRegression(featuresCol="features", labelCol=lab, maxIter=20, regParam=0.01,
                                 probabilityCol=f"prob_{k}", rawPredictionCol=f"raw_{k}",
                                 predictionCol=f"pred_{k}").fit(train_f)
              for k, lab in enumerate(labels)]
    # The held-out split is featurised and scored by every label model in one pass (the models are
    # row-wise maps), then turned into long rows.
    scored = fmodel.transform(test).select("lang", "id", "features")
    for m in fitted:
        scored = m.transform(scored)
    items = F.array(*[F.struct(F.lit(lab).alias("label"), vector_to_array(f"prob_{k}")[1].alias("score"))
                      for k, lab in enumerate(labels)])
    out = scored.select("lang", "id", F.explode(items).alias("x"))
    return out.select("lang", F.lit(model_name).alias("model"), F.col("id").cast("long").alias("id"),
                      "x.label", "x.score")
