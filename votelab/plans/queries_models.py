"""Registered queries for model work and streaming: T3 batch scoring, T4 baseline training, ST1."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import text as X
from ..operators import bayes as NB
from ..operators import metrics as M
from ..operators import schema as S
from ..operators import scoring as SC
from ..operators import split as T
from ..registry import register
from ..session import scratch_path
from ..sources import fixtures as fx
from ..streaming import responses as ST
from . import paired as PA
from .queries import _r
from .queries_text import parse_intensity_sql


# A second stand-in scorer, scored in the same pass as the default one.
SECOND_LEXICON = {"quality": ["the", "and"], "toxic": ["scum", "moron", "loser", "worthless", "disgusting", "clown"]}


def _scorer_sql(text: str, name: str, lexicon: dict[str, list[str]]) -> str:
    """(lang, model, id, label, score) of a lexicon scorer over ``t(lang, id, <text>)``, written out in SQL."""
    def one(label: str, words: list[str]) -> str:
        hits = f"len(regexp_extract_all({text}, '(?i)\\b(?:{'|'.join(words)})\\b'))"
        size = f"greatest(len(regexp_extract_all({text}, '\\S+')), 1)"
        return (f"SELECT *, '{name}' AS model, '{label}' AS label, "
                f"CAST(1 - pow(CAST(0.5 AS DOUBLE), {hits} * CAST(100 AS DOUBLE) / {size}) AS DOUBLE) AS score FROM t")
    return " UNION ALL ".join(one(label, words) for label, words in lexicon.items())


def _prepared_sql(preprocessed: bool = True) -> str:
    text = X.replace_emojis_sql(X.replace_emoticons_sql("text")) if preprocessed else "text"
    return f"SELECT lang, id, {X.truncate_words_sql('x')} AS x FROM (SELECT lang, id, {text} AS x FROM texts)"


def score_texts_sql() -> str:
    return fx.with_ctes(
        "SELECT lang, model, id, label, round(score, 6) AS score, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS value FROM s",
        {"t": _prepared_sql(), "s": _scorer_sql("x", "lexicon", SC.DEFAULT_LEXICON) + " UNION ALL " + _scorer_sql("x", "second", SECOND_LEXICON)})


@register("score_texts", score_texts_sql)
def score_texts(spark: SparkSession, sf: str) -> DataFrame:
    """T3 + C3 + C4 + C5: every document's whole text preprocessed and truncated JVM-side, scored
    in Arrow batches by two pluggable scorers in one pass (mapInPandas), decoded to 0/1 per label."""
    scorers = [lambda: SC.LexiconScorer(SC.DEFAULT_LEXICON), lambda: SC.LexiconScorer(SECOND_LEXICON, "second")]
    scores = SC.score_texts(fx.texts(spark, sf), scorers)
    return scores.select("lang", "model", "id", "label", F.round("score", 6).alias("score"), D.score_to_binary("score").alias("value"))


# The run-variant flags in naming order, and the variants evaluated (baseline and
# augmentation set; preprocessing off / on). Augmentation only names a variant: no code path uses it.
VARIANT_FLAGS = ("baseline", "preprocessing", "augmentation")
VARIANTS = [(True, False, True), (True, True, True)]


def variant_texts(texts: DataFrame, variants=VARIANTS) -> DataFrame:
    """(lang, id, process, text): each text once per run variant (an explode of the constant variant
    list), named from its flags (P13) and preprocessed only where the variant's flag is set (C3)."""
    arr = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(VARIANT_FLAGS, flags)]) for flags in variants])
    x = texts.select("lang", "id", "text", F.explode(arr).alias("v"))
    process = S.process_name({n: F.col(f"v.{n}") for n in VARIANT_FLAGS})
    text = F.when(F.col("v.preprocessing"), X.preprocess_text("text")).otherwise(F.col("text"))
    return x.select("lang", "id", process.alias("process"), text.alias("text"))


@register("process_name", "SELECT * FROM (VALUES " + ", ".join(
    f"({', '.join(str(v).lower() for v in flags)}, '{'_'.join(n for n, v in zip(VARIANT_FLAGS, flags) if v)}')"
    for flags in product((False, True), repeat=3)) + f") t({', '.join(VARIANT_FLAGS)}, process)")
def process_name(spark: SparkSession, sf: str) -> DataFrame:
    """The variant names of all flag settings that the member labels of the given data stand for (every
    setting occurs: flags are bits of the label rows' ids)."""
    ids = fx.gold_wide(spark, sf).select("id")
    flags = [F.col("id").bitwiseAND(1 << k) != 0 for k in range(3)]
    rows = ids.select(*[f.alias(n) for f, n in zip(flags, VARIANT_FLAGS)]).distinct()
    return rows.withColumn("process", S.process_name({n: F.col(n) for n in VARIANT_FLAGS}))


def eval_variants_sql() -> str:
    from ..oracle import METRICS, multilabel_ctes, r6
    names = {False: "baseline_augmentation", True: "baseline_preprocessing_augmentation"}
    ctes = {}
    for pre, name in names.items():
        ctes[f"t{int(pre)}"] = _prepared_sql(pre)
        ctes[f"s{int(pre)}"] = _scorer_sql("x", "lexicon", SC.DEFAULT_LEXICON).replace("FROM t", f"FROM t{int(pre)}")
    ctes["pairs"] = " UNION ALL ".join(
        f"SELECT '{name}' AS process, s.model, s.lang, s.id, s.label, g.gold AS g, CASE WHEN s.score > 0.5 THEN 1 ELSE 0 END AS p "
        f"FROM s{int(pre)} s JOIN gold g ON g.lang = s.lang AND g.id = s.id AND g.label = s.label" for pre, name in names.items())
    ctes.update(multilabel_ctes("pairs", ["process", "model", "lang"]))
    cols = ", ".join(f"{r6(f'avg({m})')} AS avg_{m}" for m in METRICS)
    return fx.with_ctes(f"SELECT model, {cols}, process, CAST(count(*) AS BIGINT) AS n_langs FROM per_key GROUP BY process, model", ctes)


@register("eval_variants", eval_variants_sql)
def eval_variants(spark: SparkSession, sf: str) -> DataFrame:
    """P13 + C3 + T3 + C5 + M15/M9: the gold texts scored under every run variant in one pass (the
    variant rides along through the Arrow batches), decoded to 0/1, evaluated per (process, model,
    language) and averaged over languages; one leaderboard row per (process, model). The scorer runs once
    a text and variant: its output meets the gold in one aggregate, with process and model as the model key."""
    gold = fx.gold_table(spark, sf)
    texts = fx.texts(spark, sf).join(fx.gold_wide(spark, sf).select("lang", "id"), ["lang", "id"], "left_semi")
    scored = SC.score_texts(variant_texts(texts), preprocess=False, carry=("process",))
    pred = scored.select("lang", "id", "label", F.concat_ws("|", "process", "model").alias("model"),
                         D.score_to_binary("score").alias("value"))
    per = PA.multilabel_report(PA.weighted_pairs(gold, pred), ["model", "lang"])
    per = per.withColumn("process", F.substring_index("model", "|", 1)).withColumn("model", F.expr("substr(model, instr(model, '|') + 1)"))
    lb = M.average_over(per, ["process", "model"], M.METRICS)
    return _r(lb.select("model", *[f"avg_{m}" for m in M.METRICS], "process", "n_langs"))


@register("train_baseline")
def train_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """T4 + M13: TF-IDF + logistic regression per label trained on the 80 % split of the training
    pool, evaluated on the held-out 20 % (sigmoid output >= 0.5)."""
    pool = T.with_split(S.train_pool(fx.train_raw_by_lang(spark, sf)))
    scores = SC.train_baseline(pool, ["quality", "toxic"])
    dec = scores.select("lang", "model", "id", "label", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("value"))
    gold = fx.gold_table(spark, sf).where(T.split_column("id") == "test")
    return _r(PA.training_metrics(PA.weighted_pairs(gold, dec), ["model"]))


def _baseline_coverage_sql() -> str:
    from .queries_ops import POOL_CTES
    return fx.with_ctes(
        "SELECT l.label, count(*) AS n_scored, CAST(0 AS BIGINT) AS n_outside FROM pool "
        "CROSS JOIN (VALUES ('quality'), ('toxic')) l(label) "
        "WHERE substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) < '33333333' GROUP BY l.label", POOL_CTES)


@register("train_baseline_coverage", _baseline_coverage_sql)
def train_baseline_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """T4: per label, how many held-out rows the trained baseline scores, and how many scores are no probability."""
    pool = T.with_split(S.train_pool(fx.train_raw_by_lang(spark, sf)))
    scores = SC.train_baseline(pool, ["quality", "toxic"])
    outside = F.col("score").isNull() | F.isnan("score") | ~F.col("score").between(0, 1)
    return scores.groupBy("label").agg(F.count("*").alias("n_scored"), F.sum(outside.cast("long")).alias("n_outside"))


def _naive_bayes_sql() -> str:
    from .queries_ops import POOL_CTES
    held = "substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) < '33333333'"
    words = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
             "'[^\\x20\\x09-\\x0D]+')")
    micro = "CAST(round(ln(CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE)) * 1000000) AS BIGINT)"
    return fx.with_ctes(
        f"SELECT r.lang, r.id, r.label, p.prior + CAST(coalesce(w.added, 0) AS BIGINT) AS log_odds, "
        f"CASE WHEN p.prior + coalesce(w.added, 0) >= 0 THEN 1 ELSE 0 END AS value "
        f"FROM (SELECT DISTINCT lang, id, label FROM lines WHERE held) r JOIN prior p USING (label) "
        f"LEFT JOIN (SELECT t.lang, t.id, t.label, sum(o.w) AS added FROM spoken t JOIN odds o USING (label, word) WHERE t.held GROUP BY t.lang, t.id, t.label) w "
        f"ON r.id = w.id AND r.label = w.label AND r.lang IS NOT DISTINCT FROM w.lang",
        {**POOL_CTES,
         "lines": f"SELECT lang, id, {held} AS held, {words} AS words, 'quality' AS label, quality AS y FROM pool "
                  f"UNION ALL SELECT lang, id, {held}, {words}, 'toxic', toxic FROM pool",
         "spoken": "SELECT lang, id, held, label, y, unnest(words) AS word FROM lines",
         "prior": f"SELECT label, {micro.format('(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) + 1)', '(sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) + 1)')} AS prior "
                  "FROM lines WHERE NOT held GROUP BY label",
         "counted": "SELECT label, word, count(*) AS n, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1 FROM spoken WHERE NOT held GROUP BY label, word",
         "sums": "SELECT label, count(*) AS v, sum(n) AS n, sum(n1) AS n1 FROM counted GROUP BY label",
         "odds": f"SELECT c.label, c.word, {micro.format('(c.n1 + 1)', '(s.n1 + s.v)')} - {micro.format('(c.n - c.n1 + 1)', '(s.n - s.n1 + s.v)')} AS w "
                 "FROM counted c JOIN sums s USING (label)"})


@register("train_naive_bayes", _naive_bayes_sql)
def train_naive_bayes(spark: SparkSession, sf: str) -> DataFrame:
    """T4: naive Bayes by word counts, fitted on the training split of the pool: every held-out row's log odds
    (millionths) and decision per label."""
    labels = ["quality", "toxic"]
    pool = T.with_split(S.train_pool(fx.train_raw_by_lang(spark, sf)))
    out = NB.score(pool.where("split = 'test'"), NB.fit(pool.where("split = 'train'"), labels), labels)
    return out.select("lang", "id", "label", "log_odds", (F.col("log_odds") >= 0).cast("int").alias("value"))


@register("stream_parse_responses", parse_intensity_sql)
def stream_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    """ST1: replies arrive in two drops of files; each availableNow run parses only the new files,
    a third run with nothing new adds nothing. The sink then equals the batch parse (C11)."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("replies-in", "replies-parsed", "replies-ckpt"))
    replies = fx.responses_b(spark, sf)
    catalog = S.label_catalog(fx.gold_table(spark, sf))
    early = F.pmod(F.xxhash64("lang", "id"), F.lit(2)) == 0
    first, second = replies.where(early), replies.where(~early)
    first.write.mode("append").parquet(src)
    n1 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    second.write.mode("append").parquet(src)
    n2 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    n3 = ST.run_incremental(spark, src, sink, ckpt, catalog)
    total = replies.count()
    if n3 != 0 or n1 + n2 != total:
        raise RuntimeError(f"incremental runs read {n1}, {n2}, {n3} replies; expected {total} in the first two")
    return spark.read.parquet(sink).select("lang", "id", "label", "value")


#: Replies to requests that were made again: of an error reply, and of a usable one (which stands).
REQUESTED_AGAIN, REPEATED = "Quality(1), Toxic(2)", "Quality(3), Toxic(3)"


def _resumed_sql() -> str:
    replies = fx.duck_ctes()["responses_b"]
    again = fx._wrap_sql(f"'{REQUESTED_AGAIN}'")
    return parse_intensity_sql({"responses_b": f"SELECT lang, id, CASE WHEN id % 17 = 0 THEN {again} ELSE raw END AS raw FROM ({replies})"})


@register("stream_resumed_replies", _resumed_sql)
def stream_resumed_replies(spark: SparkSession, sf: str) -> DataFrame:
    """ST1 + S9: every input's reply arrives, some as errors and some twice; then errors are requested again and some
    usable replies are repeated with other content. Each input has its first usable reply's values, once."""
    src, sink, ckpt = (scratch_path(spark, n) for n in ("resumed-in", "resumed-parsed", "resumed-ckpt"))
    replies, catalog = fx.responses_b(spark, sf), S.label_catalog(fx.gold_table(spark, sf))
    replies.unionByName(replies.where(F.col("id") % 7 == 0)).write.mode("append").parquet(src)
    ST.run_resumed(spark, src, sink, ckpt, catalog)
    failed = ~D.usable_reply("raw")
    again = replies.where(failed | (F.col("id") % 5 == 0)).withColumn(
        "raw", F.when(failed, fx._wrap(F.lit(REQUESTED_AGAIN))).otherwise(fx._wrap(F.lit(REPEATED))))
    again.write.mode("append").parquet(src)
    ST.run_resumed(spark, src, sink, ckpt, catalog)
    return spark.read.parquet(sink).select("lang", "id", "label", "value")
