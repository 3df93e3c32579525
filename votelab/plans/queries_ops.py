"""Registered queries for the schema, source, ensemble and report operators, each with its
DuckDB twin written next to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import oracle as O
from ..operators import ensemble as E
from ..operators import metrics as M
from ..operators import schema as S
from ..operators import split as T
from ..functions import decode as D
from ..registry import register
from ..sources import fixtures as fx
from ..sources import gates as G
from . import leaderboard as L
from . import paired as PA
from .queries import FIXED_COMBO, FIXED_PAIR, FIXED_PAIR_UNION, MEMBERS, _r, _wpairs

W = fx.with_ctes
R6 = O.r6
REQUESTED = MEMBERS + ["m6"]  # m6 is requested but has no predictions


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    return S.train_pool(fx.train_raw_by_lang(spark, sf))


def _coerce_sql(x: str) -> str:
    d = f"TRY_CAST({x} AS DOUBLE)"
    return f"CAST(trunc(coalesce(CASE WHEN isnan({d}) THEN 0.0 ELSE {d} END, 0.0)) AS INTEGER)"


POOL_CTES = {
    "raw_pool": "SELECT lang, id, text, quality, CASE WHEN lang = 'es' THEN NULL ELSE toxic END AS toxic FROM train_base",
    "pool": (f"SELECT lang, id, text, {_coerce_sql('quality')} AS quality, {_coerce_sql('toxic')} AS toxic "
             f"FROM raw_pool"),
    "long_raw": ("SELECT lang, id, 'quality' AS label, quality AS value FROM train_base "
                 "UNION ALL SELECT lang, id, 'toxic' AS label, toxic AS value FROM train_base WHERE lang IS DISTINCT FROM 'es'"),
    "catalog": "SELECT DISTINCT lang, label FROM long_raw",
}


# ---------------------------------------------------------------- S2, P2-P10, T1, M14

@register("train_pool", W("SELECT * FROM pool", POOL_CTES))
def train_pool(spark: SparkSession, sf: str) -> DataFrame:
    """S2 + P7 + P8: per-language training files, headers lower-cased, unioned by name, coerced."""
    return _pool(spark, sf)


@register("unpivot_labels", W("SELECT lang, id, label, value FROM long_raw", POOL_CTES))
def unpivot_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Each file's own label columns (case-insensitive) to long rows; absent labels have no rows."""
    return S.long_per_file(fx.train_raw_by_lang(spark, sf), coerce=False)


@register("coerce_labels", W(f"SELECT lang, id, label, {_coerce_sql('value')} AS value FROM long_raw", POOL_CTES))
def coerce_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty label text to int (non-numeric and null -> 0, decimals truncated)."""
    return S.long_per_file(fx.train_raw_by_lang(spark, sf), coerce=True)


@register("label_index", "SELECT * FROM (VALUES (0, 'quality'), (1, 'toxic')) t(idx, label)")
def label_index(spark: SparkSession, sf: str) -> DataFrame:
    """Label index in the pool's column order, from the unpivoted pool."""
    return S.label_index(_pool(spark, sf))


@register("label_vector", W("SELECT id, text AS Tweet, [CAST(quality AS DOUBLE), CAST(toxic AS DOUBLE)] AS labels "
                            "FROM pool", POOL_CTES))
def label_vector(spark: SparkSession, sf: str) -> DataFrame:
    """P10 + P11: one-hot float vector per row in label index order, text renamed to Tweet."""
    return S.label_vector(_pool(spark, sf))


@register("hide_gold", W("SELECT lang, id, text FROM train_base"))
def hide_gold(spark: SparkSession, sf: str) -> DataFrame:
    """What the scorer may see of a gold file (key, id, text)."""
    frames = fx.train_raw_by_lang(spark, sf)
    wide = S.union_files([S.keyed(df, k) for k, df in frames.items()])
    return S.hide_gold(wide)


@register("restrict_labels", W("SELECT p.lang, p.model, p.id, p.label, p.pred AS value FROM pred p "
                               "SEMI JOIN catalog c ON c.lang = p.lang AND c.label = p.label", POOL_CTES))
def restrict_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions cut to the labels each language's gold has (es has no 'toxic')."""
    catalog = S.label_catalog(S.long_per_file(fx.train_raw_by_lang(spark, sf), coerce=False))
    return S.restrict_labels(fx.pred_table(spark, sf), catalog)


@register("langs_without_labels", W("SELECT t.lang, CAST(count(c.label) AS BIGINT) AS n_labels, "
                                    "count(c.label) = 0 AS skipped FROM (SELECT DISTINCT lang FROM texts) t "
                                    "LEFT JOIN catalog c ON c.lang = t.lang GROUP BY t.lang", POOL_CTES))
def langs_without_labels(spark: SparkSession, sf: str) -> DataFrame:
    """P5: label count per input language; a language with none is skipped."""
    catalog = S.label_catalog(S.long_per_file(fx.train_raw_by_lang(spark, sf), coerce=False))
    return S.langs_without_labels(fx.texts(spark, sf), catalog)


@register("split_80_20", W("SELECT lang, id, CASE WHEN substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) < '33333333' "
                           "THEN 'test' ELSE 'train' END AS split FROM pool", POOL_CTES))
def split_80_20(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic 80/20 split of the training pool."""
    return T.with_split(_pool(spark, sf)).select("lang", "id", "split")


@register("label_counts_by_split", W(
    "SELECT label, CAST(sum(CASE WHEN split = 'train' THEN v END) AS BIGINT) AS train, "
    "CAST(sum(CASE WHEN split = 'test' THEN v END) AS BIGINT) AS test FROM ("
    "SELECT CASE WHEN substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) < '33333333' THEN 'test' ELSE 'train' END "
    "AS split, 'quality' AS label, quality AS v FROM pool UNION ALL "
    "SELECT CASE WHEN substr(md5('42|' || CAST(id AS VARCHAR)), 1, 8) < '33333333' THEN 'test' ELSE 'train' END, "
    "'toxic', toxic FROM pool) GROUP BY label", POOL_CTES))
def label_counts_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Positive count per label and split."""
    return T.label_counts_by_split(_pool(spark, sf), ["quality", "toxic"])


@register("training_metrics", lambda: W(
    "SELECT model, " + ", ".join(f"{R6(c)} AS {c}" for c in
                                 ("overall_accuracy", "samples_accuracy", "overall_f1", "samples_f1")) +
    " FROM (SELECT r.model, r.overall_accuracy, r.samples_accuracy, r.samples_f1, m.f1_macro AS overall_f1 "
    "FROM (SELECT model, avg(CAST(ok AS DOUBLE)) AS overall_accuracy, "
    f"{O.sdiv('sum(cells - fp - fn)', 'sum(cells)')} AS samples_accuracy, "
    f"avg({O.sdiv('2 * tp', '2 * tp + fp + fn')}) AS samples_f1 FROM rowsx GROUP BY model) r "
    "JOIN ml m ON m.model = r.model)",
    {**{"tpairs": ("SELECT l.model, l.lang, l.id, l.label, g.gold AS g, "
                   "CASE WHEN 1 / (1 + exp(-l.logit)) >= 0.5 THEN 1 ELSE 0 END AS p "
                   "FROM logits l JOIN gold g ON g.lang = l.lang AND g.id = l.id AND g.label = l.label "
                   "WHERE substr(md5('42|' || CAST(l.id AS VARCHAR)), 1, 8) < '33333333'"),
        "rowsx": ("SELECT model, lang, id, sum(CASE WHEN g = 1 AND p = 1 THEN 1 ELSE 0 END) AS tp, "
                  "sum(CASE WHEN g = 0 AND p = 1 THEN 1 ELSE 0 END) AS fp, "
                  "sum(CASE WHEN g = 1 AND p = 0 THEN 1 ELSE 0 END) AS fn, count(*) AS cells, "
                  "min(CASE WHEN g = p THEN 1 ELSE 0 END) AS ok FROM tpairs GROUP BY model, lang, id")},
     **O.multilabel_ctes("tpairs", ["model"])}))
def training_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Per model on the held-out split: subset accuracy, cell accuracy, macro F1, samples F1
    of sigmoid(logit) >= 0.5, pooled over languages."""
    test = T.split_column("id") == "test"  # a function of the id: prunes both sides before the shuffle
    lg = fx.logits(spark, sf).where(test)
    dec = lg.select("lang", "model", "id", "label", D.logit_to_binary("logit").alias("value"))
    return _r(PA.training_metrics(PA.weighted_pairs(fx.gold_table(spark, sf).where(test), dec), ["model"]))


# ---------------------------------------------------------------- S3, S8, S9, S10 / J1

@register("lang_subset", W("SELECT lang, id, label, gold AS value FROM gold WHERE lang = 'fr'"))
def lang_subset(spark: SparkSession, sf: str) -> DataFrame:
    """S3: one language's file (a filter on the partition column when the table is partitioned)."""
    return fx.gold_table(spark, sf).where(F.col("lang") == "fr")


@register("available_models", W(
    "SELECT r.model, r.model IN (SELECT DISTINCT model FROM pred) AS available FROM (VALUES " +
    ", ".join(f"('{m}')" for m in REQUESTED) + ") r(model)"))
def available_models(spark: SparkSession, sf: str) -> DataFrame:
    """Which requested models have predictions (the others are skipped)."""
    return G.available_models(spark, REQUESTED, fx.pred_table(spark, sf))


@register("resume_pending", W("SELECT g.lang, g.id FROM gold_wide g ANTI JOIN done d ON d.lang = g.lang AND d.id = g.id"))
def resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return G.pending(fx.gold_wide(spark, sf).select("lang", "id"), fx.done(spark, sf), ["lang", "id"])


@register("pair_gold_pred", W("SELECT p.model, p.lang, p.id, p.label, g.gold, p.pred FROM pred p "
                              "JOIN gold g ON g.lang = p.lang AND g.id = p.id AND g.label = p.label"))
def pair_gold_pred(spark: SparkSession, sf: str) -> DataFrame:
    """S10 + J1: prediction files named 'pred_<lang>.csv' paired with gold '<lang>.csv', then an
    equi-join on (lang, id, label) instead of row position."""
    p = fx.pred_table(spark, sf).withColumn("file", F.concat(F.lit("pred_"), F.col("lang"), F.lit(".csv")))
    p = p.withColumn("lang", G.lang_from_file(F.col("file"))).drop("file").withColumnRenamed("value", "pred")
    g = fx.gold_table(spark, sf).withColumnRenamed("value", "gold")
    return p.join(g, ["lang", "id", "label"]).select("model", "lang", "id", "label", "gold", "pred")


# ---------------------------------------------------------------- E1-E9

def _combo_oracle(body: str, extra: dict | None = None, min_size: int = 2) -> str:
    ctes = {}
    ctes.update(O.combo_ctes(min_size))
    ctes.update(O.avail_ctes())
    ctes.update(extra or {})
    return W(body, ctes)


@register("combo_availability", lambda: _combo_oracle(
    "SELECT c.combo, l.lang, c.r, CAST(count(lm.model) AS INTEGER) AS n_present, count(lm.model) = c.r AS available "
    "FROM (SELECT lang, unnest((SELECT list({'mask': mask, 'combo': combo, 'r': r}) FROM combos)) AS c "
    "FROM (SELECT DISTINCT lang FROM pred)) l JOIN cm ON cm.mask = l.c.mask "
    "LEFT JOIN lang_models lm ON lm.lang = l.lang AND lm.model = cm.model GROUP BY l.c.combo, l.lang, l.c.r"
    .replace("c.combo, l.lang, c.r,", "l.c.combo AS combo, l.lang, l.c.r AS r,")
    .replace("= c.r AS available", "= l.c.r AS available")))
def combo_availability(spark: SparkSession, sf: str) -> DataFrame:
    """Per (combo, language) whether every member has predictions; the rest are skipped."""
    return E.availability(fx.pred_table(spark, sf), MEMBERS)


@register("alignment_violations", W(
    "SELECT 'duplicate' AS kind, lang, model, id, CAST(max(n) AS BIGINT) AS n FROM ("
    "SELECT lang, model, id, label, count(*) AS n FROM dup_pred GROUP BY ALL HAVING count(*) > 1) "
    "GROUP BY lang, model, id UNION ALL "
    "SELECT 'missing', a.lang, a.model, a.id, CAST(0 AS BIGINT) FROM ("
    "SELECT i.lang, i.id, m.model FROM (SELECT DISTINCT lang, id FROM dup_pred) i "
    "JOIN (SELECT DISTINCT lang, model FROM dup_pred) m ON m.lang = i.lang) a "
    "ANTI JOIN (SELECT DISTINCT lang, model, id FROM dup_pred) d "
    "ON d.lang = a.lang AND d.model = a.model AND d.id = a.id"))
def alignment_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicate cells and ids missing from a member (the alignment check's findings)."""
    return E.alignment_violations(fx.dup_pred(spark, sf).select("lang", "model", "id", "label", F.col("pred").alias("value")))


@register("ensemble_combos", lambda: W(
    "SELECT combo, mask, r, sel FROM (SELECT mask, string_agg(model, '_' ORDER BY bit) AS combo, "
    "CAST(count(*) AS INTEGER) AS r, list(bit ORDER BY bit) AS sel FROM cm GROUP BY mask) WHERE r >= 2",
    {"mem": "SELECT model, CAST(row_number() OVER (ORDER BY model) - 1 AS INTEGER) AS bit FROM "
            "(SELECT DISTINCT model FROM pred)",
     "masks": "SELECT CAST(range AS BIGINT) AS mask FROM range(1, CAST((SELECT 1 << count(*) FROM mem) AS BIGINT))",
     "cm": "SELECT k.mask, m.model, m.bit FROM masks k JOIN mem m ON ((k.mask >> m.bit) & 1) = 1"}))
def ensemble_combos(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of >= 2 of the models found in the predictions, named in member order."""
    return E.combos_from_members(E.members_from_data(fx.pred_table(spark, sf)))


def _vote_q(rule: str, kind: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return L.ensemble_votes(fx.pred_table(spark, sf, "binary" if kind == "binary" else "intensity"),
                                MEMBERS, rule, kind)
    return q


for _name, _rule, _kind, _doc in (
        ("majority_vote", "majority", "binary", "E4: binary majority (sum >= r // 2 + 1) for every combo."),
        ("union_rule", "union", "binary", "E5: binary union (sum >= 1) for every combo."),
        ("majority_intensity", "majority", "intensity", "E6: max intensity if the intensity sum passes r // 2 + 1."),
        ("union_intensity", "union", "intensity", "E7: max intensity if the intensity sum is >= 1.")):
    _fn = _vote_q(_rule, _kind)
    _fn.__doc__ = _doc
    _fn.__name__ = _name
    register(_name, (lambda r=_rule, k=_kind: _combo_oracle(
        "SELECT combo, lang, id, label, value FROM ens",
        O.vote_ctes(r, k, "pred" if k == "binary" else "pred_b"))))(_fn)


def _fixed_sql(models: list[str], rule: str, kind: str, value: str) -> str:
    ins = ", ".join(f"'{m}'" for m in models)
    dec = O.decide_sql(rule, kind, r=str(len(models)))
    return W(f"SELECT lang, id, label, {dec} AS value FROM (SELECT lang, id, label, sum({value}) AS s, "
             f"max({value}) AS mx, count(DISTINCT model) AS k FROM pred WHERE model IN ({ins}) "
             f"GROUP BY lang, id, label) WHERE k = {len(models)}")


@register("test_majority", lambda: _fixed_sql(FIXED_COMBO, "majority", "binary", "pred"))
def test_majority(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed three-member majority of the test split."""
    return E.vote_fixed(fx.pred_table(spark, sf), FIXED_COMBO, "majority", "binary")


@register("test_union", lambda: _fixed_sql(FIXED_COMBO, "union", "binary", "pred"))
def test_union(spark: SparkSession, sf: str) -> DataFrame:
    """The fixed three-member union of the test split."""
    return E.vote_fixed(fx.pred_table(spark, sf), FIXED_COMBO, "union", "binary")


@register("test_union_intensity", lambda: _fixed_sql(FIXED_COMBO, "union", "binary_union", "pred_b"))
def test_union_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """E9 on intensities: sum > 0 -> 1 (the intensity is not kept, as in the original test script)."""
    return E.vote_fixed(fx.pred_table(spark, sf, "intensity"), FIXED_COMBO, "union", "binary_union")


# ---------------------------------------------------------------- M7, M8, M10, M16, M17

def _per_label_sql(models: list[str], rule: str, kind: str, value: str, gcol: str, body: str) -> str:
    ins = ", ".join(f"'{m}'" for m in models)
    dec = O.decide_sql(rule, kind, r=str(len(models)))
    ctes = {
        "fx_ens": (f"SELECT lang, id, label, {dec} AS value FROM (SELECT lang, id, label, sum({value}) AS s, "
                   f"max({value}) AS mx, count(DISTINCT model) AS k FROM pred WHERE model IN ({ins}) "
                   f"GROUP BY lang, id, label) WHERE k = {len(models)}"),
        "plc": (f"SELECT e.lang, e.label, sum(CASE WHEN g.{gcol} >= 1 AND e.value >= 1 THEN 1 ELSE 0 END) AS tp, "
                f"sum(CASE WHEN g.{gcol} < 1 AND e.value >= 1 THEN 1 ELSE 0 END) AS fp, "
                f"sum(CASE WHEN g.{gcol} >= 1 AND e.value < 1 THEN 1 ELSE 0 END) AS fn, "
                f"sum(CASE WHEN g.{gcol} < 1 AND e.value < 1 THEN 1 ELSE 0 END) AS tn, count(*) AS n "
                f"FROM fx_ens e JOIN gold g ON g.lang = e.lang AND g.id = e.id AND g.label = e.label "
                f"GROUP BY e.lang, e.label"),
        "pl_long": (f"SELECT lang, label, 'precision' AS metric, {O.sdiv('tp', 'tp + fp')} AS value FROM plc "
                    f"UNION ALL SELECT lang, label, 'recall', {O.sdiv('tp', 'tp + fn')} FROM plc "
                    f"UNION ALL SELECT lang, label, 'f1', {O.sdiv('2 * tp', '2 * tp + fp + fn')} FROM plc "
                    f"UNION ALL SELECT lang, label, 'accuracy', {O.sdiv('tp + tn', 'n')} FROM plc"),
    }
    return W(body, ctes)


def _per_label(spark: SparkSession, sf: str, models: list[str], rule: str, kind: str) -> DataFrame:
    k = "binary" if kind == "binary" else "intensity"
    # the fixed combo's votes and the gold in one aggregate (no join); label_counts binarises (>= 1):
    # C14 for intensities
    pairs = E.vote_fixed_paired(fx.pred_table(spark, sf, k), fx.gold_table(spark, sf, k), models, rule, kind) \
        .withColumnRenamed("value", "pred")
    return M.per_label_long(M.label_counts(pairs, ["lang"]), ["lang"])


@register("per_label_report", lambda: _per_label_sql(
    FIXED_COMBO, "union", "binary", "pred", "gold", f"SELECT lang, label, metric, {R6('value')} AS value FROM pl_long"))
def per_label_report(spark: SparkSession, sf: str) -> DataFrame:
    """M7: per language and label, positive-class precision / recall / F1 and accuracy of the fixed union."""
    return _r(_per_label(spark, sf, FIXED_COMBO, "union", "binary"))


@register("per_label_report_intensity", lambda: _per_label_sql(
    FIXED_PAIR, "majority", "intensity", "pred_b", "gold_b",
    f"SELECT lang, label, metric, {R6('value')} AS value FROM pl_long"))
def per_label_report_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """M8: the same on intensities after binarising gold and prediction (>= 1), fixed majority pair."""
    return _r(_per_label(spark, sf, FIXED_PAIR, "majority", "intensity"))


@register("per_label_report_intensity_union", lambda: _per_label_sql(
    FIXED_PAIR_UNION, "union", "intensity", "pred_b", "gold_b",
    f"SELECT lang, label, metric, {R6('value')} AS value FROM pl_long"))
def per_label_report_intensity_union(spark: SparkSession, sf: str) -> DataFrame:
    """M8 + E11: per-label report of the fixed union pair on intensities, binarised (>= 1)."""
    return _r(_per_label(spark, sf, FIXED_PAIR_UNION, "union", "intensity"))


@register("per_label_average_intensity", lambda: _per_label_sql(
    FIXED_PAIR, "majority", "intensity", "pred_b", "gold_b",
    f"SELECT label, metric, {R6('avg(value)')} AS value FROM pl_long GROUP BY label, metric"))
def per_label_average_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """M10 on M8: mean per (label, metric) over languages of the fixed majority pair's report."""
    pl = _per_label(spark, sf, FIXED_PAIR, "majority", "intensity")
    return _r(pl.groupBy("label", "metric").agg(F.avg("value").alias("value")).orderBy("label", "metric"))


@register("per_label_average", lambda: _per_label_sql(
    FIXED_COMBO, "union", "binary", "pred", "gold",
    f"SELECT label, metric, {R6('avg(value)')} AS value FROM pl_long GROUP BY label, metric"))
def per_label_average(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the per-label report over languages, sorted by (label, metric)."""
    pl = _per_label(spark, sf, FIXED_COMBO, "union", "binary")
    return _r(pl.groupBy("label", "metric").agg(F.avg("value").alias("value")).orderBy("label", "metric"))


@register("per_label_support", W(
    "SELECT model, lang, label, " + R6(O.sdiv("tp", "tp + fp")) + " AS precision, " + R6(O.sdiv("tp", "tp + fn")) +
    " AS recall, " + R6(O.sdiv("2 * tp", "2 * tp + fp + fn")) + " AS f1, CAST(tp + fn AS BIGINT) AS support FROM ("
    "SELECT model, lang, label, sum(CASE WHEN gold = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, "
    "sum(CASE WHEN gold = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp, "
    "sum(CASE WHEN gold = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn FROM pred GROUP BY model, lang, label)"))
def per_label_support(spark: SparkSession, sf: str) -> DataFrame:
    """Classification-report rows per model, language and label."""
    return _r(M.per_label_support(PA.label_counts(_wpairs(spark, sf), ["model", "lang"]), ["model", "lang"]))


@register("eval_single", lambda: W(
    "SELECT lang, " + ", ".join(f"{R6(m)} AS {m}" for m in O.METRICS if m != "accuracy") + " FROM ml",
    {"pairs": "SELECT lang, id, label, gold AS g, pred AS p FROM pred WHERE model = 'm3'",
     **O.multilabel_ctes("pairs", ["lang"])}))
def eval_single(spark: SparkSession, sf: str) -> DataFrame:
    """One prediction folder (member m3) against gold: the nine P/R/F1 values per language."""
    wp = _wpairs(spark, sf, models=["m3"])
    return _r(M.multilabel_from_counts(PA.label_counts(wp, ["lang"]), ["lang"]).drop("n_labels"))
