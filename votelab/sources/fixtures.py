"""Stand-in label tables derived from the driver's tables (``documents``, ``labels``, ``pages``).

Every view exists twice, once as a Spark DataFrame and once as DuckDB text, so the oracle SQL
computes the same inputs independently. The stand-ins model what the engine consumes:

* ``gold``   (lang, id, label, gold, gold_b)             gold labels, binary and 0..3 intensity
* ``pred``   (lang, model, id, label, gold, gold_b, pred, pred_b)  five members m1..m5
* ``scores`` (lang, model, id, label, score)             scorer output per label
* ``logits`` (lang, model, id, label, logit)             raw classifier logits
* ``responses_a`` / ``responses_b`` (lang, id, raw)      LLM replies as raw JSON
* ``texts``  (lang, id, text)                            whole document texts with emoticons / emojis
* ``train_raw`` per language, dirty label text           training pool input
* ``done``   (lang, id)                                  inputs with a usable stored reply (resume)
* ``dup_pred``                                           ``pred`` with alignment violations

Members are deterministic noise around gold: member ``i`` flips a cell when a hash of
(model, label, id) falls under ``flip = 9000 + 4000 * i`` out of 65536. Rows (m4, es) are left
out so that a combo needing m4 has a language to skip.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import hx, hx_sql
from ..functions.text import EMOTICONS
from ..session import scratch_path
from .tables import read_table

# Fixed values of the stand-in: member names with their flip rate, the binary label columns.
MEMBERS = [("m1", 1, 13000), ("m2", 2, 17000), ("m3", 3, 21000), ("m4", 4, 25000), ("m5", 5, 29000)]
LABEL_COLUMNS = ["quality", "toxic"]
HOLE = ("m4", "es")  # (model, lang) with no predictions

# Appended to texts by doc_id % 16: the 13 emoticons, then three emojis.
TEXT_TOKENS = [e for e, _ in EMOTICONS] + ["\U0001F600", "\U0001F389", "\U0001F44D\U0001F44D"]


def gold_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return d.join(lab, "doc_id").select(
        "lang", F.col("doc_id").alias("id"), "n_chars", "quality", "toxic")


# Materialise the label tables once per session and scale: written as parquet into the shared
# checkpoint folder, then read like any production table (pruned scans, partition metadata).
MATERIALIZE = True
_TABLES: dict[tuple[int, str, str], DataFrame] = {}


def _materialized(spark: SparkSession, sf_dir: str, name: str, build, partition_by: list[str]) -> DataFrame:
    key = (id(spark), os.path.abspath(sf_dir), name)
    df = _TABLES.get(key)
    if df is not None and df.sparkSession is spark:
        return df
    src = build()
    cols = src.columns
    path = scratch_path(spark, f"fixture-{name}")
    src.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    df = spark.read.parquet(path).select(*cols)
    _TABLES[key] = df
    return df


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, id, label, gold, gold_b), materialised per session (see :data:`MATERIALIZE`)."""
    if not MATERIALIZE:
        return _gold_view(spark, sf_dir)
    return _materialized(spark, sf_dir, "gold", lambda: _gold_view(spark, sf_dir), ["lang"])


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, model, id, label, gold, gold_b, pred, pred_b), materialised per session."""
    if not MATERIALIZE:
        return _pred_view(spark, sf_dir)
    return _materialized(spark, sf_dir, "pred", lambda: _pred_view(spark, sf_dir), ["model", "lang"])


def _gold_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = gold_wide(spark, sf_dir).unpivot(["lang", "id", "n_chars"], LABEL_COLUMNS, "label", "gold")
    gb = F.when(F.col("label") == "quality", F.col("gold") * (1 + F.col("n_chars") % 3)) \
        .otherwise(F.col("gold") * (1 + F.col("id") % 3))
    return g.select("lang", "id", "label", F.col("gold").cast("int").alias("gold"),
                    gb.cast("int").alias("gold_b"))


def _pred_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gold_view(spark, sf_dir)
    ms = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(f).alias("flip")) for m, _, f in MEMBERS])
    x = g.select("*", F.explode(ms).alias("m")).select("lang", "id", "label", "gold", "gold_b", "m.model", "m.flip")
    x = x.where(~((F.col("model") == HOLE[0]) & (F.col("lang") == HOLE[1])))
    k = (F.col("model"), F.col("label"), F.col("id"))
    p = F.when(hx("a", *k) < F.col("flip"), 1 - F.col("gold")).otherwise(F.col("gold"))
    pb = F.when(hx("b", *k) < F.col("flip"), hx("c", *k) % 4).otherwise(F.col("gold_b"))
    return x.select("lang", "model", "id", "label", "gold", "gold_b",
                    p.cast("int").alias("pred"), pb.cast("int").alias("pred_b"))


def gold_table(spark: SparkSession, sf_dir: str, kind: str = "binary") -> DataFrame:
    """Gold in the engine's canonical long shape (lang, id, label, value)."""
    col = "gold" if kind == "binary" else "gold_b"
    return gold(spark, sf_dir).select("lang", "id", "label", F.col(col).alias("value"))


def pred_table(spark: SparkSession, sf_dir: str, kind: str = "binary") -> DataFrame:
    """Predictions in the canonical long shape (lang, model, id, label, value)."""
    col = "pred" if kind == "binary" else "pred_b"
    return pred(spark, sf_dir).select("lang", "model", "id", "label", F.col(col).alias("value"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pred(spark, sf_dir)
    s = F.lit(0.5) + (2 * F.col("pred") - 1).cast("double") * \
        hx("s", F.col("model"), F.col("label"), F.col("id")).cast("double") / F.lit(131072.0)
    return p.select("lang", "model", "id", "label", s.alias("score"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir).where(F.col("score") > 0)
    return s.select("lang", "model", "id", "label",
                    F.log(F.col("score") / (1 - F.col("score"))).alias("logit"))


def _m3(col_gold: str, label: str, kind: str):
    k = (F.lit("m3"), F.lit(label), F.col("id"))
    if kind == "binary":
        return F.when(hx("a", *k) < 21000, 1 - F.col(col_gold)).otherwise(F.col(col_gold))
    return F.when(hx("b", *k) < 21000, hx("c", *k) % 4).otherwise(F.col(col_gold))


def _wrap(content):
    return F.concat(F.lit('{"choices":[{"message":{"content":"'), content, F.lit('"}}]}'))


ERROR_REPLY = '{"error":"busy"}'


def responses_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM replies for the label-list prompt: the labels member m3 predicts, with noise."""
    g = gold_wide(spark, sf_dir)
    q, t = _m3("quality", "quality", "binary"), _m3("toxic", "toxic", "binary")
    content = F.concat_ws(", ", F.when(q == 1, F.lit("Quality")), F.when(t == 1, F.lit(" Toxic ")),
                          F.when(F.col("id") % 19 == 0, F.lit("Joy")))
    raw = F.when(F.col("id") % 17 == 0, F.lit(ERROR_REPLY)).otherwise(_wrap(content))
    return g.select("lang", "id", raw.alias("raw"))


def responses_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LLM replies for the intensity prompt, with malformed pieces mixed in."""
    g = gold_wide(spark, sf_dir).withColumn("gq", F.col("quality") * (1 + F.col("n_chars") % 3)) \
        .withColumn("gt", F.col("toxic") * (1 + F.col("id") % 3))
    q, t = _m3("gq", "quality", "intensity"), _m3("gt", "toxic", "intensity")
    normal = F.concat(F.lit("Quality("), q.cast("string"), F.lit("), Toxic("), t.cast("string"), F.lit(")"),
                      F.when(F.col("id") % 13 == 0, F.lit(", quality(2)")).otherwise(F.lit("")))
    content = (F.when(F.col("id") % 19 == 0, F.lit("Quality(x), Toxic(2)"))
               .when(F.col("id") % 23 == 0, F.lit("Quality(2)(3), toxic(9)"))
               .when(F.col("id") % 29 == 0, F.lit("Joy(1),  TOXIC ( 3 )."))
               .when(F.col("id") % 31 == 0, F.lit("toxic(-1), quality (+2), toxic)1(2)"))
               .otherwise(normal))
    raw = F.when(F.col("id") % 17 == 0, F.lit(ERROR_REPLY)).otherwise(_wrap(content))
    return g.select("lang", "id", raw.alias("raw"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's whole text with one emoticon or emoji appended (chosen by doc_id % 16)."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    tok = F.element_at(F.array(*[F.lit(t) for t in TEXT_TOKENS]), (F.col("doc_id") % 16 + 1).cast("int"))
    return d.select("lang", F.col("doc_id").alias("id"),
                    F.concat(F.col("text"), F.lit(" "), tok, F.lit(" end")).alias("text"))


def _dirty(col: str):
    v = F.col(col).cast("string")
    return (F.when(F.col("id") % 10 == 0, F.lit("x"))
            .when(F.col("id") % 11 == 0, F.lit(None).cast("string"))
            .when(F.col("id") % 7 == 0, F.concat(v, F.lit(".9")))
            .otherwise(v))


def train_raw_by_lang(spark: SparkSession, sf_dir: str) -> dict[str | None, DataFrame]:
    """Training files as the pool reader sees them, dirty label text: a frame for each language with a
    peculiar header (``es`` has no ``toxic`` column; ``de`` has upper-case headers; ``fr`` orders labels
    differently), and one frame with its own ``lang`` column (key None) for all other languages and
    none.
    """
    d = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    lab = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    base = d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), "lang", "text", "quality", "toxic") \
        .select("id", "lang", "text", _dirty("quality").alias("quality"), _dirty("toxic").alias("toxic"))
    part = {k: base.where(F.col("lang") == k) for k in ("de", "es", "fr")}
    special = F.coalesce(F.col("lang").isin(*part), F.lit(False))
    return {
        "de": part["de"].select(F.col("id").alias("ID"), F.col("text").alias("Text"),
                                F.col("quality").alias("Quality"), F.col("toxic").alias("TOXIC")),
        "es": part["es"].select("id", "text", "quality"),
        "fr": part["fr"].select("id", "text", "toxic", "quality"),
        None: base.where(~special).select("lang", "id", "text", "quality", "toxic"),
    }


def done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs that already exist: the (lang, id) whose stored label-list reply is usable (it has
    ``choices[0].message.content``). Error replies count as not done, so the resume gate re-requests
    them together with the inputs that have no reply at all."""
    r = responses_a(spark, sf_dir)
    return r.where(F.get_json_object("raw", "$.choices[0].message.content").isNotNull()).select("lang", "id")


def dup_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pred`` with alignment violations: repeated m1 rows, missing m2 rows."""
    p = pred(spark, sf_dir)
    extra = p.where((F.col("model") == "m1") & (F.col("id") % 50 == 0))
    kept = p.where(~((F.col("model") == "m2") & (F.col("id") % 60 == 0)))
    return kept.unionByName(extra)


# --------------------------------------------------------------------------------------------
# DuckDB text of the same views (the oracle side). Pre-registered views: documents, labels, pages.
# --------------------------------------------------------------------------------------------

def _members_sql() -> str:
    rows = ", ".join(f"('{m}', {i}, {f})" for m, i, f in MEMBERS)
    return f"SELECT * FROM (VALUES {rows}) t(model, idx, flip)"


def _members_list_sql() -> str:
    return ", ".join(f"{{'model': '{m}', 'flip': {f}}}" for m, _, f in MEMBERS)


def _m3_sql(gcol: str, label: str, kind: str) -> str:
    if kind == "binary":
        return f"(CASE WHEN {hx_sql(repr('a'), repr('m3'), repr(label), 'id')} < 21000 THEN 1 - {gcol} ELSE {gcol} END)"
    return (f"(CASE WHEN {hx_sql(repr('b'), repr('m3'), repr(label), 'id')} < 21000 "
            f"THEN {hx_sql(repr('c'), repr('m3'), repr(label), 'id')} % 4 ELSE {gcol} END)")


def _wrap_sql(content: str) -> str:
    return f"""('{{"choices":[{{"message":{{"content":"' || {content} || '"}}}}]}}')"""


def _tokens_sql() -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TEXT_TOKENS) + "]"


def duck_ctes() -> dict[str, str]:
    """name -> SELECT text; later entries may reference earlier ones."""
    k = ("model", "label", "id")
    c: dict[str, str] = {}
    c["members"] = _members_sql()
    c["gold_wide"] = ("SELECT d.lang, d.doc_id AS id, d.n_chars, l.quality, l.toxic "
                      "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    c["gold"] = ("SELECT lang, id, 'quality' AS label, CAST(quality AS INTEGER) AS gold, "
                 "CAST(quality * (1 + n_chars % 3) AS INTEGER) AS gold_b FROM gold_wide UNION ALL "
                 "SELECT lang, id, 'toxic' AS label, CAST(toxic AS INTEGER) AS gold, "
                 "CAST(toxic * (1 + id % 3) AS INTEGER) AS gold_b FROM gold_wide")
    kg = ("g.m.model", "g.label", "g.id")
    ha = hx_sql("'a'", *kg)
    hb = hx_sql("'b'", *kg)
    hc = hx_sql("'c'", *kg)
    c["pred"] = (f"SELECT g.lang, g.m.model AS model, g.id, g.label, g.gold, g.gold_b, "
                 f"CAST(CASE WHEN {ha} < g.m.flip THEN 1 - g.gold ELSE g.gold END AS INTEGER) AS pred, "
                 f"CAST(CASE WHEN {hb} < g.m.flip THEN {hc} % 4 ELSE g.gold_b END AS INTEGER) AS pred_b "
                 f"FROM (SELECT *, unnest([{_members_list_sql()}]) AS m FROM gold) g "
                 f"WHERE NOT (g.m.model = '{HOLE[0]}' AND g.lang = '{HOLE[1]}')")
    hs = hx_sql("'s'", *k)
    c["scores"] = (f"SELECT lang, model, id, label, CAST(0.5 AS DOUBLE) + CAST(2 * pred - 1 AS DOUBLE) * "
                   f"CAST({hs} AS DOUBLE) / CAST(131072 AS DOUBLE) AS score FROM pred")
    c["logits"] = "SELECT lang, model, id, label, ln(score / (1 - score)) AS logit FROM scores WHERE score > 0"
    q, t = _m3_sql("quality", "quality", "binary"), _m3_sql("toxic", "toxic", "binary")
    content_a = (f"concat_ws(', ', CASE WHEN {q} = 1 THEN 'Quality' END, CASE WHEN {t} = 1 THEN ' Toxic ' END, "
                 f"CASE WHEN id % 19 = 0 THEN 'Joy' END)")
    c["responses_a"] = (f"SELECT lang, id, CASE WHEN id % 17 = 0 THEN '{ERROR_REPLY}' "
                        f"ELSE {_wrap_sql(content_a)} END AS raw FROM gold_wide")
    qb = _m3_sql("(quality * (1 + n_chars % 3))", "quality", "intensity")
    tb = _m3_sql("(toxic * (1 + id % 3))", "toxic", "intensity")
    normal = (f"('Quality(' || CAST({qb} AS VARCHAR) || '), Toxic(' || CAST({tb} AS VARCHAR) || ')' || "
              f"CASE WHEN id % 13 = 0 THEN ', quality(2)' ELSE '' END)")
    content_b = ("CASE WHEN id % 19 = 0 THEN 'Quality(x), Toxic(2)' "
                 "WHEN id % 23 = 0 THEN 'Quality(2)(3), toxic(9)' "
                 "WHEN id % 29 = 0 THEN 'Joy(1),  TOXIC ( 3 ).' "
                 "WHEN id % 31 = 0 THEN 'toxic(-1), quality (+2), toxic)1(2)' "
                 f"ELSE {normal} END")
    c["responses_b"] = (f"SELECT lang, id, CASE WHEN id % 17 = 0 THEN '{ERROR_REPLY}' "
                        f"ELSE {_wrap_sql(content_b)} END AS raw FROM gold_wide")
    c["texts"] = (f"SELECT lang, doc_id AS id, text || ' ' || {_tokens_sql()}[CAST(doc_id % 16 + 1 AS INTEGER)] "
                  f"|| ' end' AS text FROM documents")
    dirty = ("CASE WHEN id % 10 = 0 THEN 'x' WHEN id % 11 = 0 THEN NULL "
             "WHEN id % 7 = 0 THEN CAST({c} AS VARCHAR) || '.9' ELSE CAST({c} AS VARCHAR) END")
    c["train_base"] = (f"SELECT d.doc_id AS id, d.lang, d.text, {dirty.format(c='l.quality').replace('id %', 'd.doc_id %')} AS quality, "
                       f"{dirty.format(c='l.toxic').replace('id %', 'd.doc_id %')} AS toxic "
                       f"FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    c["done"] = ("SELECT lang, id FROM responses_a WHERE (CASE WHEN json_valid(raw) "
                 "THEN json_extract_string(raw, '$.choices[0].message.content') END) IS NOT NULL")
    c["dup_pred"] = ("SELECT * FROM pred WHERE NOT (model = 'm2' AND id % 60 = 0) "
                     "UNION ALL SELECT * FROM pred WHERE model = 'm1' AND id % 50 = 0")
    return c


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with every fixture CTE (DuckDB drops the unused ones)."""
    ctes = dict(duck_ctes())
    ctes.update(extra or {})
    text = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {text}\n{body}"
