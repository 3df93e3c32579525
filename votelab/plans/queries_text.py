"""Registered queries for the text preprocessing and decoding functions (C1-C14), over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import decode as D
from ..functions import text as X
from ..operators import schema as S
from ..registry import register
from ..sources import fixtures as fx
from ..sources.tables import read_table

W = fx.with_ctes
CATALOG_SQL = {"catalog": "SELECT DISTINCT lang, label FROM gold"}


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return S.label_catalog(fx.gold_table(spark, sf))


@register("replace_emoticons", lambda: W(f"SELECT lang, id, {X.replace_emoticons_sql('text')} AS text FROM texts"))
def replace_emoticons(spark: SparkSession, sf: str) -> DataFrame:
    """Emoticons to words, in list order, on every document's whole text."""
    return fx.texts(spark, sf).select("lang", "id", X.replace_emoticons("text").alias("text"))


@register("replace_emoticons_urls", lambda: f"SELECT page_id, {X.replace_emoticons_sql('url')} AS url FROM pages")
def replace_emoticons_urls(spark: SparkSession, sf: str) -> DataFrame:
    """C1 on page URLs: ':/' inside 'http://' is replaced too (sequential replacement, kept)."""
    return read_table(spark, sf, "pages").select("page_id", X.replace_emoticons("url").alias("url"))


@register("replace_emojis", lambda: W(f"SELECT lang, id, {X.replace_emojis_sql('text')} AS text FROM texts"))
def replace_emojis(spark: SparkSession, sf: str) -> DataFrame:
    """Emojis to ' name ' from the dictionary table."""
    return fx.texts(spark, sf).select("lang", "id", X.replace_emojis("text").alias("text"))


@register("preprocess_text", lambda: W(
    f"SELECT lang, id, {X.replace_emojis_sql(X.replace_emoticons_sql('text'))} AS text FROM texts"))
def preprocess_text(spark: SparkSession, sf: str) -> DataFrame:
    """Emoticons, then emojis."""
    return fx.texts(spark, sf).select("lang", "id", X.preprocess_text("text").alias("text"))


@register("truncate_tokens", lambda: W(f"SELECT lang, id, {X.truncate_words_sql('text')} AS text FROM texts"))
def truncate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """C4: at most 512 words per text (the scorer's input length), re-joined by single spaces."""
    return fx.texts(spark, sf).select("lang", "id", X.truncate_words("text").alias("text"))


def _msg_sql(prompt: str, sep: str) -> str:
    return "'" + (prompt + sep).replace("'", "''") + "' || text"


@register("build_requests", lambda: W(
    f"SELECT lang, id, {_msg_sql(D.PROMPT_LABELS, D.SEPARATOR_LABELS)} AS message_labels, "
    f"{_msg_sql(D.PROMPT_INTENSITY, D.SEPARATOR_INTENSITY)} AS message_intensity, "
    f"to_json({{'model': '{D.CHAT_MODEL}', 'messages': [{{'role': 'user', 'content': "
    f"{_msg_sql(D.PROMPT_LABELS, D.SEPARATOR_LABELS)}}}]}}) AS payload FROM texts"))
def build_requests(spark: SparkSession, sf: str) -> DataFrame:
    """The chat request for every text: message for both prompts and the JSON payload."""
    t = fx.texts(spark, sf)
    m = D.request_message("text", "labels")
    return t.select("lang", "id", m.alias("message_labels"),
                    D.request_message("text", "intensity").alias("message_intensity"),
                    D.request_payload(m).alias("payload"))


@register("response_content", lambda: W(
    f"SELECT 'labels' AS kind, lang, id, {D.reply_content_sql('raw')} AS content FROM responses_a UNION ALL "
    f"SELECT 'intensity' AS kind, lang, id, {D.reply_content_sql('raw')} AS content FROM responses_b"))
def response_content(spark: SparkSession, sf: str) -> DataFrame:
    """Reply content, lower-cased; '' for error replies."""
    a = fx.responses_a(spark, sf).select(F.lit("labels").alias("kind"), "lang", "id", D.reply_content("raw").alias("content"))
    b = fx.responses_b(spark, sf).select(F.lit("intensity").alias("kind"), "lang", "id", D.reply_content("raw").alias("content"))
    return a.unionByName(b)


@register("parse_label_list", lambda: W(
    f"SELECT r.lang, r.id, c.label, CASE WHEN list_contains({D.label_list_sql(D.reply_content_sql('r.raw'))}, c.label) "
    f"THEN 1 ELSE 0 END AS value FROM responses_a r JOIN catalog c ON c.lang = r.lang", CATALOG_SQL))
def parse_label_list(spark: SparkSession, sf: str) -> DataFrame:
    """Comma list of labels -> 0/1 per label of the language; other labels dropped."""
    return D.parse_replies(fx.responses_a(spark, sf), _catalog(spark, sf), "labels")


def parse_intensity_sql(extra: dict[str, str] | None = None) -> str:
    pairs = D.intensity_pairs_sql(D.reply_content_sql("r.raw"))
    return W(f"SELECT r.lang, r.id, c.label, CAST({D.intensity_for_sql(pairs, 'c.label')} AS BIGINT) AS value "
             f"FROM responses_b r JOIN catalog c ON c.lang = r.lang", {**CATALOG_SQL, **(extra or {})})


@register("parse_intensity_list", parse_intensity_sql)
def parse_intensity_list(spark: SparkSession, sf: str) -> DataFrame:
    """C11: 'joy(2), fear(1)' -> intensity per label of the language (last wins, malformed pieces skipped)."""
    return D.parse_replies(fx.responses_b(spark, sf), _catalog(spark, sf), "intensity")


def _decode_sql(expr: str) -> str:
    return W(f"SELECT k.lang, k.model, k.id, c.label, CAST(coalesce(max({expr}), 0) AS INTEGER) AS value "
             f"FROM (SELECT t.lang, m.model, t.id FROM texts t CROSS JOIN members m) k JOIN catalog c ON c.lang = k.lang "
             f"LEFT JOIN scores s ON s.lang = k.lang AND s.model = k.model AND s.id = k.id AND lower(s.label) = c.label "
             f"GROUP BY k.lang, k.model, k.id, c.label", CATALOG_SQL)


@register("score_to_binary", lambda: _decode_sql("CASE WHEN s.score > 0.5 THEN 1 ELSE 0 END"))
def score_to_binary(spark: SparkSession, sf: str) -> DataFrame:
    """Score > 0.5 (strict) per label of the language for every text and member; missing labels and
    unscored texts 0."""
    return D.decode_scores(fx.scores(spark, sf), _catalog(spark, sf), "binary",
                           fx.texts(spark, sf).select("lang", "id"), [m for m, _, _ in fx.MEMBERS])


@register("score_to_intensity", lambda: _decode_sql("CAST(round_even(s.score * 3, 0) AS INTEGER)"))
def score_to_intensity(spark: SparkSession, sf: str) -> DataFrame:
    """round(3 * score), half to even."""
    return D.decode_scores(fx.scores(spark, sf), _catalog(spark, sf), "intensity",
                           fx.texts(spark, sf).select("lang", "id"), [m for m, _, _ in fx.MEMBERS])


@register("logit_to_binary", lambda: W(
    "SELECT lang, model, id, label, CASE WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS value FROM logits"))
def logit_to_binary(spark: SparkSession, sf: str) -> DataFrame:
    """sigmoid(logit) >= 0.5 (inclusive)."""
    return fx.logits(spark, sf).select("lang", "model", "id", "label", D.logit_to_binary("logit").alias("value"))
