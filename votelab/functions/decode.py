"""Decoders: model scores, logits and raw LLM replies to label values, as native column expressions.

* C5  ``score_to_binary``:    1 if score > 0.5 (strict)
* C6  ``score_to_intensity``: round(3 * score) half-to-even (``bround``; plain ``round`` differs at 1/6, 5/6)
* C8  ``request_message``:    prompt prefix + separator + text; ``request_payload`` the chat JSON
* C9  ``reply_content``:      choices[0].message.content, lower-cased; '' when absent or not JSON
* C10 ``label_list``:         comma list -> stripped items; a label is 1 when it is an item
* C11 ``intensity_pairs``:    'joy(2), fear(1)' -> array<struct<label, v>>; a piece counts only if it has
  both '(' and ')', splits on '(' into exactly two parts and the number (')' removed, stripped) is an
  integer; the last piece for a label wins; no clamping
* C12 ``py_strip``:           strip Unicode whitespace at both ends (``trim`` only removes spaces)
* C13 ``logit_to_binary``:    sigmoid(logit) >= 0.5 (inclusive)
* C14 ``binarize``:           value >= 1
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two prompt prefixes and separators of the LLM requests.
PROMPT_LABELS = (
    "Classify emotion from the given text into one or more: Joy, Fear, Anger, Sadness, Disgust, Surprise. \n"
    "The output is only the multilabel classes (Joy, Fear, Anger, Sadness, Disgust, Surprise) and separated by a comma.  \n"
    "Do not use other unspecified classes. Do not output the reasoning statement or unnecessary sentences. \n"
    "If you don't know or unsure, translate into English first. \n"
    "If you cannot translate directly to English, translate it first to another known language, and from that another known language to English.\n"
    "The translation can be transitive through more than one language."
)
PROMPT_INTENSITY = (
    "Classify the given text into one or more emotion categories: Joy, Sadness, Fear, Anger, Surprise, or Disgust. "
    "Each emotion should be assigned an intensity score between 0 and 3, where 0 means no intensity and 3 means the highest intensity.\n\n"
    "The output format should be a comma-separated list of emotions with their intensity scores in parentheses, e.g., 'Joy(2), Fear(1), Anger(0)'.\n\n"
    "Do not include emotions that are not specified. Do not add any reasoning, explanation, or extra sentences.\n\n"
    "If the text is not in English, translate it first to English. If a direct English translation is not possible, use an intermediate language before translating to English. "
    "The translation can be transitive through multiple languages if necessary."
)
SEPARATOR_LABELS = " The text is: "
SEPARATOR_INTENSITY = " The text is:"
CHAT_MODEL = "llama3.3:latest"

SCORE_THRESHOLD = 0.5
CONTENT_PATH = "$.choices[0].message.content"
INT_PATTERN = r"^[+-]?[0-9]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x) -> Column:
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def score_to_binary(score) -> Column:
    return F.when(_c(score) > SCORE_THRESHOLD, 1).otherwise(0)


def score_to_intensity(score) -> Column:
    return F.bround(_c(score) * 3, 0).cast("int")


def logit_to_binary(logit) -> Column:
    return F.when(1 / (1 + F.exp(-_c(logit))) >= 0.5, 1).otherwise(0)


def request_message(text, kind: str = "labels") -> Column:
    if kind == "labels":
        return F.concat(F.lit(PROMPT_LABELS + SEPARATOR_LABELS), _c(text))
    return F.concat(F.lit(PROMPT_INTENSITY + SEPARATOR_INTENSITY), _c(text))


def request_payload(message) -> Column:
    msg = F.struct(F.lit("user").alias("role"), _c(message).alias("content"))
    return F.to_json(F.struct(F.lit(CHAT_MODEL).alias("model"), F.array(msg).alias("messages")))


def reply_content(raw) -> Column:
    return F.lower(F.coalesce(F.get_json_object(_c(raw), CONTENT_PATH), F.lit("")))


def usable_reply(raw) -> Column:
    """Whether a stored reply has content (S9): error replies and missing ones don't."""
    return F.get_json_object(_c(raw), CONTENT_PATH).isNotNull()


def label_list(content) -> Column:
    return F.transform(F.split(_c(content), ",", -1), lambda x: py_strip(x))


def label_flag(items, label) -> Column:
    return F.when(F.array_contains(_c(items), _c(label)), 1).otherwise(0)


def intensity_pairs(content) -> Column:
    pieces = F.transform(F.split(_c(content), ",", -1), lambda x: py_strip(x))
    bracketed = F.filter(pieces, lambda x: (F.instr(x, "(") > 0) & (F.instr(x, ")") > 0))
    parts = F.transform(bracketed, lambda x: F.split(x, r"\(", -1))

    def num(a):
        return py_strip(F.replace(F.try_element_at(a, F.lit(2)), F.lit(")"), F.lit("")))

    ok = F.filter(parts, lambda a: (F.size(a) == 2) & num(a).rlike(INT_PATTERN))
    return F.transform(ok, lambda a: F.struct(py_strip(F.lower(F.element_at(a, 1))).alias("label"),
                                              num(a).try_cast("bigint").alias("v")))


def intensity_for(pairs, label) -> Column:
    """Last value given for ``label`` (0 when none)."""
    hits = F.filter(_c(pairs), lambda x: x["label"] == _c(label))
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["v"], F.lit(0).cast("long"))


# ---------------------------------------------------------------- DuckDB text (oracle side)

def py_strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def reply_content_sql(raw: str) -> str:
    return (f"lower(coalesce(CASE WHEN json_valid({raw}) THEN json_extract_string({raw}, '{CONTENT_PATH}') END, ''))")


def label_list_sql(content: str) -> str:
    return f"list_transform(string_split({content}, ','), lambda x: {py_strip_sql('x')})"


def intensity_pairs_sql(content: str) -> str:
    pieces = f"list_transform(string_split({content}, ','), lambda x: {py_strip_sql('x')})"
    bracketed = f"list_filter({pieces}, lambda x: contains(x, '(') AND contains(x, ')'))"
    parts = f"list_transform({bracketed}, lambda x: string_split(x, '('))"
    num = py_strip_sql("replace(a[2], ')', '')")
    ok = f"list_filter({parts}, lambda a: len(a) = 2 AND regexp_full_match({num}, '[+-]?[0-9]+'))"
    return (f"list_transform({ok}, lambda a: {{'label': {py_strip_sql('lower(a[1])')}, "
            f"'v': TRY_CAST({num} AS BIGINT)}})")


def intensity_for_sql(pairs: str, label: str) -> str:
    return f"coalesce(list_filter({pairs}, lambda x: x.label = {label})[-1].v, 0)"


# (lang, label) pairs of a label catalog inlined as a constant map; up to MAX_BROADCAST_CATALOG the
# catalog is broadcast, beyond it a plain join.
MAX_INLINE_CATALOG = 4096
MAX_BROADCAST_CATALOG = 1_000_000


def _labels_map(catalog):
    """(constant lang -> labels map Column, catalog) when the catalog has at most MAX_INLINE_CATALOG
    rows (bounded read), else (None, catalog); an empty catalog gives an empty map."""
    cat = catalog.select("lang", "label").where("lang is not null")
    rows = cat.limit(MAX_INLINE_CATALOG + 1).collect()
    if len(rows) > MAX_INLINE_CATALOG:
        return None, cat
    by_lang: dict = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r.label)
    if not by_lang:
        return F.create_map().cast("map<string,array<string>>"), cat
    return F.create_map(*[x for k, labs in by_lang.items()
                          for x in (F.lit(k), F.array(*[F.lit(v) for v in labs]))]), cat


def _join_catalog(df, cat, on, how: str = "inner"):
    """Join with a catalog too large to inline: broadcast behind a second bounded count, else plain."""
    if cat.limit(MAX_BROADCAST_CATALOG + 1).count() <= MAX_BROADCAST_CATALOG:
        return df.join(F.broadcast(cat), on, how)
    return df.join(cat, on, how)


def in_language_labels(df, catalog):
    """Rows of ``df`` whose (lang, label) is in the catalog, as a left semi join would keep: a filter
    on a constant map when the catalog is small, else a size-checked broadcast semi join."""
    m, cat = _labels_map(catalog)
    if m is None:
        return _join_catalog(df, cat, ["lang", "label"], "left_semi").select(*df.columns)
    return df.where(F.coalesce(F.array_contains(F.element_at(m, F.col("lang")), F.col("label")), F.lit(False)))


def with_language_labels(df, catalog):
    """Each row of ``df`` once per label its language has (the rows of a language without labels
    drop out), as an inner join with the catalog on ``lang`` would give. The catalog is read with a
    bounded ``limit``: when small, the fan-out is an ``explode`` of a constant lang -> labels map (no
    join, no shuffle, also for streams); else a broadcast join when a second bounded count proves its
    size, else a plain join. Data-sized rows are never shuffled by language."""
    m, cat = _labels_map(catalog)
    if m is None:
        return _join_catalog(df, cat, "lang").select(*df.columns, "label")
    return df.select("*", F.explode(F.element_at(m, F.col("lang"))).alias("label"))


def decode_scores(scores, catalog, mode: str = "binary", texts=None, models: list[str] | None = None):
    """Scorer output (lang, model, id, label, score) -> (lang, model, id, label, value) for
    every label the language's gold has: label names lower-cased, unknown labels ignored, a label the
    scorer did not emit is 0, a repeated label keeps its highest value. With ``texts`` (lang, id) and the
    ``models`` asked, a text for which a model has no score at all gets zeros too.

    One exchange: the decoded values of a (lang, model, id) meet in a set (bounded by the labels, combined
    map-side), with the texts as members of the same aggregate; labels fan out within the row."""
    dec = score_to_binary if mode == "binary" else score_to_intensity
    rows = scores.select("lang", "model", "id", F.struct(F.lower("label").alias("label"), dec("score").cast("int").alias("v")).alias("e"))
    if texts is not None:
        asked = F.explode(F.array(*[F.lit(m) for m in models or []]).cast("array<string>"))
        rows = rows.unionByName(texts.select("lang", "id", asked.alias("model")).withColumn("e", F.lit(None).cast(rows.schema["e"].dataType)))
    held = rows.groupBy("lang", "model", "id").agg(F.collect_set("e").alias("e"))
    x = with_language_labels(held, catalog)
    mine = F.array_max(F.transform(F.filter("e", lambda s: s["label"] == F.col("label")), lambda s: s["v"]))
    return x.select("lang", "model", "id", "label", F.coalesce(mine, F.lit(0)).alias("value"))


def parse_replies(replies, catalog, kind: str = "labels"):
    """Raw replies (lang, id, raw) -> (lang, id, label, value) for the language's labels."""
    content = reply_content("raw")
    if kind == "labels":
        parsed = replies.select("lang", "id", label_list(content).alias("items"))
        x = with_language_labels(parsed, catalog)
        return x.select("lang", "id", "label", label_flag("items", "label").alias("value"))
    parsed = replies.select("lang", "id", intensity_pairs(content).alias("pairs"))
    x = with_language_labels(parsed, catalog)
    return x.select("lang", "id", "label", intensity_for("pairs", "label").alias("value"))
