"""The registered queries of this subpackage: each applies one operator, with production parameters, to its
whole table and derives the digest columns of its contract."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table
from ..sources.tables import read_table
from . import bpe, chat, decontam, langid, licenses, loglinear, nbsvm, neardup, phrases, pii, rules, substrings, whitening
from .common import crc_mod

QUERIES = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE[name] = oracle
        return fn
    return deco


def word_vocabulary() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def id_digest(ids) -> F.Column:
    """Lower-case hex SHA-256 of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids and their decoded text, as digests."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, word_vocabulary(), decoded="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest(F.col("ids")).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the rows outside the held-out fold only."""
    return langid.train(docs.where(crc_mod("doc_id", 4) != 2))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = read_table(spark, sf_dir, "documents")
    out = langid.identify(docs.select("doc_id", "text"), language_model(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    out = rules.apply_rules(docs, rules.train(docs, labels))
    return out.select("doc_id", *rules.COUNTS, "base_failed", "score", "kept")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 4) != 2)
    out = nbsvm.score(docs, nbsvm.train(docs, labels))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                      (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: Conversation -1 of the contract, beside the table's.
CONTROL_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS body,
    length(regexp_replace(replace(replace(role, '\', '\b'), chr(10), '\n'), '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')) AS head
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE WHEN role = 'assistant' THEN body + 4 ELSE 14 + head + body END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op5_chat", _CHAT_SQL)
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what can be read back from the formatted string and its mask."""
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = local_table(spark, CONTROL_TURNS, "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_events(chat.turn_events(turns.unionByName(more)))
    read = out.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return neardup.link(read_table(spark, sf_dir, "documents"))


_SHINGLES_SQL = """
  SELECT {id}, unnest(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM {table}) WHERE len(w) >= 5"""
_LEAKS_SQL = f"""
WITH d AS ({_SHINGLES_SQL.format(id="doc_id", table="documents")}),
i AS ({_SHINGLES_SQL.format(id="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT d.doc_id, i.item_id, n.n_shingles, count(*) AS n_common
FROM d JOIN i ON d.s = i.s JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n_shingles HAVING 100 * count(*) >= 80 * n.n_shingles
"""


@query("op7_decontamination", _LEAKS_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document contains at least 0.8 of the item's shingles."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.contained(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.n_shingles", "leak.n_common")


@query("op3_substrings")
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that a document repeats from another."""
    return substrings.passages(read_table(spark, sf_dir, "documents"))


@query("op6_lm_scores")
def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return loglinear.scores(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document. The table has no paths: a document's is its source, its thousand and its id."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(
        "/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")).alias("path"))
    out = licenses.inherit(licenses.scan(docs).drop("text"))
    return out.select("doc_id", "path", "own_licence", "licence_score", "licence", "licence_from")


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whitened components of every usable vector."""
    rows = whitening.usable_rows(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    model = whitening.train(rows)
    error = whitening.identity_error(rows, model)
    explained = F.array(*[F.lit(float(e)) for e in model.explained])
    out = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                      F.get(explained, F.col("at")).cast("double").alias("explained"), F.lit(error).alias("identity_error"))


_PHRASES_SQL = r"""
WITH w AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^.,;:!?\x0A-\x0D]+')) AS p FROM documents)),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g
      FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
cut AS (SELECT lang, k, g, f, j, array_to_string(string_split(g, ' ')[1:j], ' ') AS p, array_to_string(string_split(g, ' ')[j + 1:k], ' ') AS q
        FROM (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM c WHERE k > 1)),
s AS (SELECT cut.lang, cut.k, cut.g AS phrase, cut.f AS a, x.f AS l, y.f AS r, n.n, j,
        (1000::HUGEINT * cut.f * n.n) // (x.f::HUGEINT * y.f) AS score
      FROM cut JOIN c x ON x.lang = cut.lang AND x.g = p JOIN c y ON y.lang = cut.lang AND y.g = q JOIN n ON n.lang = cut.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.f >= 100 * b.a
                                        AND contains(' ' || c.g || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM o QUALIFY rank <= 2000
"""


@query("op11_phrases", _PHRASES_SQL)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of every language."""
    return phrases.mine(read_table(spark, sf_dir, "documents"))


@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.spans(docs, pii.train(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, ("email", "ip", "card", "phone")), F.sha2(pii.listing(base), 256).alias("base_sha256"), pii.listing(F.col("spans")).alias("spans"))
