"""T4 in closed form: multinomial naive Bayes from integer word counts.

Fitting is one aggregate over the training words; scoring adds each held-out word's log odds. Log odds are kept in
millionths as integers, so sums don't depend on their order and every engine gives the same decision.

Skew: word counts are combined before every shuffle. Words that make up more than one in ``HOT`` of all training words
are at most ``HOT`` many: they are broadcast, and the others are joined by a shuffle in which no training word holds more
than that share. Nothing else depends on the vocabulary's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

HOT = 10_000
UNIT = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words of a text (runs outside ASCII white space), A-Z in lower case; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _micro(num, den) -> Column:
    """ln(num / den) in millionths."""
    return F.round(F.log(num.cast("double") / den.cast("double")) * UNIT).cast("long")


def fit(train: DataFrame, labels: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """``(word, n, <label> counts)`` of all training words as a written table, and one log odds per label for a text
    without words. Words are counted as often as they occur; a label is 1 or counts as 0."""
    spark = train.sparkSession
    ones = [F.coalesce((F.col(lab) == 1).cast("long"), F.lit(0).cast("long")).alias(f"p{k}") for k, lab in enumerate(labels)]
    rows = train.select(*ones, words_of(F.col("text")).alias("words"))
    counts = rows.select(*[f"p{k}" for k in range(len(labels))], F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(f"p{k}").alias(f"n{k}") for k in range(len(labels))])
    path = scratch_path(spark, "word-counts")
    counts.write.parquet(path)
    table = spark.read.schema(counts.schema).parquet(path)
    sums = table.agg(F.count("*").alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                     *[F.coalesce(F.sum(f"n{k}"), F.lit(0)).alias(f"n{k}") for k in range(len(labels))]).first()
    texts = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).alias(f"p{k}") for k in range(len(labels))])
    prior = texts.select(*[_micro(F.col(f"p{k}") + 1, F.col("rows") - F.col(f"p{k}") + 1).alias(lab) for k, lab in enumerate(labels)]).first().asDict()
    odds = table.select("word", "n", *[
        (_micro(F.col(f"n{k}") + 1, F.lit(sums[f"n{k}"] + sums["v"])) - _micro(F.col("n") - F.col(f"n{k}") + 1, F.lit(sums["n"] - sums[f"n{k}"] + sums["v"]))).alias(f"w{k}")
        for k in range(len(labels))])
    hot = F.col("n") * HOT > sums["n"]
    return odds.withColumn("hot", hot), prior


def score(rows: DataFrame, model: tuple[DataFrame, dict[str, int]], labels: list[str], model_name: str = "naive-bayes") -> DataFrame:
    """Long scores ``(lang, model, id, label, log_odds)`` of every row, log odds in millionths; words that training
    lacks add nothing. Rows that share ``(lang, id)`` count as one text."""
    odds, prior = model
    ws = [f"w{k}" for k in range(len(labels))]
    said = rows.select("lang", "id", F.explode(words_of(F.col("text"))).alias("word")).groupBy("lang", "id", "word").agg(F.count("*").alias("times"))
    common = F.broadcast(odds.where("hot").select("word", *ws))
    # the common words leave before the shuffle by word
    marked = said.join(common, "word", "left")
    add = lambda d: d.select("lang", "id", *[(F.col("times") * F.col(w)).alias(w) for w in ws])
    rare = marked.where("w0 is null").select("lang", "id", "word", "times").join(odds.where("not hot").select("word", *ws), "word")
    start = rows.select("lang", "id").distinct().select("lang", "id", *[F.lit(int(prior[lab])).cast("long").alias(w) for w, lab in zip(ws, labels)])
    total = start.unionByName(add(marked.where("w0 is not null"))).unionByName(add(rare)).groupBy("lang", "id").agg(*[F.sum(w).alias(w) for w in ws])
    items = F.array(*[F.struct(F.lit(lab).alias("label"), F.col(w).alias("log_odds")) for w, lab in zip(ws, labels)])
    return total.select("lang", "id", F.explode(items).alias("x")).select("lang", F.lit(model_name).alias("model"), F.col("id").cast("long").alias("id"), "x.label", "x.log_odds")
