"""The logistic trainer (T4) reads its pool once."""

from pyspark.sql import functions as F

from votelab.operators import scoring as SC


def test_every_text_is_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def passed(text):
        read.add(1)
        return text

    rows = [("en", i, "good fine text" if i % 2 else "bad poor words", i % 2, i % 3 == 0, "test" if i % 5 == 0 else "train") for i in range(60)]
    pool = spark.createDataFrame([(a, i, t, q, int(x), s) for a, i, t, q, x, s in rows], "lang string, id long, text string, quality int, toxic int, split string")
    scores = SC.train_baseline(pool.withColumn("text", F.udf(passed, "string")("text")), ["quality", "toxic"])
    got = {(r["id"], r["label"]): r["score"] for r in scores.collect()}
    assert read.value == 60 and len(got) == 24
    assert all((got[i, "quality"] > 0.5) == (i % 2 == 1) for i in range(0, 60, 5))
