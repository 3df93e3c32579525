"""BPE, text buffers, language ID, quality operators and licences."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from votelab.llm import bpe, langid, licenses, nbsvm, rules, textbuf
from votelab.llm.queries import word_vocabulary

DIR = "/root/testdata/sf0.001"
ODD = [None, "", "   \n\t ", "a", "A a\x0bb\fc\rd", "é" * 3000, "word " * 5000, "x" * 200_000, "日本語 テキスト",
       "don't I'LL <|endoftext|> </w> a<|startoftext|>b", "ΑΣ ΣΟΦΟΣ İ", "same", "same", "\x00 \x1c\x1d z\x85y"]


def words_of(text, lower=True):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w] if lower else w


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts with a repeated row and columns that clash with every operator's outputs."""
    rows = [(i, t, "en", f"old{i}") for i, t in enumerate(ODD)] + [(3, "a", "en", "old3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    for c in ("ids", "IDS2", "decoded", "lang_pred", "accepted", "n_words", "kept", "licence", "own_licence", "leaks"):
        df = df.withColumn(c, F.lit("old"))
    return df


def test_words_and_windows_match_plain_splitting():
    texts = [*ODD, *["".join(np.random.default_rng(i).choice(list("ab \n\té"), 25)) for i in range(200)]]
    seen, windows = {}, {}
    for most in (64, 1 << 20):
        for g in textbuf.groups(pa.array(texts), most):
            w = textbuf.words(g)
            h, at, off = textbuf.windows(w.hash, w.off, 3)
            for d in range(len(g.off) - 1):
                a, b = w.off[d], w.off[d + 1]
                got = [bytes(g.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b])]
                assert got == words_of(texts[g.first + d], False)
                ref = words_of(texts[g.first + d])
                for x, v in zip(ref, w.hash[a:b]):
                    assert seen.setdefault(x, int(v)) == int(v)
                assert off[d + 1] - off[d] == max(0, len(ref) - 2)
                for i in range(max(0, len(ref) - 2)):
                    v = int(h[off[d] + i])
                    assert windows.setdefault(tuple(ref[i:i + 3]), v) == v
    assert len(set(seen.values())) == len(seen) and len(set(windows.values())) == len(windows)


def test_bpe_equals_the_tokenizers_library(spark, docs, odd):
    t = Tokenizer.from_file(word_vocabulary())
    out = bpe.encode(docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text")), word_vocabulary(), decoded="decoded").collect()
    for r in out:
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["decoded"] == t.decode(want, skip_special_tokens=False)


def test_every_code_point_is_split_as_by_the_tokenizers_library():
    codec, t = bpe.Codec(*bpe._spec(word_vocabulary())), Tokenizer.from_file(word_vocabulary())
    strings = [f"a{chr(i)}b {chr(i)}1 x{chr(i)}" for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    blocks = [" ".join(strings[i: i + 200]) for i in range(0, len(strings), 200)]
    want = t.encode_batch(blocks, add_special_tokens=False)
    differ = [i for i, (x, w) in enumerate(zip(blocks, want)) if np.frombuffer(codec.encode(x), np.int32).tolist() != w.ids]
    assert differ == []


def test_forced_cuts_never_change_a_word():
    codec = bpe.Codec(*bpe._spec(word_vocabulary()))
    assert 0 < sum(codec.joins) < 65536
    rng = np.random.default_rng(3)
    for _ in range(300):
        w = "".join(rng.choice(list("theandingß日é"), rng.integers(1, 60)))
        raw = w.encode()
        whole = [*(codec.inner[x] for x in raw[:-1]), codec.final[raw[-1]]]
        assert codec.word_ids(w) == codec._merged_long(list(whole))


def test_bpe_decode_and_clashing_columns(spark, odd):
    out = bpe.encode(odd, word_vocabulary(), decoded="decoded")
    assert sorted(out.columns) == sorted(odd.columns)
    back = bpe.decode(out.withColumnRenamed("decoded", "d1"), word_vocabulary(), out="d2")
    assert all(r["d1"] == r["d2"] for r in back.collect())
    assert bpe.encode(odd.limit(0), word_vocabulary()).count() == 0


def test_language_id_on_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    m = langid.train(d.where(~held))
    got = langid.identify(d.where(held).select("doc_id", "text", "lang"), m).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.97
    assert got["accepted"].mean() > 0.98 and got["score"].between(0, 1).all()
    strange = spark.createDataFrame([(1, "Съешь же ещё этих мягких французских булок " * 20), (2, "123 !?"), (3, None), (4, "")], "doc_id long, text string")
    got = langid.identify(strange, m).orderBy("doc_id").collect()
    assert not any(r["accepted"] for r in got)
    assert [r["lang_pred"] for r in got[1:]] == ["und"] * 3 and all(r["score"] == 0 for r in got[1:])


def test_language_probabilities_sum_to_one():
    texts = ["the cat and the hat", "then they ate", "that is the thing"] * 3
    m = langid.fit(texts, ["en"] * len(texts))
    letters = sorted({c for t in texts for c in t})
    for ctx in ("the", "zzz", " th"):
        c = langid.normalise([ctx.strip() + "a"])
        total = 0.0
        for x in letters + ["ü"]:        # one unseen letter stands for all of them
            code = np.array([ord(y) for y in ctx + x], np.uint64)
            total += float(np.exp(m.log_probs(langid.gram_hashes(code), np.array([0])))[0, 0])
        assert total == pytest.approx(1, abs=1e-4), c


def test_language_id_edge_cases(spark, odd):
    m = langid.train(odd.where("1 = 0"))
    got = langid.identify(odd, m).toPandas()
    assert set(got["lang_pred"]) == {"und"} and len(got) == len(ODD) + 1
    assert langid.identify(odd.limit(0), langid.train(odd)).count() == 0
    assert langid.identify(odd, langid.train(odd.withColumn("lang", F.lit(None).cast("string")))).count() == len(ODD) + 1


def plain_counts(text):
    w = words_of(text, False)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    c = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    rep = {j for i in range(len(w) - 7) if c[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(rep)]


def test_rows_without_id_or_of_one_id_are_drawn_like_others(spark):
    rng = random.Random(12)
    text = lambda c: " ".join("".join(rng.choice(c) for _ in range(5)) for _ in range(12))
    rows = [(None if i % 2 else i, text("abcdefgh"), "xx") for i in range(6000)] + [(7, text("klmnopqr"), "yy") for _ in range(3000)]
    seen = []
    fit, langid.fit = langid.fit, lambda t, g: seen.append((t, g)) or fit(t, g)
    try:
        langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    finally:
        langid.fit = fit
    texts, langs = seen[0]
    assert langs.count("xx") == langs.count("yy") == langid.SAMPLE_DOCS
    null = {t for i, t, _ in rows if i is None}
    assert 150 < sum(t in null for t in texts) < 350


def test_garbage_among_the_labelled_texts_is_still_rejected():
    rng = random.Random(13)
    words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    clean = lambda: " ".join(rng.choice(words) for _ in range(60))
    garbage = lambda: " ".join("".join(rng.choice("qxzjkvwyphg") for _ in range(7)) for _ in range(50))
    texts = [garbage() if i % 26 == 0 else clean() for i in range(500)]
    model = langid.fit(texts, ["xx"] * len(texts))
    assert model.predict([clean() for _ in range(100)])[2].sum() >= 99
    assert model.predict([garbage() for _ in range(50)])[2].sum() == 0


def test_samples_of_repeated_ids_are_bounded(spark):
    docs = spark.createDataFrame([(1, f"text number {i} of the one id") for i in range(3000)] + [(i, f"other {i}") for i in range(2, 50)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 50)], "doc_id long, quality int")
    rows = docs.select(F.col("doc_id").alias("i"), F.col("text").alias("t")).join(rules.draw(labels, "quality", "doc_id", 100), "i")
    assert rows.count() > 3000 and rules.bounded(rows, 100).count() == 100 and rules.bounded(rows.where("i > 1"), 100).count() == 48
    copies = spark.createDataFrame([(1, "same", 0)] * 500, "i long, t string, y int")
    assert rules.bounded(copies, 100).count() <= 100


def test_statistics_match_plain_counts(spark, docs, odd):
    both = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    for r in rules.with_statistics(both).collect():
        assert [r[c] for c in rules.COUNTS] == plain_counts(r["text"])


def test_trees_are_monotonic_and_flat_scoring_equals_walking():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(2000) < 0.1)).astype(float)
    trees = rules.fit(x, y, trees=20, constraints=[-1, 0, 1])
    s = trees.scores(x)
    assert ((s > 0.5) == (y > 0)).mean() > 0.85
    grid = np.linspace(0, 1, 60)
    for j, sign in ((0, -1), (2, 1)):
        for row in x[:20]:
            line = np.repeat(row[None], 60, axis=0)
            line[:, j] = grid
            assert (sign * np.diff(trees.scores(line)) >= -1e-12).all()
    for row, want in zip(x[:50], trees.margins(x[:50])):
        total = trees.base
        for at in trees.roots:
            while trees.feature[at] >= 0:
                at = trees.left[at] + (row[trees.feature[at]] > trees.limit[at])
            total += trees.value[at]
        assert total == pytest.approx(want)


def held_out(spark, op):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    y = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return op(d, y.where(~held)).join(y.where(held), "doc_id").toPandas()


def test_quality_rules_on_held_out_labels(spark, odd):
    got = held_out(spark, lambda d, y: rules.apply_rules(d, rules.train(d, y)))
    real = got[~got["base_failed"]]
    assert ((real["score"] >= 0.5) == (real["quality"] == 1)).mean() > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = rules.apply_rules(odd, rules.train(odd, none)).toPandas()
    assert len(out) == len(ODD) + 1 and out["base_failed"].equals(~out["kept"])


def test_quality_scores_on_held_out_labels(spark, odd):
    got = held_out(spark, lambda d, y: nbsvm.score(d, nbsvm.train(d, y)))
    good, bad = got.loc[got["quality"] == 1, "score"], got.loc[got["quality"] == 0, "score"]
    assert np.mean([(g > bad).mean() for g in good]) > 0.95 and (good >= 0.7).mean() > 0.8 and (bad < 0.7).mean() > 0.9
    one = spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int")
    out = nbsvm.score(odd, nbsvm.train(odd, one)).toPandas()
    assert out["score"].nunique() == 1 and len(out) == len(ODD) + 1


def test_quality_minimum_is_that_of_the_hinge_loss():
    """Dual coordinate descent against the primal objective of nearby points."""
    rows = [np.array([0, 1]), np.array([1, 2]), np.array([3]), np.array([3, 4]), np.array([0, 2])]
    sign, ratio = np.array([1.0, 1, -1, -1, 1]), np.ones(1 << nbsvm.BITS)
    w, b = nbsvm._descend(rows, sign, ratio, 1.0, 200)
    cost = np.where(sign > 0, 5 / 6, 5 / 4)

    def primal(w, b):
        m = np.array([w[r].sum() / np.sqrt(len(r)) + b for r in rows])
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - sign * m)).sum()

    best, rng = primal(w, b), np.random.default_rng(1)
    for _ in range(300):
        v = w.copy()
        v[:5] += rng.normal(0, 0.05, 5)
        assert primal(v, b + rng.normal(0, 0.05)) >= best - 1e-3


def test_licences_are_found_and_inherited(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    files = spark.createDataFrame([
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.txt", "plain words here"), (3, "a/b/c/LICENSE", apache),
        (4, "a/b/c/d/y.txt", "more plain words"), (5, "a/b/z.txt", f"some text\nmore text of this long file\n{apache}"), (6, "e/f.txt", None),
        (7, None, "no path"), (8, None, apache), (9, "a/LICENSE", "Released under the MIT License."), (10, "g", ""),
        (11, "a/b/c/q.txt", "the licence of this is secret"), (12, "LICENSE", "Licensed under CC BY-NC 4.0.")], "doc_id long, path string, text string")
    out = {r["doc_id"]: (r["own_licence"], r["licence"], r["licence_from"]) for r in licenses.inherit(licenses.scan(files)).collect()}
    assert out[1] == ("MIT", "MIT", "a/LICENSE") and out[2] == (None, "MIT", "a") and out[4] == (None, "Apache-2.0", "a/b/c")
    assert out[5] == ("Apache-2.0", "Apache-2.0", "a/b/z.txt") and out[6] == (None, "CC-BY-NC-4.0", "") and out[7] == (None, None, None)
    assert out[8][1] == "Apache-2.0" and out[11] == (None, "Apache-2.0", "a/b/c") and len(out) == 12
    assert licenses.inherit(licenses.scan(files.limit(0))).count() == 0


def test_licences_inside_long_lines_and_across_lines_are_found(spark):
    rng = np.random.default_rng(3)
    plain = lambda n: " ".join(f"w{v}" for v in rng.integers(0, 5000, n))
    apache = "Licensed under the Apache License, Version 2.0."
    gpl = ("# This program is free software: you can redistribute\n# it and/or modify\n# it under the terms of the GNU\n"
           "# General Public License as published")
    rows = [(1, f"{plain(250)} {apache} {plain(250)}"), (2, f"{plain(30)}\n{gpl}\n{plain(30)}"), (3, apache.replace(" ", "\n")), (4, plain(500)),
            (5, f"{plain(100)} has a licence {plain(100)}"), (6, "\n".join(licenses.TEMPLATES["BSD-3-Clause"]).replace(" ", "\n")), (7, "")]
    docs = spark.createDataFrame([*rows, *[(i, plain(40)) for i in range(10, 300)]], "doc_id long, text string")
    out = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert [out[i]["own_licence"] for i in range(1, 8)] == ["Apache-2.0", "GPL-3.0", "Apache-2.0", None, None, "BSD-3-Clause", None]
    assert out[1]["licence_score"] > 0.99 and out[1]["licence_share"] < 0.05 and out[3]["licence_share"] > 0.99 and out[6]["licence_share"] > 0.99


def test_fold_is_crc32_of_the_decimal_id(spark):
    from votelab.llm.common import crc_mod
    got = spark.range(50).select("id", crc_mod("id", 10).alias("m")).toPandas()
    assert [zlib.crc32(str(i).encode()) % 10 for i in got["id"]] == got["m"].tolist()
    assert isinstance(got, pd.DataFrame) and public_tokenizers.path("word_bpe_49k.json") == word_vocabulary()
