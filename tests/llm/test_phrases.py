"""Phrase mining and count transducers against plain counting."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from votelab.llm import automata as am
from votelab.llm import phrases


def plain(rows, least, max_words=5, percent=100, limit=2000):
    """The contract, phrase by phrase."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    f = {k: v for k, v in f.items() if v >= least}
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2:
            continue
        if any(g == lang and len(q) > len(p) and 100 * b >= percent * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
               for (g, q), b in f.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, i + 1, p.decode(), -a, le, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, le, r) in enumerate(sorted(x)[:limit])}


def found(df, **kw):
    return {tuple(r) for r in phrases.mine(df, **kw).collect()}


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(5)
    words = ["a", "B", "b", "of", "the", "thé", "日本", "x\x0by", "\x00", "don't", "\x85"]
    rows = [(i, None if i % 9 == 0 else ["en", "", "DE", "d\te"][i % 4], "".join(rng.choice(words) + rng.choice([" ", " ", "\t ", ". ", "\n", ",", "\r"])
             for _ in range(60))) for i in range(60)]
    rows += [(0, "en", None), (None, None, None), (7, "en", ""), (7, "en", " \t.;\n"), (8, "en", "the long tail " * 20_000), (9, None, "q" * 300_000)]
    rows += [rows[3]] * 30
    return spark.createDataFrame([(*r, "old", 1.0) for r in rows], "doc_id long, lang string, text string, phrase string, rank double")


def test_equals_plain_counting(spark, odd):
    rows = [(r["lang"], r["text"]) for r in odd.collect()]
    want = plain(rows, 4)
    assert len(want) > 100
    assert found(odd, least=4) == want
    assert found(odd, least=4, limit=3) == plain(rows, 4, limit=3)
    assert found(odd, least=6, max_words=3, percent=60) == plain(rows, 6, 3, 60)


def test_many_ranges_rounds_and_slices(spark, odd, monkeypatch):
    """Slices unite in several rounds, parts are many, tasks send their phrases on early, languages rank in shares."""
    rows = odd.repartition(5)
    want = plain([(r["lang"], r["text"]) for r in odd.collect()], 4)
    monkeypatch.setattr(phrases, "FAN", 3)
    monkeypatch.setattr(phrases, "STATES", 50)
    assert found(rows, least=4, range_bytes=1 << 17, slice_size=40) == want


def test_empty_tables_and_nothing_frequent(spark, odd):
    assert found(odd.limit(0)) == set() == found(odd.where("text is null")) == found(odd, least=10**6)
    long = odd.where("doc_id = 8")
    assert found(long, least=100) == plain([(r["lang"], r["text"]) for r in long.collect()], 100)


def test_scores_beyond_64_bits():
    """1000 * a * n alone passes 64 bits here."""
    a = 3 * 10**9
    words, langs = pa.array([b"x", b"y"]), pa.array([b"en"])
    zero = np.zeros(1, np.int64)
    pair = am.build(langs, words, [zero, zero, zero + 1], np.array([a]))
    one = am.build(langs, words, [np.zeros(2, np.int64), np.arange(2)], np.array([a + 1, a + 2]))
    n = am.build(langs, words, [zero], np.array([10**13]))
    both = am.union([one, n])
    le, r = am.compose(pair, [zero, zero], both), am.compose(pair, [zero, zero + 1], both)
    total = am.compose(pair, [zero], both)
    assert (1000 * np.array([a]).astype(object) * total // (le.astype(object) * r))[0] == 1000 * a * 10**13 // ((a + 1) * (a + 2))


def test_union_compose_and_parts_of_transducers():
    rng = np.random.default_rng(9)
    names = [b"", b"a", b"ab", b"b", "é".encode(), b"zz"]
    total, autos = Counter(), []
    for _ in range(6):
        rows = [tuple(rng.integers(0, len(names), 4)) for _ in range(40)]
        langs, la = am.sorted_labels(pa.array([names[r[0]] for r in rows], pa.binary()))
        words, wa = am.sorted_labels(pa.array([names[x] for r in rows for x in r[1:]], pa.binary()))
        w = rng.integers(1, 1 << 40, 40)
        for r, x in zip(rows, w):
            total[tuple(names[i] for i in r)] += int(x)
        autos.append(am.loads(am.build(langs, words, [la, *wa.reshape(40, 3).T], w).dumps()))
    whole = am.union(autos)

    def said(a):
        cols = am.paths(a)
        return [((a.langs[int(r[0])].as_py(), *[a.words[int(x)].as_py() for x in r[1:]]), int(w)) for *r, w in zip(*cols, a.weight[-1])]

    assert said(whole) == sorted(total.items())
    cut = dict(am.parts(whole, 5))
    assert len(cut) > 1 and said(am.union(list(cut.values()))) == said(whole)
    for p, a in cut.items():
        assert (am.prefix_range(a, am.paths(a), 5) == p).all()
        assert (am.compose(a, am.paths(a), whole) == a.weight[-1]).all()
    assert said(am.frequent(whole, 1 << 39)) == [x for x in said(whole) if x[1] >= 1 << 39]
