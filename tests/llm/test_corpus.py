"""Near duplicates, substrings, decontamination, language-model scores, chats and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from votelab.llm import chat, decontam, loglinear, neardup, substrings
from votelab.llm.components import components
from votelab.session import ensure_checkpoint_dir

MID = "/root/testdata/sf0.01"


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_links(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    where, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    for ids in where.values():
        common.update((a, b) for n, a in enumerate(ids) for b in ids[n + 1:])
    return sets, [p for p, c in common.items() if 100 * c >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - c)]


def vocabulary(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_components_of_hubs_chains_and_loops(spark):
    rng = random.Random(2)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(1000, 1080)] + [(5, 5), (2000, 2000)]
    edges += [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(150)] + [(None, 4), (7, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    assert got == roots({n for e in real for n in e}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(spark, k, percent):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    sets, links = brute_links(texts, k, percent)
    want = roots(texts, links)
    got = neardup.link(docs, k=k, percent=percent).collect()
    assert len(got) == len(texts) and links
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


@pytest.mark.parametrize("block", [1000, 7])
def test_near_duplicates_of_a_large_group_and_odd_rows(spark, monkeypatch, block):
    """A drifting group: neighbours are linked though most aren't linked with the smallest document. Its buckets are
    searched whole and in small blocks."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(4)
    vocab = vocabulary(400, 1)
    base = [rng.choice(vocab) for _ in range(120)]
    texts, text = {}, list(base)
    for i in range(150):
        if i % 3 == 0:
            text[rng.randrange(120)] = rng.choice(vocab)
        texts[100 + i] = " ".join(text)
    texts |= {1: None, 2: "", 3: " \n", 4: "one", 5: "one", 6: "one two", 7: "One two", 8: "two one", 9: "long " * 30_000}
    rows = [*texts.items(), (4, "one"), (300, "one two three four"), (300, "one"), (None, "one")]
    got = neardup.link(spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))).collect()
    assert len(got) == len(rows)
    sets, links = brute_links(texts, 3, 85)
    want = roots({*texts, 300}, [*links, (4, 300)])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]], r
    assert len({want[100 + i] for i in range(150)}) < 20
    assert neardup.link(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def planted(seed=8):
    """Documents of private words; 60-word passages shared whole, with edits, and with an insertion."""
    rng = random.Random(seed)
    own = lambda i, n: [f"w{i}x{rng.randrange(5000)}" for _ in range(n)]
    p = [f"p{i}" for i in range(60)]
    fuzzy = [("edit" if i in (20, 41) else x) for i, x in enumerate(p)]
    longer = p[:30] + ["new", "words"] + p[30:]
    texts = {10: own(1, 80) + p + own(1, 40), 11: own(2, 33) + p + own(2, 70), 12: fuzzy + own(3, 90), 13: own(4, 50) + longer,
             14: own(5, 100), 15: own(6, 40) + p[:25] + own(6, 40), 16: p}
    return {i: " ".join(w) for i, w in texts.items()}, p


def test_planted_passages_are_found_and_cut(spark):
    texts, p = planted()
    rows = [*texts.items(), (1, None), (2, ""), (3, "a few words"), (None, " ".join(p)), (17, "junk " * 4000),
                               (18, "start " + "junk " * 120 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source_id", F.lit("x"))
    got = substrings.passages(docs)
    by = {r["doc_id"]: r for r in got.collect()}
    assert set(by) == {11, 12, 13, 16, 18} and all(by[i]["source_id"] == 10 for i in (11, 12, 13, 16))
    assert (by[18]["source_id"], by[18]["start_word"], by[18]["end_word"]) == (17, 1, 121)
    for i in (11, 16):
        assert words_of(texts[i][by[i]["start_char"]: by[i]["end_char"]]) == p and by[i]["n_match"] == 60
    assert by[12]["n_words"] == 60 and by[12]["n_match"] == 58 and by[13]["n_words"] == 62 and by[13]["n_match"] == 60
    left = {r["doc_id"]: r["text"] for r in substrings.cut(docs, got).collect() if r["doc_id"]}
    assert 16 not in left and not {*p} & {*words_of(left[11])} and all(left[i] == texts[i] for i in (10, 14, 15))
    assert left[1] is None and left[2] == "" and len(words_of(left[11])) == 103
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.passages(empty).count() == 0 and substrings.cut(empty, substrings.passages(empty)).count() == 0


def test_other_texts_of_an_id_are_not_cut(spark):
    texts, p = planted()
    rows = [*texts.items(), (11, "zz other words " * 60), (16, "zz a text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("marked", F.lit("x")).withColumn("row", F.lit(1))
    left = [(r["doc_id"], r["text"]) for r in substrings.cut(docs, substrings.passages(docs)).collect()]
    assert (11, "zz other words " * 60) in left and (16, "zz a text of its own") in left
    assert not [t for i, t in left if i in (11, 16) and {*p} & {*words_of(t)}]


def test_repeated_windows_are_covered(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    words = {r["doc_id"]: words_of(r["text"]) for r in docs.select("doc_id", "text").collect()}
    where = defaultdict(list)
    for i, w in words.items():
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].append((i, j))
    need = defaultdict(set)
    for places in where.values():
        for i, j in places:
            if i != min(places)[0]:
                need[i].update(range(j, j + 50))
    covered = defaultdict(set)
    for r in substrings.passages(docs).collect():
        assert r["n_words"] >= 50 and 100 * r["n_match"] >= 80 * r["n_words"] and r["source_id"] < r["doc_id"]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    total = sum(map(len, need.values()))
    assert total > 10_000 and sum(len(s - covered[i]) for i, s in need.items()) < 0.005 * total
    assert set(need) <= set(covered)


def uncovered(docs, got):
    """Words of 50-word windows that a smaller document holds too, and no passage covers; all such words."""
    words, where, need, covered = {i: words_of(t) for i, t in docs.items()}, defaultdict(list), defaultdict(set), defaultdict(set)
    for i, w in words.items():
        for j in range(len(w) - 49):
            where[tuple(w[j:j + 50])].append((i, j))
    for places in where.values():
        for i, j in places:
            if i != min(places)[0]:
                need[i].update(range(j, j + 50))
    for r in got:
        assert r["n_words"] >= 50 and 100 * r["n_match"] >= 80 * r["n_words"] and r["source_id"] < r["doc_id"]
        covered[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return sum(len(s - covered[i]) for i, s in need.items()), sum(map(len, need.values()))


def test_repeats_whose_parts_stand_in_smaller_documents_are_found(spark):
    rng = random.Random(12)
    texts = {}
    for case in range(20):
        own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
        s1, s2 = own(45), own(45)
        texts |= {10 * case + i: " ".join(own(20) + x + own(20)) for i, x in enumerate((s1, s2, s1 + s2, s1 + s2), 1)}
    got = substrings.passages(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} >= {(10 * c + 4, 10 * c + 3) for c in range(20)}
    assert uncovered(texts, got) == (0, 1800)


def test_repeats_in_another_order_in_the_source_are_found(spark):
    rng = random.Random(13)
    texts = {}
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    for case in range(20):
        h1, h2, phrase = own(30), own(30), own(12)
        texts[10 * case + 1] = " ".join(h2 + own(50) + h1 + own(50) + h1 + h2 + own(9))
        texts[10 * case + 2] = " ".join(own(15) + h1 + h2 + own(15))
        tail = phrase + own(10) + phrase + own(10) + phrase
        texts[10 * case + 3], texts[10 * case + 4] = " ".join(phrase + own(60) + tail), " ".join(own(30) + tail)
    texts |= {500: "junk " * 53, 501: "other " + "junk " * 400}
    got = substrings.passages(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert uncovered(texts, got) == (0, 20 * (60 + 56) + 400)
    assert sum(r["doc_id"] == 501 for r in got) < 100


def edited(words, places):
    return [f"edit{i}" if i in places else w for i, w in enumerate(words)]


def test_inexact_repeats_whose_parts_stand_in_smaller_documents_are_found(spark):
    """No 50 words in a row are equal, and the smallest documents with the seeds hold halves only."""
    rng = random.Random(14)
    texts, own = {}, lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    for case in range(20):
        s1, s2 = own(40), own(40)
        for i, x in enumerate((s1, s2, s1 + s2, edited(s1 + s2, (20, 60)), s1 + s2[:5]), 1):
            texts[10 * case + i] = " ".join(own(20) + x + own(20))
        texts[10 * case + 6] = texts[10 * case + 3]        # a copy of the source adds no row
    got = substrings.passages(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    found = [(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["n_match"]) for r in got if r["doc_id"] % 10 == 4]
    assert sorted(found) == [(10 * c + 4, 10 * c + 3, 20, 100, 78) for c in range(20)]
    assert not [r for r in got if r["doc_id"] % 10 in (1, 2, 3, 5)]


def test_inexact_repeats_in_another_order_in_the_source_are_found(spark):
    rng = random.Random(15)
    texts, own = {}, lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    for case in range(20):
        h1, h2 = own(40), own(40)
        texts[10 * case + 1] = " ".join(h2 + own(50) + h1 + own(50) + h1 + h2 + own(9))
        texts[10 * case + 2] = " ".join(own(15) + edited(h1 + h2, (20, 60)) + own(15))
    texts |= {500: "start " + "junk " * 30 + " ".join(own(200)), 501: "other " + "junk " * 40 + " ".join(own(90))}
    got = substrings.passages(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["n_match"]) for r in got) == [(10 * c + 2, 15, 95, 78) for c in range(20)]


def test_phrases_of_many_documents_meet_where_a_passage_is_possible(spark, monkeypatch):
    """40 documents share 24 words and nothing else; two hold the words in a longer passage that is edited too often for
    seeds, two in one whose halves stand in smaller documents. Only those meet, and they are found."""
    rng, met, aligned = random.Random(16), {}, substrings._aligned
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    phrase, tail, s1, s2 = own(24), own(40), own(40), own(40)
    texts = {i: own(60) + phrase + own(60) for i in range(1, 41)}
    texts |= {50: own(20) + phrase + tail + own(20), 51: own(20) + phrase + edited(tail, range(4, 36, 5)) + own(20)}
    texts |= {60: own(20) + s1 + own(20), 61: own(20) + s2 + own(20), 62: own(20) + s1 + phrase + s2 + own(20),
              63: own(20) + edited(s1 + phrase + s2, (20, 84)) + own(20)}

    def noting(found, one, k, min_words, percent, name):
        met[name] = {tuple(r) for r in found.select("id", "source").distinct().collect()}
        return aligned(found, one, k, min_words, percent, name)

    monkeypatch.setattr(substrings, "_aligned", noting)
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    got = {(r["doc_id"], r["source_id"], r["start_word"], r["end_word"], r["n_match"]) for r in substrings.passages(docs).collect()}
    assert {(51, 50, 20, 84, 57), (63, 62, 20, 124, 102)} <= got
    assert (51, 50) in met["rest"] and len(met["rest"]) < 40


def test_places_that_meet_are_listed_not_multiplied(spark, monkeypatch):
    """Two documents hold a paragraph 30 times each: a row a pair of seeds goes through the shuffle, not one a pair of places."""
    rng, met, aligned = random.Random(17), [], substrings._aligned
    own = lambda n: [f"o{rng.randrange(10**9)}" for _ in range(n)]
    s1, s2 = own(40), own(40)
    texts = {1: own(20) + s1 + own(20), 2: own(20) + s2 + own(20)}
    texts[3] = sum((own(12) + s1 + s2 for _ in range(30)), [])
    texts[4] = sum((own(12) + edited(s1 + s2, (20, 60)) for _ in range(30)), [])

    def noting(found, one, k, min_words, percent, name):
        met.append(found.count())
        return aligned(found, one, k, min_words, percent, name)

    monkeypatch.setattr(substrings, "_aligned", noting)
    got = substrings.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(4, 3)} and len({r["start_word"] for r in got}) == 30
    assert met[1] < 200


def test_crossed_places_come_once_and_pairs_stay_whole(monkeypatch):
    lists = [[1, 7], [30], [4, 9, 11], [35]], [[1, 7], [40], [4, 9, 11], [50]], [[2], [3], [5], [6]]
    cols = [pa.array(x) for x in ([8, 8, 9], [1, 1, 1], *zip(*lists), [70, 70, 90])]
    cols[2:6] = [pa.array(x, pa.list_(pa.int32())) for x in zip(*[(a, b, c, d) for a, b, c, d in lists])]
    b = pa.RecordBatch.from_arrays(cols, [*substrings.MET, "pair"])
    want = {(8, 1, p, q) for p, q in [(1, 4), (1, 9), (1, 11), (7, 4), (7, 9), (7, 11), (30, 35), (40, 50)]} | {(9, 1, 2, 5), (9, 1, 3, 6)}
    monkeypatch.setattr(substrings, "ANCHORS", 1)
    parts = [[*zip(*(c.tolist() for c in x[:4]))] for x in substrings._crossed_in_turn(b, 5)]
    assert [{r[0] for r in x} for x in parts] == [{8}, {9}] and sorted(sum(parts, [])) == sorted(want)


def test_winnowing_and_matches_of_many_equal_those_of_one():
    rng = np.random.default_rng(9)
    for _ in range(300):
        off = np.append(0, np.cumsum(rng.integers(0, rng.choice([4, 30]), 6)))
        h, window = rng.integers(0, 9, off[-1]).astype(np.uint64), int(rng.choice([1, 3, 10]))
        one = [off[i] + substrings._winnow(h[off[i]: off[i + 1]], window) for i in range(6)]
        assert substrings._winnowed(h, off, window).tolist() == np.concatenate(one).tolist()
        a, b = (rng.integers(0, 4, n).astype(np.uint64) for n in rng.integers(0, 25, 2))
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            new = [0]
            for j, y in enumerate(b.tolist()):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert substrings._matched(a, b) == row[-1]


def tables_left(spark, name):
    """Tables of an operator in the shared checkpoint folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return sorted(re.sub("-[0-9a-f]{12}$", "", x.getPath().getName()) for x in there if x.getPath().getName().startswith(name))


def test_tables_go_once_nothing_reads_them(spark, monkeypatch):
    """What stays on disk is what the result reads: no seeds, windows, sets, signatures or pairs."""
    texts, _ = planted()
    docs = spark.createDataFrame([*texts.items(), (10, "zz another text")], "doc_id long, text string")
    before = Counter(tables_left(spark, "substrings-")), Counter(tables_left(spark, "neardup-"))
    got, linked = substrings.passages(docs), neardup.link(docs)
    assert Counter(tables_left(spark, "substrings-")) - before[0] == {"substrings-first": 1, "substrings-rest": 1}
    assert set(Counter(tables_left(spark, "neardup-")) - before[1]) <= {"neardup-classes", "neardup-classed", "neardup-components", "neardup-final"}
    rows = sorted(got.collect())
    assert {r["doc_id"] for r in rows} == {11, 12, 13, 16} and linked.count() == len(texts) + 1
    monkeypatch.setattr(substrings, "PAIRS", 2)          # in several turns
    assert sorted(substrings.passages(docs).collect()) == rows


def test_no_repeated_window_is_missed(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    missed, total = uncovered({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}, substrings.passages(docs).collect())
    assert total > 10_000 and missed == 0


def test_chains_equal_quadratic_chaining():
    rng = random.Random(5)
    for _ in range(60):
        runs = sorted((rng.randrange(150), rng.randrange(150), rng.randrange(5, 15)) for _ in range(rng.randrange(1, 25)))
        s, t, n = (list(x) for x in zip(*runs))
        score = []
        for j in range(len(runs)):
            gaps = [(s[j] - s[i] - n[i], t[j] - t[i] - n[i], score[i]) for i in range(j)]
            # the best of the predecessors within reach
            ok = [v - substrings.GAP_COST * (a + b) for a, b, v in gaps if 0 <= a <= substrings.MAX_GAP and 0 <= b <= substrings.MAX_GAP]
            score.append(n[j] + max(0, max(ok, default=0)))
        paths = substrings.chain(s, t, n)
        assert sorted(i for p in paths for i in p) == list(range(len(runs)))
        p = paths[0]
        got = sum(n[i] for i in p) - sum(substrings.GAP_COST * (s[b] - s[a] - n[a] + t[b] - t[a] - n[a]) for a, b in zip(p, p[1:]))
        assert got == pytest.approx(max(score))


def test_far_runs_hide_no_near_ones(spark):
    """Pairs that share a long run, then have own words, then share a passage with two words inserted."""
    rng = random.Random(8)
    vocab = vocabulary(30_000, 4)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = []
    for i in range(20):
        far, first, second = text(500), text(30), text(30)
        rows += [(2 * i, " ".join(far + text(200) + first + second)), (2 * i + 1, " ".join(far + text(200) + first + text(2) + second))]
    got = substrings.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got if r["start_word"] >= 650} == {(2 * i + 1, 2 * i) for i in range(20)}
    assert {(r["doc_id"], r["source_id"]) for r in got if r["end_word"] <= 600} == {(2 * i + 1, 2 * i) for i in range(20)}


def test_items_of_repeated_words_are_found(spark):
    """Items of few distinct shingles: a document holds each of them once, or a share of them."""
    one = [(i, " ".join([f"w{i}"] * 34)) for i in range(300)]
    cycle = [(300 + i, " ".join([f"c{i}x{j}" for j in range(10)] * 6)) for i in range(50)]
    docs = ([(i, f"some words before {' '.join([f'w{i}'] * 5)} and behind") for i in range(300)]
            + [(300 + i, " ".join(f"c{i}x{j % 10}" for j in range(12 if i % 2 else 11))) for i in range(50)])
    got = decontam.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(one + cycle, "item_id long, text string"))
    # of a cycle's ten shingles twelve words hold eight, eleven hold seven
    want = {(i, i) for i in range(300)} | {(300 + i, 300 + i) for i in range(1, 50, 2)}
    assert {(r["doc_id"], x["item_id"]) for r in got.collect() for x in r["leaks"]} == want


def test_contained_items_match_brute_force(spark):
    rng = random.Random(6)
    vocab = vocabulary(3000, 2)
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: text(n) for i, n in enumerate([5, 6, 9, 14, 20, 33, 47, 64, 65, 100, 150, 260])}
    docs = {i: text(rng.choice([0, 3, 30, 400, 3000])) for i in range(60)}
    for d in range(40):
        i = d % len(items)
        piece = list(items[i])
        if d % 3 == 1 and len(piece) > 40:
            piece[len(piece) // 2] = "edited"
        at = rng.randrange(len(docs[d]) + 1) if d % 5 else len(docs[d])
        docs[d] = docs[d][:at] + piece + docs[d][at:]
    rows = [(i, " ".join(w)) for i, w in docs.items()] + [(100, None), (101, ""), (0, " ".join(docs[0]))]
    asked = [(i, " ".join(w)) for i, w in items.items()] + [(50, None), (51, "too short"), (3, " ".join(items[3]))]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("LEAKS", F.lit("old"))
    q = spark.createDataFrame(asked, "item_id long, text string")
    want = Counter()
    for i, t in rows:
        own = shingles(t, 5) if len(words_of(t)) >= 5 else set()
        for j, x in asked:
            s = shingles(x, 5) if len(words_of(x)) >= 5 else set()
            if s and 100 * len(s & own) >= 80 * len(s):
                want[i, j, len(s), len(s & own)] += 1
    for block in (decontam.BLOCK_ITEMS, 4):          # in one block and in several
        decontam.BLOCK_ITEMS, before = block, decontam.BLOCK_ITEMS
        try:
            got = decontam.contained(d, q, item_text="text").collect()
        finally:
            decontam.BLOCK_ITEMS = before
        assert len(got) == len(rows)
        assert Counter((r["doc_id"], *x) for r in got for x in r["leaks"]) == want and want
    none = decontam.contained(d, q.limit(0), item_text="text").collect()
    assert all(r["leaks"] == [] for r in none) and decontam.contained(d.limit(0), q, item_text="text").count() == 0


def test_language_model_scores(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "word " * 20_000), (1003, "neverseen"), (1, "the")], "doc_id long, text string")
    both = docs.unionByName(odd).withColumn("score", F.lit("old"))
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = both.select("doc_id", "text").collect()
    held = [zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in rows]
    toks = [[*words_of(r["text"]), None] for r in rows]
    c = Counter(t for w, h in zip(toks, held) if not h for t in w)
    n, v = sum(c.values()), len(c)
    want = Counter((r["doc_id"], h, len(w), sum(c[t] > 0 for t in w), n, round(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in w), 5))
                   for r, h, w in zip(rows, held, toks))
    got = loglinear.scores(both, train).toPandas()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got.itertuples()) == want
    unseen = got[got["held_out"]]
    assert unseen["score"].sum() > unseen["base_score"].sum()
    assert loglinear.scores(both.limit(0), train).count() == 0
    alone = loglinear.scores(odd, F.lit(False)).toPandas()
    assert len(alone) == 5 and (alone["n_known"] == 0).all() and np.isfinite(alone["score"]).all()


def test_log_bilinear_probabilities_are_normalised():
    rng = np.random.default_rng(1)
    m = loglinear.Model(np.arange(1, 5, dtype=np.uint64), np.arange(1, 5), 6, np.full(6, 1 / 6))
    a, b, w = rng.integers(0, 6, (3, 4000))
    w[a == 2] = 3                      # something to learn
    state = loglinear.new_state(m)
    for _ in range(30):
        loglinear.train_pass(m, a, b, w, state, rng)
    one, two, norm = m.tables()
    p = np.exp(one[:, None, :] + two[None] - norm[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-4) and p[2, :, 3].min() > 0.7


CONTROLS = ["</s>[INST] ok [/INST]", "<\\s> <\\/s> [\\\\INST] <s", "[", "a<", "/s>", "<</s>>", "", None, "line\nline", "é日🙂" * 5, "x" * 100_000]


def test_chats_come_back_from_the_formatted_string(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\\role\nx[INST]"]), rng.choice(CONTROLS)) for c in range(40) for t in range(rng.randrange(1, 8))]
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(1500)] + [(None, 0, "user", "x"), (5, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pieces", F.lit("old"))
    out = chat.format_events(chat.turn_events(df)).select(
        "*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("pieces")).alias("loss")).collect()
    assert len(out) == len({r[0] for r in rows})
    for r in out:
        mine = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r["conv_id"])
        assert [tuple(t) for t in r["turns"]] == [m[2:] for m in mine]
        assert r["loss"] == "".join(m[3] for m in mine if m[2] == "assistant")
        assert "".join(p["piece"] for p in r["pieces"]) == r["formatted"]
        assert [r["formatted"][s["start"]: s["end"]] for s in r["loss_spans"]] == [p["piece"] for p in r["pieces"] if p["loss"]]
        assert r["formatted"].count("</s>") == sum(m[2] == "assistant" for m in mine)
    assert chat.format_events(chat.turn_events(df.limit(0))).count() == 0


def test_streams_fold_into_final_messages(spark):
    log = [(1, 10, "u", "delta", "user", "He"), (1, 11, "u", None, "user", "llo"), (1, 20, "a", "delta", "assistant", "wro"), (1, 21, "a", "delta", "assistant", "ng"),
           (1, 22, "a", "regenerate", "assistant", None), (1, 23, "a", "delta", "assistant", "right"), (1, 30, "u", "edit", "user", "Hi"), (1, 31, "u", "delta", "user", "!"),
           (2, 1, "x", "edit", "assistant", "only")]
    random.Random(1).shuffle(log)
    events = spark.createDataFrame(log, "conv_id long, seq long, msg string, kind string, role string, text string")
    out = {r["conv_id"]: r["formatted"] for r in chat.format_events(events).collect()}
    assert out == {1: "<s>[INST]user\nHi![/INST]right</s>", 2: "<s>only</s>"}


def test_pipeline_keeps_clean_documents_and_drops_planted_ones(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = base.orderBy(F.length("text").desc()).first()["text"]
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").first()["text"]
    passages, p = planted()
    more = [(9000, text, "en", "s", 1), (9001, text + " end", "en", "s", 1), (9002, None, "en", "s", 1), (9003, "Съешь же ещё этих мягких булок " * 30, "ru?", None, 1),
            (9004, f"{text[:900]}\n{item}", "en", "s", 1), (9004, f"{text[:900]}\n{item}", "en", "s", 1), (9005, "12 34", None, "s", 1)]
    docs = base.unionByName(spark.createDataFrame(more, base.schema)).withColumn("ids", F.lit("old"))
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 9003, None).otherwise(F.col("lang")))
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, "/root/testdata/sf0.001")
        if name != "bpe":
            assert out.columns == docs.columns
        out.cache()
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        before = {r["doc_id"] for r in seen.select("doc_id").collect()}
        assert ids <= before
        if name == "language-id":
            assert before - ids == {9002, 9003, 9005}
        if name == "near-dedup":
            assert not ids & {9000, 9001} and out.count() == len(ids)
            sets, links = brute_links({r["doc_id"]: r["text"] for r in seen.dropDuplicates(["doc_id"]).collect()}, 5, 80)
            top = roots(sets, links)
            assert ids == {i for i in sets if top[i] == i}
        if name == "decontamination":
            assert 9004 not in ids
        seen = out
    r = seen.where("size(ids) > 0").first()
    assert r["n_tokens"] == len(r["ids"]) and len(r["decoded_sha256"]) == 64
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "/root/testdata/sf0.001")
    assert empty.count() == 0


def test_pipeline_keeps_different_texts_of_one_id(spark):
    texts, p = planted()
    own = lambda n: " ".join(f"zz{n}{i}" for i in range(60))
    rows = [*texts.items(), (10, own("a")), (10, own("b")), (10, own("b")), (11, own("c")), (None, own("d")), (50, own("c") + " end")]
    docs = spark.createDataFrame([(i, t, "en", None, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect())
    assert [t for i, t in got if i == 10] == sorted([texts[10], own("a"), own("b")])
    # the text of id 11 and that of id 50 are near copies; ids of their own stand before further texts of an id
    assert (11, own("c")) not in got and (50, own("c") + " end") in got and (-1, own("d")) in got
    cut = sorted((r["doc_id"] or -1, r["text"], r["n_chars"]) for r in corpus_pipeline.unrepeated(spark, kept, "").collect())
    assert [t for i, t, _ in cut if i == 10] == sorted([texts[10], own("a"), own("b")])
    assert not [t for i, t, _ in cut if i in (11, 16) and {*p} & {*words_of(t)}]


def test_chat_query_digests(spark):
    from votelab.llm.queries import QUERIES
    got = {r["conv_id"]: r for r in QUERIES["op5_chat"](spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and got[-1]["n_turns"] == 2
    assert got[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
