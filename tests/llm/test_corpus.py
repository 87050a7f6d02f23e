"""Corpus operators against plain versions on small tables."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lumenlog.llm import ann, components, jaccard, quality, substring, topk


def prose(rng, n):
    return " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def family(rng, base, k):
    """Near copies with a few words changed."""
    out = []
    for _ in range(k):
        w = base.split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "".join(rng.choice("xyz") for _ in range(6))
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(0, 80)) for _ in range(30)]
    texts += family(rng, prose(rng, 60), 14) + family(rng, prose(rng, 120), 8) + [texts[5]] * 6
    texts += ["", "  \n", "one", "one two", "ONE two", "a b c", "A B\tc", None, "same word " * 40, "same word " * 41]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, (None, texts[31]), (3, texts[33]), (3, texts[33])]


def brute(rows, n, percent):
    def shingles(text):
        w = (text or "").encode().lower().split()
        return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])

    key = lambda i: math.inf if i is None else i
    nodes = [(key(i), shingles(t)) for i, t in rows]
    least = {i: i for i, _ in nodes}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, a in nodes:
        for j, b in nodes:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    back = lambda x: None if x == math.inf else x
    return sorted(((i, len(shingles(t)), back(find(key(i)))) for i, t in rows), key=repr)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_components(spark, rows, n, percent):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, size int, c int")
    assert sorted((tuple(r) for r in jaccard.components(docs, n, percent).collect()), key=repr) == brute(rows, n, percent)


def test_jaccard_of_nothing_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(empty).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "a b c d e f", 0), (4, "other words that stand alone", 0), (None, None, 0)], "doc_id long, text string, gone int")
    assert sorted((r.doc_id or 0 for r in jaccard.one_of_each(docs).collect())) == [0, 1, 4]


def test_components_of_a_path(spark):
    path = list(range(40))
    random.Random(1).shuffle(path)
    edges = spark.createDataFrame([*zip(path, path[1:], strict=False), (100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 100: 100, 101: 100}


def test_chunks_move_with_the_text():
    rng = random.Random(8)
    text = prose(rng, 400)
    of = lambda t: substring.chunks(pa.array([t]))[3].tolist()
    a, b = of(text), of("inserted words " + text[:700] + " more of them " + text[700:])
    assert len(set(a) - set(b)) <= 6 and len(a) > 30
    which, start, end, *_ = substring.chunks(pa.array(["é" * 300, "", text, None]))
    assert set(which) == {0, 2} and start[0] == 0 and end[which == 0].max() == 600


def test_repeated_passages_go_once(spark):
    rng = random.Random(9)
    passage, docs = prose(rng, 60), [prose(rng, rng.randint(80, 200)) for _ in range(12)]
    with_passage = [f"{d[:300]} {passage} {d[300:]}" for d in docs[:6]]
    rows = [*enumerate([*with_passage, *docs[6:]]), (50, None), (51, ""), (None, docs[7]), (7, docs[7])]
    got = substring.dedup(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, start int, digest string"), extra=["start"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and sum(passage in (r.text or "") for r in got) == 1 and passage in by[0][0].text
    for i in range(1, 6):
        assert by[i][0].removed_bytes > 0 and by[i][0].text.startswith(docs[i][:250]) and by[i][0].text.endswith(docs[i][-60:])
    assert all(by[i][0].text == docs[i] and by[i][0].removed_bytes == 0 for i in range(6, 12) if i != 7)
    assert [r.text for r in by[7]] == [docs[7], docs[7]] and by[50][0].text is None and by[51][0].text == ""
    assert len(by[None][0].text) < 100
    assert substring.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_passages_in_text_without_spaces(spark):
    rng = random.Random(21)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(n))
    code = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    rows = []
    for k, make in enumerate((han, code)):
        passage = make(600)
        rows += [(10 * k + i, make(200) + passage + make(200)) for i in range(4)]
        rows.append((10 * k + 5, rows[-1][1][:-1] + make(1)))  # a copy but for its end
    one_space = code(300) + " " + code(300)
    rows += [(30 + i, code(200) + one_space + code(200)) for i in range(3)]
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        whole = len(text.encode())
        gone = got[i].removed_bytes
        assert len(got[i].text.encode()) == whole - gone and "\ufffd" not in got[i].text
        assert sum(s.stop - s.start for s in got[i].removed_spans) == gone
        if i % 10 == 0:
            assert gone == 0
        elif i % 10 == 5:
            assert gone > 0.8 * whole
        else:
            assert gone >= (1500 if i < 10 else 400)


def test_repeated_short_lines(spark):
    rng = random.Random(23)
    lines = ["buy now! ", "- one more item\n", "a line of 28 bytes it is ok\n", "x"]
    assert len(lines[2]) == substring.REACH
    rows, often = [], {}
    for k, line in enumerate(lines):
        stretch = line * (400 // len(line) + 1)
        rows += [(10 * k + i, f"{prose(rng, 40)} {stretch} {prose(rng, 40)}") for i in range(5)]
        often[10 * k + 9] = f"{prose(rng, 40)} {line * 1000} {prose(rng, 40)}"
        which, start, end, *_ = substring.chunks(pa.array([often[10 * k + 9]]))
        assert (end - start).max() < 400
    got = {r.doc_id: r for r in substring.dedup(spark.createDataFrame([*rows, *often.items()], "doc_id long, text string")).collect()}
    for i, text in rows:
        if i % 10:
            assert got[i].removed_bytes >= 280 and got[i].text[:200] == text[:200] and got[i].text[-150:] == text[-150:]
        else:
            assert got[i].removed_bytes <= 400
    for i, text in often.items():
        assert len(text) - got[i].removed_bytes < 900
    alone = substring.dedup(spark.createDataFrame([(1, often[9])], "doc_id long, text string")).first()
    assert len(alone.text) < 1000 and "buy now! buy now!" in alone.text


def test_ordinal_regression_orders_grades():
    rng = np.random.default_rng(2)
    x = rng.normal(size=900)
    grades = np.digitize(x + rng.normal(scale=0.3, size=900), [-0.6, 0.7])
    rows, slots = np.repeat(np.arange(900), 2), np.tile([0, 1], 900)
    model = quality.fit(rows, slots, np.stack([x, np.ones(900)], axis=1).ravel(), grades, size=2)
    assert model.thresholds[0] < model.thresholds[1]
    tails = model.tails(model.weights[0] * x + model.weights[1])
    assert (tails[:, 0] >= tails[:, 1]).all() and ((tails > 0.5).sum(axis=1) == grades).mean() > 0.8


def test_quality_keeps_sound_documents(spark):
    rng = random.Random(6)
    poor = lambda: " ".join(w.upper() + "!!" for w in prose(rng, 40).split())
    texts = [(i, poor() if i % 3 == 0 else prose(rng, rng.randint(20, 90))) for i in range(240)]
    docs = spark.createDataFrame([*((i, t, 0.0) for i, t in texts), (None, None, 0.0), (900, "", 0.0), (900, "", 0.0)], "doc_id long, text string, p_sound double")
    labels = spark.createDataFrame([*((i, 0 if i % 3 == 0 else 1, 0) for i in range(120)), (5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.select(docs, labels).collect()}
    held = range(120, 240)
    assert sum((i in kept) == (i % 3 != 0) for i in held) >= 118
    assert quality.score(docs, quality.train(docs, labels)).count() == 243
    assert quality.select(docs, labels.limit(0)).count() in (0, 243) and quality.select(docs.limit(0), labels).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = random.Random(12)
    vocabulary = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 60))) for _ in range(400)]
    texts += [texts[3].upper(), texts[3], "", None]
    docs = spark.createDataFrame([*((i, t, 1) for i, t in enumerate(texts)), (None, texts[3], 1)], "doc_id long, text string, rank int")
    got = {}
    for r in topk.search(docs, docs.where("doc_id % 50 = 0"), k=7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id, round(r.score, 9)))
    words = [(t or "").lower().split() for t in texts]
    df = Counter(w for t in words for w in set(t))
    n, mean = len(words), sum(map(len, words)) / len(words)
    for q in range(0, len(texts), 50):
        scored = []
        for i, t in enumerate(words):
            tf = Counter(t)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in sorted(set(words[q])) if w in tf)
            if s > 0:
                scored.append((-round(s, 9), i))
        assert [(i, s) for _, i, s in sorted(got.get(q, []))] == [(i, -s) for s, i in sorted(scored)[:7]]
    assert topk.search(docs.limit(0), docs.limit(0)).count() == 0


def test_pruning_drops_nothing_in_dense_segments():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 60, 1500)
    terms = rng.zipf(1.3, sizes.sum()).clip(max=900).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    made = topk.build(np.arange(1500), terms, bounds)
    s = topk.Segment({k: made[k].astype(kind).tobytes() for k, kind in topk._FIELDS.items()})
    s.prepare(float(sizes.mean()))
    assert len(s.often) > 5
    for _ in range(20):
        ask = np.unique(terms[rng.integers(0, len(terms), 12)])
        weights = rng.random(len(ask)) * 5
        found = s.search(ask, weights, 10)
        s.weight[s.locate(ask)] = weights
        every = s.exact(np.arange(1500))
        s.weight[:] = 0
        assert [n for _, n in found] == np.lexsort((np.arange(1500), -every))[:10].tolist()


def test_many_queries_at_once_meet_only_bands_with_their_terms():
    rng = np.random.default_rng(8)
    sizes = rng.integers(30, 90, 2048)
    tongue = np.repeat(rng.integers(0, 4, 2048), sizes)
    terms = (rng.zipf(1.2, sizes.sum()).clip(max=3000) + 10_000 * tongue).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    made = topk.build(np.arange(2048), terms, bounds)
    s = topk.Segment({k: made[k].astype(kind).tobytes() for k, kind in topk._FIELDS.items()})
    s.prepare(float(sizes.mean()))
    assert sum(band.size for _, band in s.bands) < 0.6 * len(s.often) * 2048
    lists = [np.unique(terms[bounds[i] : bounds[i + 1]]) for i in range(0, 2048, 3)]
    vocabulary, place = np.unique(np.concatenate(lists), return_inverse=True)
    weights = rng.random(len(vocabulary)) * 5
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    asked = topk.alike(topk.Block(np.arange(0, 2048, 3), cuts, vocabulary, place.astype(np.int32), np.zeros(0)), weights)
    assert len(lists) > topk.BATCH and sorted(asked.ids) == list(range(0, 2048, 3))
    out = []
    s.search_block(asked, 10, np.zeros(len(asked.ids)), out)
    found = {int(asked.ids[q[0]]): s.docs[at].tolist() for q, at, _ in out}
    for i, own in zip(range(0, 2048, 3), lists, strict=True):
        s.weight[s.locate(own)] = weights[np.searchsorted(vocabulary, own)]
        every = s.exact(np.arange(2048))
        s.weight[:] = 0
        assert found[i] == s.docs[np.lexsort((s.docs, -every))[:10]].tolist()
    made = topk.build(np.arange(3), np.zeros(0, np.uint64), np.zeros(4, np.int64))
    empty = topk.Segment({k: made[k].astype(kind).tobytes() for k, kind in topk._FIELDS.items()})
    empty.prepare(1.0)
    assert empty.search(lists[0], np.ones(len(lists[0])), 10) == []


def test_nearest_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 8)) * rng.uniform(0.2, 3, (3000, 1))
    x[100:400] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(3000, None, 1), (3020, [0.0] * 8, 1), (3040, [math.nan] * 8, 1), (3060, [math.inf] + [1.0] * 7, 1), (3080, [None] + [1.0] * 7, 1), (3100, [1.0], 1), (None, [1.0] * 8, 1), rows[7]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in ann.nearest(table, per_list=64).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(3000), -score.round(10))) if i != q][:20]
        assert len(found) == 20 and [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert all(s == pytest.approx(score[i]) for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert hit / (20 * len(got)) > 0.9
    assert [i for _, i, _ in sorted(got[120])[:3]] == [i for i in np.lexsort((np.arange(3000), -(x @ x[120]).round(10))) if i != 120][:3]
    assert ann.nearest(table.limit(0)).count() == 0
    assert ann.nearest(spark.createDataFrame(rows[:5], table.schema)).count() == 4


def test_nearest_ties_of_many_different_vectors(spark):
    rng = np.random.default_rng(5)
    x = np.unique(rng.choice([-1.0, 1.0], size=(900, 12)), axis=0)
    rng.shuffle(x)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, per_list=4096).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, len(x), 20))
    for i, found in got.items():
        score = x @ x[i]
        assert [n for _, n, _ in sorted(found)] == [n for n in np.lexsort((np.arange(len(x)), -score)) if n != i][:20]


def test_a_query_of_frequent_words_only():
    made = topk.build(np.arange(300), np.tile(np.array([5, 9], np.uint64), 300), np.arange(0, 601, 2))
    s = topk.Segment({k: made[k].astype(kind).tobytes() for k, kind in topk._FIELDS.items()})
    s.prepare(2.0)
    assert [n for _, n in s.search(np.array([5], np.uint64), np.array([1.0]), 3)] == [0, 1, 2]


def test_unique_text_stays_beside_repeats_under_one_id(spark):
    rng = random.Random(31)
    passage, alone = prose(rng, 60), [prose(rng, 150) for _ in range(3)]
    rows = [(1, f"{prose(rng, 50)} {passage}"), (2, passage), (2, alone[0]), (None, f"{passage} {prose(rng, 9)}"), (None, alone[1]), (3, alone[2]), (3, alone[2]), (4, f"{alone[2]} {prose(rng, 40)}"), (5, "x" * 3_000_000 + prose(rng, 200_000))]
    got = substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = [(r.doc_id, r.text) for r in got]
    assert sorted(texts, key=repr) != sorted(rows, key=repr) and len(got) == len(rows)
    for row in [rows[0], rows[2], rows[4], rows[5]]:
        assert row in texts
    assert texts.count(rows[5]) == 2
    short = {r.doc_id: r.removed_bytes for r in got if r.text not in {alone[0], alone[1], alone[2]}}
    assert short[2] > 300 and short[None] > 250 and short[4] > len(alone[2]) - 2 * 57 and short[1] == 0


def test_nearest_in_lists_that_are_cut_again(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 4000)] * 2 + rng.normal(size=(4000, 8))
    x[500:900] = x[500]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, sample=256, per_list=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        score = x @ x[q]
        best = [i for i in np.lexsort((np.arange(4000), -score.round(10))) if i != q][:20]
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21)) and all(s == pytest.approx(score[i]) for _, i, s in found)
        hit += len(set(best) & {i for _, i, _ in found})
    assert len(got) == 200 and hit / (20 * len(got)) > 0.9


def test_nearest_finds_k_whether_lists_outgrow_the_sample_or_not(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(3000, 6))
    x[900:1100] = x[900]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for sample in (256, 3000):
        got = {}
        for r in ann.nearest(table, k=400, query_every=100, sample=sample, per_list=16).collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert {q: (len(found), len(set(found)), q in found) for q, found in got.items()} == {q: (400, 400, False) for q in range(0, 3000, 100)}


def test_nearest_looks_into_lists_without_rows(spark):
    x = np.random.default_rng(3).normal(size=(90, 4))
    posted = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "list long, vec_id long, v array<double>")
    asked = spark.createDataFrame([(n, i, x[i].tolist()) for i in range(0, 90, 20) for n in (0, 1)], "list long, query_id long, q array<double>")
    held, probed = ann._parts(posted, asked, lambda v: np.concatenate([v, np.zeros((len(v), 1))], axis=1), 10, 2, 40)
    rows = {r["list"]: r["count"] for r in held.groupBy("list").count().collect()}
    assert sum(rows.values()) == 90 and len(rows) > 4 and {n >> 20 for n in rows} == {0}
    met = {}
    for r in probed.collect():
        met[r.query_id] = met.get(r.query_id, 0) + rows[r["list"]]
    assert set(met) == set(range(0, 90, 20)) and min(met.values()) >= 40
