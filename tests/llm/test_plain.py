"""Passage removal, the quality score and the whole pipeline against plain versions that look at all rows in one process."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from lumenlog.llm import quality, substring
from lumenlog.llm.textbytes import LOWER, mixed, span_hashes, text_bytes

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def plain_dedup(rows, min_bytes=64):
    """rows: (id, text). Chunks are compared by their bytes; what a row loses, as (text, removed bytes)."""
    place = {}
    pieces = []
    hashes = substring_keys([t for _, t in rows])
    for (i, text), key in zip(rows, hashes, strict=True):
        raw = (text or "").encode()
        _, starts, ends, *_ = substring.chunks(pa.array([text or ""]))
        mine = [(int(a), int(b), raw[a:b]) for a, b in zip(starts, ends, strict=True)]
        pieces.append(mine)
        for a, _, chunk in mine:
            at = (i is None, i or 0, key, a)
            place[chunk] = min(place.get(chunk, at), at)
    out = []
    for (i, text), key, mine in zip(rows, hashes, pieces, strict=True):
        raw = (text or "").encode()
        spans = [(a, b) for a, b, chunk in mine if place[chunk] != (i is None, i or 0, key, a)]
        new = substring.without(raw, substring.trimmed(raw, substring.runs(spans, min_bytes)))
        out.append((i, text if text is None else new.decode(errors="ignore"), len(raw) - len(new)))
    return sorted(out, key=repr)


def substring_keys(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame([(n, t or "") for n, t in enumerate(texts)], "n long, t string").select("n", F.xxhash64("t").alias("k")).collect()
    return [r.k for r in sorted(rows, key=lambda r: r.n)]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_dedup_equals_a_plain_version(spark):
    rng = random.Random(2)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    texts = [t for _, t in rows]
    rows += [(None, None), (None, texts[5]), (3, texts[9][:400] + texts[20][:300]), (3, texts[9]), (rows[7][0], texts[7]), (700, ""), (701, " ".join(rng.choices(texts, k=3)))]
    got = substring.dedup(spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, spans int")).collect()
    wanted = plain_dedup(rows)
    assert sorted(((r.doc_id, r.text, r.removed_bytes) for r in got), key=repr) == wanted
    assert sum(n > 0 for *_, n in wanted) > 10


def plain_score(model, text):
    """The score of one text by loops over its words."""
    hashed = lambda b: int(span_hashes(*(lambda body: (body, np.array([0]), np.array([len(b)])))(text_bytes(pa.array([b], type=pa.binary()))[0]))[0][0])
    mask, words = (1 << quality.BITS) - 1, (text or "").encode().split()
    total, forms = 0.0, set()
    for w in words:
        form = hashed(bytes(LOWER[np.frombuffer(w, np.uint8)]))
        shape = [int(x) for x in quality.OUTLINE[np.frombuffer(w, np.uint8)]]
        outline = shape[0]
        for k in (1, 2, 3):
            outline = outline << 8 | (shape[-k] if len(w) >= k else 0)
        outline = int(mixed(np.array([outline ^ min(len(w), 20) << 40], dtype=np.uint64))[0])
        total += model.weights[form & mask] + model.weights[outline & mask]
        forms.add(form)
    n = len(words)
    return total / max(n, 1) + model.weights[quality._LENGTH + min(int(math.log2(n + 1)), 31)] + model.weights[quality._FRESH + 10 * len(forms) // max(n, 1)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_scores_equal_a_plain_version(spark):
    docs = documents(spark).limit(40).union(documents(spark).limit(1).selectExpr("doc_id", "cast(null as string)", "lang", "source", "n_chars")).cache()
    model = quality.train(documents(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    got = sorted((r.expected_grade, r.p_sound) for r in quality.score(docs, model).collect())
    wanted = []
    for r in docs.collect():
        tails = [1 / (1 + math.exp(t - plain_score(model, r.text))) for t in model.thresholds]
        wanted.append((sum(tails), tails[0]))
    for a, b in zip(got, sorted(wanted), strict=True):
        assert a == pytest.approx(b, abs=1e-9)
    docs.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_equals_plain_stages(spark):
    model = quality.train(documents(spark), spark.read.parquet(f"{SF}/labels.parquet"))
    rows = sorted((r.doc_id, r.text) for r in documents(spark).collect())
    rows = [(i, t) for i, t in rows if 1 / (1 + math.exp(model.thresholds[0] - plain_score(model, t))) >= 0.5]
    sets = {}
    for i, t in rows:
        w = [bytes(LOWER[np.frombuffer(x, np.uint8)]) for x in (t or "").encode().split()]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i, _ in rows}
    moved = True
    while moved:
        moved = False
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and least[i] < least[j] and 100 * len(a & b) >= 80 * len(a | b):
                    least[j], moved = least[i], True
    rows = plain_dedup([(i, t) for i, t in rows if least[i] == i])
    packed = corpus_pipeline.run(spark, SF).collect()
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in ends.values():
        assert [a for a, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    from lumenlog.llm.queries import tokenizer_path
    from lumenlog.llm.tokens import library_coder

    coder = library_coder(tokenizer_path())
    wanted = {i: len(coder.encode(t)) + 1 for i, t, _ in rows if t}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == wanted
