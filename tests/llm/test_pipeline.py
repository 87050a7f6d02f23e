"""The pipeline's stages against plain versions of what they decide."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    seen, columns = [docs], docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.common.scratch(stage(spark, seen[-1], SF), "stage")
        assert out.columns == columns
        seen.append(out)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert ids[1] < ids[0] and ids[2] <= ids[1] and ids[3] == ids[2]
    rated = [(i in ids[1]) == bool(q) for i, q in quality.items()]
    assert sum(rated) / len(rated) > 0.95
    sets = {}
    for r in seen[1].collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    for i in ids[1] - ids[2]:
        assert any(j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in ids[1])
    kept = sorted(ids[2])
    assert not any(sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for i in kept for j in kept if j < i)
    packed = corpus_pipeline.STAGES[3][1](spark, seen[3], SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen[3].where("length(text) > 0").select("doc_id").collect()}
