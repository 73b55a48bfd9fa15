"""The pipeline's stages, one after the other, against what each should have left."""

from conftest import SF

import corpus_pipeline
from quillmesh.llm import pii, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    left = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        left.append(docs)
    raw = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    field = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = sorted(raw)
    good = {i for i, s in zip(ids, field.score([raw[i] for i in ids])) if s >= 0.3}
    assert {r["doc_id"] for r in left[0].collect()} == good
    once = {r["doc_id"]: r["text"] for r in left[1].collect()}
    texts = [raw[i] for i in once]
    assert len(set(texts)) == len(texts) and {raw[i] for i in good} >= set(texts)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, raw[i].lower().split()) for i in good)}
    for i in good - set(once):  # what went has a near copy that stayed, or a chain to one
        assert any(raw[i] == raw[j] or len(shingles[i] & shingles[j]) >= 0.6 * len(shingles[i] | shingles[j]) for j in good if j != i)
    masked = {r["doc_id"]: r["text"] for r in left[2].collect()}
    assert set(masked) == set(once)
    model = pii.default_field()
    for i, (base, added) in zip(once, pii.find(list(once.values()), model)):
        assert masked[i] == pii.mask(once[i], base + added)
    assert all(d.columns == names for d in left[:3])
    assert {r["doc_id"] for r in left[3].collect()} == set(masked)
    assert set(corpus_pipeline.run(spark, SF).columns) == set(left[3].columns)
