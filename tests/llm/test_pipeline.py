"""The pipeline's stages, in order, on the smallest tables."""

from __future__ import annotations

import corpus_pipeline
from tidalgrid.llm import decontaminate, jaccard, lines, toxicity


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], sf)
        out.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/stage{len(steps)}")
        steps.append(spark.read.parquet(path))
    assert [len(n) > 0 for n, _ in corpus_pipeline.STAGES] == [True] * 5
    assert all(s.columns == columns for s in steps[:-1])
    counts = [s.count() for s in steps]
    assert counts[0] >= counts[1] > 0 and counts[2] == counts[1] and counts[2] >= counts[3] >= counts[4] == counts[5]

    model, cuts = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    low = {r.doc_id for r in toxicity.score(docs, model).collect() if r.score < cuts.get(r.lang, cuts[None])}
    assert {r.doc_id for r in steps[1].collect()} == low
    assert {(r.doc_id, r.text, r.n_chars) for r in steps[2].collect()} == {(r.doc_id, r.text, len(r.text)) for r in lines.dedup_lines(steps[1]).collect()}
    texts = [(r.doc_id, r.text) for r in steps[2].collect()]
    assert {r.doc_id for r in steps[3].collect()} == {i for i, c, _ in jaccard.brute_force(texts) if i == c}
    texts = [(r.doc_id, r.text) for r in steps[3].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in steps[4].collect()} == {x[0] for x in decontaminate.brute_force(texts, items) if not x[5]}
    assert all(r.decoded == r.text for r in steps[5].collect())
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in steps[5].collect()}
