"""The pipeline's stages against brute-force versions, and its contract."""

import corpus_pipeline
from tests.llm.test_operators import brute_groups, brute_overlap, table


def test_pipeline(spark):
    from quire.llm import repetition

    docs, folder = table(spark, "documents"), "/root/testdata/sf0.001"
    assert len(corpus_pipeline.STAGES) == 5
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    a = stages["quality rules"](spark, docs, folder)
    assert ids(a) == ids(repetition.measure(docs).where("kept"))
    b = stages["near duplicates"](spark, a, folder)
    assert ids(b) == sorted(i for i, (_, c) in brute_groups([(r.doc_id, r.text) for r in a.collect()], 5, 80).items() if i == c)
    c = stages["benchmark decontamination"](spark, b, folder)
    items = [r.text for r in table(spark, "benchmark").collect()]
    hit = {r.doc_id for r in b.collect() if len(r.text) < 4000 and any(brute_overlap(r.text, t) for t in items)}
    assert hit and hit.isdisjoint(ids(c)) and {r.doc_id for r in b.collect() if len(r.text) < 4000} - hit <= set(ids(c))
    for df in (a, b, c, stages["source mixing"](spark, c, folder)):
        assert df.columns == docs.columns
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == [*docs.columns, "shard"] and set(ids(out)) <= set(ids(c)) and out.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, folder)
    assert empty.count() == 0
