import corpus_pipeline as C
from pitchline.llm import resampling
from tests.llm.helpers import SF_DIR, edge_documents
from tests.llm.test_near_copies import brute as brute_near_copies
from tests.llm.test_simple8b import brute as brute_tokens


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert set(after) <= set(before) and all(before[i] == t for i, t in after.items())
        if name == "quality":
            scored = resampling.resample(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet")).filter("kept").collect()
            assert set(after) == {r.doc_id for r in scored}
        if name == "near_dedup":
            assert set(after) == brute_near_copies(sorted(before.items()))
        if name == "decontaminate":
            items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
            holds = {i for i, t in before.items() if any(x in " ".join(t.split()) for x in items)}
            assert holds <= set(before) - set(after)
        if name == "mix":
            size = lambda texts: sum(len(t.split()) for t in texts.values())
            assert 0.8 * size(before) <= size(after) <= 0.9 * size(before)
        before, docs = after, out
    want = brute_tokens(sorted(before.items()))
    assert sorted(tuple(r) for r in C.tokens(spark, docs, SF_DIR).collect()) == want
    assert sorted(tuple(r) for r in C.run(spark, SF_DIR).collect()) == want


def test_stages_take_odd_documents_and_empty_tables(spark):
    for start in (edge_documents(spark), edge_documents(spark).filter("false")):
        docs = start
        for _, stage in C.STAGES[:-1]:
            docs = stage(spark, docs, SF_DIR)
            assert docs.columns == start.columns
        C.tokens(spark, docs, SF_DIR).count()

