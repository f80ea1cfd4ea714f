import corpus_pipeline
from sievector.llm import neardup, quality, rules

SF = "/root/testdata/sf0.001"


def test_stages(spark, documents, labels):
    docs, kept = documents, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == documents.columns
        kept[name] = {r["doc_id"] for r in docs.collect()}
    first, second, third = kept.values()
    assert first == {r["doc_id"] for r in quality.classify(documents, labels).where("predicted = 1").collect()}
    judged = rules.judge(documents.where(documents["doc_id"].isin(list(first))))
    assert second == {r["doc_id"] for r in judged.where("kept").collect()}
    found = neardup.components(documents.where(documents["doc_id"].isin(list(second)))).collect()
    assert third == {r["component"] for r in found if r["n_shingles"]} | {r["key"] for r in found if not r["n_shingles"]}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == third


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}


def test_odd_rows(spark, odd, none, clashing):
    for docs in (odd, none, clashing):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SF)
            assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)
