import corpus_pipeline
from tessella.llm import decontaminate
from tessella.llm.queries import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names, seen = docs.columns, {r.doc_id for r in docs.collect()}
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, SF).cache()
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= seen
        seen = ids
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == names
        if k == 3:
            left = decontaminate.digest(decontaminate.scan(docs, table(spark, SF, "benchmark")))
            assert left.filter("n_hit >= 10").count() == 0
    assert docs.filter("not round_trip").count() == 0
    assert docs.groupBy("doc_id").count().filter("count > 2").count() == 0
