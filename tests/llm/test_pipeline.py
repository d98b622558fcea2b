import corpus_pipeline
from pixledger.llm.decontaminate import contamination
from pixledger.llm.jaccard_join import jaccard_components

SMALL = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        assert name == "packing" or docs.columns == columns
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4]
    assert docs.select("doc_id").distinct().count() == counts[4]
    alone = jaccard_components(spark.read.parquet(f"{tmp_path}/1"))
    assert alone.where("doc_id = component_id").count() == counts[2]
    clean = contamination(spark.read.parquet(f"{tmp_path}/2"), spark.read.parquet(f"{SMALL}/benchmark.parquet"))
    dirty = {r["doc_id"] for r in clean.where("size(bench_items) > 0").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tmp_path}/{k}").collect()} for k in (2, 3))
    assert {i for i in before if before[i] != after[i]} == dirty
