import corpus_pipeline


def test_one_row_of_each_group_stays(spark):
    base = [f"w{k}" for k in range(60)]
    near, other = " ".join(base + ["end"]), " ".join(f"v{k}" for k in range(30))
    rows = [(0, " ".join(base), "a")] * 5 + [(0, near, "a"), (1, other, "a"), (2, near, "b"), (2, other, "b"), (None, near, "c"), (None, "no id here", "c"), (3, "", "d"), (4, None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    found = kept.collect()
    assert kept.columns == docs.columns and len(found) == 5
    assert sorted(str(r["doc_id"]) for r in found) == ["0", "1", "3", "4", "None"]
    assert {r["text"] for r in found if r["doc_id"] is None} == {"no id here"}
