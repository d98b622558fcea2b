import itertools
import random

import numpy as np

from pixledger.llm import language as g

SMALL = "/root/testdata/sf0.01"


def test_paths_are_the_best(spark):
    rng = np.random.default_rng(6)
    counts = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)) * 3
    labels = g.best_paths(scores, counts, 2.0)
    at = 0
    for n in counts:
        own = scores[at : at + n]
        value = lambda y: sum(own[k, y[k]] for k in range(n)) - 2.0 * sum(a != b for a, b in zip(y, y[1:]))  # noqa: B023, E731
        if n:
            assert tuple(labels[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


def test_held_out_accuracy(spark):
    found = g.op10_language(spark, SMALL).toPandas().merge(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang").toPandas())
    assert len(found) == 1000
    assert (found[found["held_out"]]["lang_pred"] == found[found["held_out"]]["lang"]).mean() > 0.98


def test_mixed_texts_scripts_and_edges(spark, documents, no_documents):
    rng = random.Random(11)
    make = {"aa": ["tho", "ing", "er"], "bb": ["sch", "keit", "ung"], "ru": ["при", "вет", "мир"]}
    text = lambda lang, n: " ".join("".join(rng.choice(make[lang]) for _ in range(3)) for _ in range(n))
    rows = [(i, text(lang, 30), lang) for i, lang in enumerate(sorted(make) * 30)] + [(500, None, "aa"), (501, "x", None)]
    model = g.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(1, f"{text('aa', 20)}. {text('bb', 9)}!"), (2, text("ru", 3)), (3, None), (4, "12 ,."), (5, ""), (6, text("bb", 1)), (6, text("bb", 1))]
    found = g.languages(spark.createDataFrame([(*r, "zz") for r in asked], "doc_id long, text string, lang string"), model).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(asked)
    assert by[1]["lang_pred"] == "aa" and [s["lang"] for s in by[1]["spans"]] == ["aa", "bb"]
    first, second = by[1]["spans"]
    assert asked[0][1][first["start"] : first["end"]] == asked[0][1].split(".")[0] and asked[0][1][second["end"] :] == "!"
    assert by[2]["lang_pred"] == "ru" and by[6]["lang_pred"] == "bb"
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (3, 4, 5))
    assert g.languages(documents, model).count() == documents.count()
    assert g.train(no_documents) is None
    assert {r["lang_pred"] for r in g.languages(documents, None).collect()} == {"und"}
    assert g.languages(no_documents, model).collect() == []
