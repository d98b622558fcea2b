import random

import numpy as np
import pyarrow as pa

from pixledger.llm import quality
from pixledger.llm.common import table

SMALL = "/root/testdata/sf0.01"


def test_prior_and_risk_on_a_known_mixture():
    rng = np.random.default_rng(1)
    draw = lambda n, m: np.hstack([rng.normal(m, 1, (n, 3)), np.ones((n, 1))]).astype(np.float32)
    positive, unlabelled = draw(2000, 2.0), np.vstack([draw(1400, 2.0), draw(600, -2.0)])
    apart = np.arange(2000) % 2 == 1
    first = quality.contrast(positive, unlabelled, apart, apart)
    counts = [np.bincount(quality.bins_of(quality.standardised(first, x[apart]) @ first["weights"]), minlength=quality.BINS) for x in (positive, unlabelled)]
    model = quality.fit(first, positive, unlabelled, quality.class_prior(*counts))
    assert abs(model["prior"] - 0.7) < 0.08
    assert (quality.scores(model, draw(500, 2.0)) >= 0.3).mean() > 0.97 and (quality.scores(model, draw(500, -2.0)) < 0.3).mean() > 0.97


def test_gradient_of_the_risk_by_differences():
    rng = np.random.default_rng(3)
    p, u, w = rng.normal(1, 1, (60, 4)), rng.normal(0, 1, (80, 4)), rng.normal(0, 1, 4)
    for prior, sign in ((0.2, 1), (0.95, -1)):
        w = w if sign == 1 else np.full(4, 3.0)
        good, rest = quality.risk(w, p, u, prior)
        value = (lambda x: sum(quality.risk(x, p, u, prior))) if rest >= 0 else (lambda x: -quality.risk(x, p, u, prior)[1])
        assert (rest >= 0) == (sign == 1)
        by_steps = [(value(w + step) - value(w - step)) / 2e-6 for step in np.eye(4) * 1e-6]
        assert np.allclose(quality.risk_gradient(w, p, u, prior), by_steps, atol=1e-5)


def test_prior_by_a_plain_loop():
    rng = np.random.default_rng(4)
    p, u = rng.integers(0, quality.BINS, 300), np.concatenate([rng.integers(0, quality.BINS, 300), rng.integers(0, quality.BINS // 8, 200)])
    best = None
    for cut in range(quality.BINS):
        share_p, share_u = (p >= cut).mean(), (u >= cut).mean()
        if 0.1 <= share_p <= 0.98:
            margin = np.sqrt(np.log(80) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
            found = ((share_u + margin) / share_p, share_u / share_p)
            best = found if best is None or found[0] < best[0] else best
    counts = [np.bincount(x, minlength=quality.BINS) for x in (p, u)]
    assert np.isclose(quality.class_prior(*counts), best[1])


def test_the_prior_sees_rows_that_the_fit_does_not(spark, monkeypatch):
    """With a tiny sample the histogram still counts every unlabelled row but those of the first fit."""
    seen = []
    monkeypatch.setattr(quality, "class_prior", lambda p, u: seen.append(int(u.sum())) or 0.5)
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    quality.train(docs, labels, 50)
    outside = docs.where(~quality._held_out()).count()
    assert outside - 80 < seen[0] < outside


def test_features_do_not_depend_on_the_chunk():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aB 1.\n!é") for _ in range(rng.randint(0, 50))) for _ in range(40)] + ["", "x" * 100_000]
    whole = quality.features(pa.array(texts, pa.large_string()))
    single = np.vstack([quality.features(pa.array([t], pa.large_string())) for t in texts])
    assert np.allclose(whole, single) and not whole[40, :-1].any()


def test_held_out_accuracy(spark):
    found = quality.op2_quality(spark, SMALL).join(table(spark, SMALL, "labels"), "doc_id").where("held_out").toPandas()
    good = found[found["quality"] == 1]
    assert (good["predicted"] == 1).mean() > 0.97
    assert (found["predicted"] == found["quality"]).mean() > 0.95


def test_edge_rows(spark, documents, no_documents):
    labels = spark.createDataFrame([(i, 1, "z") for i in range(40)] + [(None, 1, "z"), (3, 0, "z")], "doc_id long, quality int, text string")
    model = quality.train(documents, labels)
    scored = quality.score_documents(documents, model).collect()
    assert len(scored) == documents.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert len({r["score"] for r in scored if r["doc_id"] in (82, 83, 85)}) == 1
    kept = quality.good_documents(documents, labels)
    assert kept.schema == documents.schema and kept.count() == sum(r["score"] >= 0.3 for r in scored)
    assert quality.train(no_documents, labels) is None
    assert {r["score"] for r in quality.score_documents(documents, None).collect()} == {0.5}
    assert quality.score_documents(no_documents, None).collect() == []
