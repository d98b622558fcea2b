import random
import re
import time

import pytest

from pixledger.llm import personal_data as p

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    tests = [
        lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")),
        lambda s: 12 <= len(digits(s)) <= 19 and p.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15,
    ]
    return sorted((m.start(), k, m.end()) for k, x in enumerate(PATTERNS) for m in re.finditer(x, text) if tests[k](m[0]))


def test_fixed_patterns_against_plain_ones():
    rng = random.Random(6)
    for _ in range(20_000):
        text = "".join(rng.choice("ab1234567890@@..  -+()_%é") for _ in range(rng.randint(0, 40)))
        assert p.base_spans(text) == plain(text), text


def test_long_runs_are_quick():
    start = time.time()
    for text in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "@" * 200_000, "a@" * 100_000, "+1 " * 60_000):
        p.base_spans(text)
    assert time.time() - start < 20


def test_messages_match_exact_marginals_on_a_tree():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    model = {"node": rng.normal(size=(p.WIDTH, p._LABELS)), "chain": rng.normal(size=(p._LABELS,) * 2), "skip": np.eye(p._LABELS)}
    features, chain, skip = np.arange(8).reshape(4, 2), np.array([[0, 1], [1, 2]]), np.array([[0, 3]])
    unary = model["node"][features].sum(1)
    total = np.zeros((4, p._LABELS))
    for y in itertools.product(range(p._LABELS), repeat=4):
        weight = np.exp(sum(unary[k, y[k]] for k in range(4)) + sum(model["chain"][y[a], y[b]] for a, b in chain) + sum(model["skip"][y[a], y[b]] for a, b in skip))
        for k in range(4):
            total[k, y[k]] += weight
    assert np.allclose(p.beliefs(model, features, chain, skip, 80), total / total.sum(1, keepdims=True), atol=1e-6)


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(8)
    rows = []
    for i in range(240):
        phone = f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
        filler = "the house and the garden near"
        rows.append((i, [f"{filler} +1 {phone} {filler}", f"{filler} a{i}.b@mail{i}.org {filler}", f"{filler} 10.{i}.3.4 {filler}", f"{filler} in 20{i % 90 + 10} {filler}"][i % 4]))
    rows += [(900, "call +1 (437) 555-0689 12 345678 or later (437) 555-0689 again"), (901, None), (902, "")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string")


def test_the_field_adds_and_keeps(people, documents, no_documents):
    model = p.train(people)
    found = {r["doc_id"]: r for r in p.personal_data(people, model).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in people.collect()}
    for i, r in found.items():
        assert [(s["start"], p.KINDS.index(s["kind"]), s["end"]) for s in r["base"]] == plain(texts[i])
        assert set(r["base"]) <= set(r["spans"])
    assert any(s["kind"] == "phone" for s in found[900]["spans"])
    assert not any(found[i]["spans"] for i in range(3, 240, 4))
    assert found[901]["spans"] == [] and found[902]["spans"] == []
    assert p.personal_data(documents, model).count() == documents.count()
    assert p.train(no_documents) is None and p.personal_data(no_documents, None).collect() == []
