import re
from collections import defaultdict

import pytest

from pixledger.llm.common import components
from pixledger.llm.jaccard_join import jaccard_components, one_per_group

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        least[root(k)].append(i)
    return [(i, len(s), min((x for x in least[root(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_components_match_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    found = [tuple(r) for r in jaccard_components(documents).collect()]
    assert by_id(found) == by_id(brute(rows))
    expected = by_id(brute(rows))
    kept = one_per_group(documents)
    assert kept.columns == documents.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(i for i, _, c in expected if i is not None and i == c)


def test_no_rows(no_documents):
    assert jaccard_components(no_documents).collect() == []


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[k] == 1 for k in range(2, 61)) and all(found[k] == 100 for k in range(101, 160)) and found[301] == 300


def test_texts_of_suspects_with_and_without_the_bitmap(documents, monkeypatch):
    from pixledger.llm import jaccard_join

    wanted = documents.where("doc_id % 7 = 0").select("doc_id").distinct()
    read = documents.select("doc_id", "text")
    expected = sorted(r["text"] or "" for r in read.where("doc_id % 7 = 0").collect())
    by_bits = sorted(r["text"] or "" for r in jaccard_join._chosen_texts(read, wanted).collect())
    assert by_bits == expected
    monkeypatch.setattr(jaccard_join, "MARK_BITS", 64)
    assert sorted(r["text"] or "" for r in jaccard_join._chosen_texts(read, wanted).collect()) == expected


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_near_copies_linked_through_a_null_id(spark, monkeypatch, bits):
    """With the bitmap of ids and without it, a text without an id carries links."""
    from pixledger.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "MARK_BITS", bits)
    base = [f"w{k}" for k in range(120)]
    chain = [(1, base), (None, base[:-8] + [f"x{k}" for k in range(8)]), (2, base[8:-8] + [f"x{k}" for k in range(16)])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in chain] + [(9, "some other text that nobody else has at all")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_components(docs).collect()} == {(1, 1), (2, 1), (None, 1), (9, 9)}


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_sifting_and_sets_share_a_worker(documents, monkeypatch, bits):
    """One Python step makes the sets of the chosen texts; the rows reach it in batches of a bounded number."""
    from pixledger.llm import jaccard_join

    monkeypatch.setattr(jaccard_join, "MARK_BITS", bits)
    read, wanted = documents.select("doc_id", "text"), documents.where("doc_id < 40").select("doc_id").distinct()
    sets = jaccard_join._chosen_texts(read, wanted, jaccard_join._sets, "node binary, n long, last long, tokens array<bigint>")
    assert sets._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    expected = [len(shingles(r["text"])) for r in read.where("doc_id < 40").collect()]
    assert sorted(r["n"] for r in sets.collect()) == sorted(n for n in expected if n)
