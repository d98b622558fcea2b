import random
import re

import numpy as np
import pytest

from pixledger.llm.repeats import BASE, SpanHashes, anchors, repeated_spans, window_hashes, without_repeats

MASK = (1 << 64) - 1


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(rows, size):
    """By id and text: the words that a window of a smaller id covers."""
    first = {}
    for i, text in rows:
        w = split(text)
        for k in range(len(w) - size + 1) if i is not None else ():
            g = tuple(w[k : k + size])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, text in rows:
        w = split(text)
        gone = set()
        for k in range(len(w) - size + 1) if i is not None else ():
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def test_span_hashes_by_hand():
    rng = random.Random(1)
    words = np.array([rng.randrange(1 << 64) for _ in range(60)], np.uint64)
    hashes = SpanHashes(words)
    by_hand = [sum(int(w) * pow(BASE, j, 1 << 64) for j, w in enumerate(words[k : k + 7])) & MASK for k in range(54)]
    assert hashes.at(np.arange(54), 7).tolist() == by_hand
    assert hashes.blocks(7).tolist() == by_hand[::7]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 5, 3000).astype(np.uint64)
    counts = np.array([1000, 0, 3, 1997])
    for size in (2, 5, 9):
        windows, n = window_hashes(words, counts, size)
        found = anchors(words, counts, size)
        assert len(found) == len(windows) == n.sum()
        by_window = {}
        assert all(by_window.setdefault(w, a) == a for w, a in zip(windows.tolist(), found.tolist()))


@pytest.mark.parametrize("size", [5, 50])
def test_against_brute_force(spark, documents, size):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(70))
    rows = [(100 + k, " ".join(f"{rng.random()}" for _ in range(rng.randint(0, 30))) + f"\n {passage}\t" + passage[: rng.randint(0, 300)]) for k in range(20)]
    more = spark.createDataFrame([(r + (None, "n", None, "part", "key", "from", "base", 3)) for r in rows], documents.schema)
    docs = documents.union(more)
    read = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    found = repeated_spans(docs, size).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = [(r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in found]
    assert sorted(got, key=key) == sorted(expected(read, size), key=key)
    assert all(a["end"] < b["start"] for r in found for a, b in zip(r["spans"], r["spans"][1:]))


def test_texts_and_columns_stay(documents, no_documents):
    kept = without_repeats(documents)
    assert kept.columns == documents.columns and kept.count() == documents.count()
    whole = {r["doc_id"]: r["text"] for r in documents.where("doc_id IN (82, 83, 84, 88, 89)").collect()}
    assert {r["doc_id"]: r["text"] for r in kept.where("doc_id IN (82, 83, 84, 88, 89)").collect()} == whole
    assert without_repeats(no_documents).collect() == [] and repeated_spans(no_documents).collect() == []


def test_a_row_repeated_in_a_third_of_the_table(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.range(300).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", f"IF(id % 3 = 0 OR id = 100, '{text}', CAST(id AS STRING)) AS text")
    found = repeated_spans(docs).collect()
    assert len(found) == 300
    assert {r["doc_id"] for r in found if r["spans"]} == {100}
