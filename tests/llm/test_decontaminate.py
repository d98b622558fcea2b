import random
import re

import numpy as np
import pyarrow as pa

from pixledger.llm import decontaminate as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(text, items):
    words = WORD.findall((text or "").translate(LOW))
    hit, found = [False] * len(words), set()
    for item, passage in items:
        other = WORD.findall((passage or "").translate(LOW))
        size = min(10, len(other))
        windows = {tuple(other[k : k + size]) for k in range(len(other) - size + 1)} if size else set()
        for k in range(len(words) - size + 1) if size else ():
            if tuple(words[k : k + size]) in windows:
                found.add(item)
                hit[k : k + size] = [True] * size
    return len(words), hit, sorted(found)


def test_suffix_order_and_ranks():
    rng = np.random.default_rng(4)
    for size in (1, 2, 50, 400):
        sequence = np.concatenate([rng.integers(10, 13, size), [5], rng.integers(10, 13, size), [6]])
        order = d.suffix_order(sequence)
        assert order.tolist() == sorted(range(len(sequence)), key=lambda i: sequence[i:].tolist())
        ranks = d.WaveletMatrix(sequence, 4)
        symbols, until = rng.integers(0, 16, 60), rng.integers(0, len(sequence) + 1, 60)
        assert ranks.rank(symbols, until).tolist() == [(sequence[:u] == s).sum() for s, u in zip(symbols, until)]


def test_search_and_location():
    rng = np.random.default_rng(5)
    sequence = np.concatenate([rng.integers(2, 5, 300), [1]])
    index = d.FMIndex(sequence, 5)
    phrases = rng.integers(2, 6, (80, 4))
    low, high = index.search(phrases)
    for phrase, a, b in zip(phrases, low, high):
        expected = [i for i in range(298) if sequence[i : i + 4].tolist() == phrase.tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == expected


def bench(spark, documents):
    rng = random.Random(10)
    texts = [r["text"] for r in documents.select("text").collect() if r["text"] and len(r["text"].split()) > 30]
    items = []
    for k in range(12):
        words = rng.choice(texts).split()
        at = rng.randrange(len(words) - 25)
        items.append((k, " ".join(words[at : at + rng.randint(3, 25)]).upper() if k % 2 else ", ".join(words[at : at + 14])))
    items += [(50, None), (51, ""), (52, "same text HERE"), (53, items[0][1])]
    return spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, bench_from string")


def test_against_a_plain_search(spark, documents, no_documents, monkeypatch):
    benchmark = bench(spark, documents)
    items = [(str(r["item_id"]), r["text"]) for r in benchmark.collect()]
    one = d.contamination(documents.select("doc_id", "text"), benchmark).collect()
    monkeypatch.setattr(d, "BLOCK_BYTES", 400)
    several = d.contamination(documents.select("doc_id", "text"), benchmark).collect()
    for found in (one, several):
        assert len(found) == documents.count() and any(r["bench_items"] for r in found)
        for r in found:
            n, hit, names = plain(r["text"], items)
            mask = [False] * n
            for a, b in zip(r["bench_from"], r["bench_to"]):
                mask[a:b] = [True] * (b - a)
            assert (r["bench_words"], mask, r["bench_items"]) == (n, hit, names)
    assert d.contamination(no_documents, benchmark).collect() == []
    assert {r["bench_words"] for r in d.contamination(documents.where("doc_id = 86"), benchmark.limit(0)).collect()} == {4}


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Start, one two THREE. End é", 27, "k"), (2, None, None, "k"), (3, "clean one two", 13, "k")], "doc_id long, text string, n_chars long, bench_to string")
    benchmark = spark.createDataFrame([("i", "one, two; three")], "item_id string, text string")
    found = {r["doc_id"]: r for r in d.decontaminated(docs, benchmark).collect()}
    assert found[1]["text"] == "Start, . End é" and found[1]["n_chars"] == 14 and found[1]["bench_to"] == "k"
    assert found[2]["text"] is None and found[3]["text"] == "clean one two"


def test_words_and_their_bytes():
    texts = ["Ab, c-é9", "", "é", " x", "y"]
    data, offsets = d.raw(pa.array(texts, pa.large_string()))
    words, counts = d.words_of(data, offsets)
    begin, end = d.word_ends(data, offsets)
    assert counts.tolist() == [len(WORD.findall(t.translate(LOW))) for t in texts]
    assert [data[a:b].decode().lower() for a, b in zip(begin, end)] == words.to_pylist() == ["ab", "c", "é9", "é", "x", "y"]


def test_rows_reach_the_workers_in_bounded_batches(spark):
    import pyarrow as pa

    from pixledger.llm.common import BATCH_ROWS, in_arrow

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    found = [r["n"] for r in in_arrow(spark.range(0, 3 * BATCH_ROWS + 1, 1, 1), sizes, "n long").collect()]
    assert sum(found) == 3 * BATCH_ROWS + 1 and max(found) <= BATCH_ROWS
