import random
import zlib

import numpy as np
import pytest

from pixledger.llm import periodic_runs as pr
from tests.llm.test_repeats import split


def brute(words):
    found, n = {}, len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def made(rng, n, kinds):
    words = []
    while len(words) < n:
        block = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))]
        words += (block * rng.randint(1, 9))[: rng.randint(1, 80)]
    return words[:n]


@pytest.mark.parametrize("long", [8, 2048])
def test_all_runs_of_random_words(long, monkeypatch):
    monkeypatch.setattr(pr, "LONG", long)
    rng = random.Random(long)
    for _ in range(60):
        texts = [made(rng, rng.randint(0, 150), rng.choice([1, 2, 3, 30])) for _ in range(6)]
        ids = np.array([x for t in texts for x in t], np.int64)
        assert pr.find_runs(ids, np.array([len(t) for t in texts])) == [brute(t) for t in texts]


def test_splitting_keeps_what_can_be_a_run():
    words = [1, 2, 3, 9, 9, 9, 9, 9, 9, 4, 1, 2, 1, 2, 1, 2, 1, 2, 5]
    starts, sizes = pr.surviving(np.array(words), np.array([len(words)]))
    assert list(zip(starts.tolist(), sizes.tolist())) == [(3, 6), (10, 8)]
    # 7 stands four times, but between words too rare: nothing is left
    assert len(pr.surviving(np.array([7, 1, 7, 2, 7, 3, 7]), np.array([7]))[0]) == 0


def test_long_texts_end():
    rng = random.Random(5)
    block = [rng.randrange(50) for _ in range(20_000)]
    for words, runs in (([0] * 200_000, [(0, 200_000, 1)]), (block * 5, [(0, 100_000, 20_000)]), (([0] * 100 + [1]) * 1000, 1001)):
        found = pr.find_runs(np.array(words), np.array([len(words)]))[0]
        assert (found if isinstance(runs, list) else len(found)) == runs or set(runs) <= set(found)


def test_rows_of_every_kind(spark, documents, no_documents):
    rng = random.Random(9)
    rows = [(200 + k, " ".join(f"w{x}" for x in made(rng, rng.randint(0, 400), 4))) for k in range(30)]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    found = pr.periodic_runs(docs).collect()
    by_row = sorted(((r["doc_id"] is None, r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found), key=repr)
    wanted = []
    for r in docs.collect():
        words = split(r["text"])
        runs = brute(words) if len(words) < 2000 else []
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        wanted.append((r["doc_id"] is None, r["doc_id"], runs, " ".join(w for i, w in enumerate(words) if i not in gone)))
    assert by_row == sorted(wanted, key=repr)
    assert pr.periodic_runs(no_documents).collect() == []


def test_planted_repeats(documents):
    before = {(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()}
    after = pr.with_planted_repeats(documents).collect()
    wanted = []
    for i, text in before:
        words = split(text)
        n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        wanted.append((i, " ".join(words)))
    assert {(r["doc_id"], r["text"]) for r in after} == set(wanted)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in before)


def test_strongest_run(spark):
    rows = [([(0, 12, 3), (5, 8, 2)],), ([(9, 8, 1), (20, 16, 2), (40, 6, 1)],), ([],), ([(3, 8, 2), (3, 16, 4)],)]
    df = spark.createDataFrame(rows, "runs array<struct<start:bigint,length:bigint,period:bigint>>")
    assert [r[0] and tuple(r[0]) for r in df.select(pr.strongest(df["runs"])).collect()] == [(0, 12, 3), (9, 8, 1), None, (3, 8, 2)]
