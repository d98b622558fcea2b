import hashlib
import random

import numpy as np
import pyarrow as pa

from pixledger.llm.fingerprints import PrefixHashes, code_points, fingerprints, likeness, neighbour_edits


def test_spans_and_extensions_against_strings():
    rng = random.Random(3)
    text = "".join(rng.choice("ab\U0001F600") for _ in range(400))
    hashes = PrefixHashes(np.array([ord(c) for c in text]))
    a, b = np.array([rng.randrange(380) for _ in range(500)]), np.array([rng.randrange(380) for _ in range(500)])
    n = np.array([rng.randint(0, 6) for _ in range(500)])
    assert hashes.equal(a, b, n).tolist() == [text[x : x + k] == text[y : y + k] for x, y, k in zip(a, b, n)]
    most = 400 - np.maximum(a, b)
    expected = [next((k for k in range(m) if text[x + k] != text[y + k]), m) for x, y, m in zip(a, b, most)]
    assert hashes.common(a, b, most).tolist() == expected


def test_a_text_has_the_same_print_in_any_company():
    texts = ["", "abc", "é" * 50, "some longer text, and more of it " * 20, "x"]
    together, _ = fingerprints(*code_points(pa.array(texts, pa.large_string())))
    alone = [fingerprints(*code_points(pa.array([t], pa.large_string())))[0][0] for t in texts]
    assert together == alone and len(set(together)) == len(texts)
    assert likeness(together[0], together[0]) == 1 and likeness(together[0], together[1]) == 0
    near, _ = fingerprints(*code_points(pa.array([texts[3][:-5] + "other"], pa.large_string())))
    assert likeness(together[3], near[0]) > 0.5


def expected_rows(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1].encode()))
    out = []
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def test_neighbours_across_ranges(documents, no_documents):
    rows = [(r["doc_id"], r["text"] or "") for r in documents.select("doc_id", "text").collect()]
    found = neighbour_edits(documents).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found), key=key) == sorted(expected_rows(rows), key=key)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert neighbour_edits(no_documents).collect() == []
    one = documents.where("doc_id = 86")
    assert neighbour_edits(one).count() == 1
