import hashlib
import random
import re

from pixledger.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def texts():
    rng = random.Random(4)
    parts = ["token", "Secret", ": ", "=", '"', " ", "abc", "AKIA", "AKIAZZZZ", "Q" * 16, "0f" * 12, "é\U0001F600", "apikey", "api_key=", "xyzxyz", "\n", "="]
    out = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    out += ["key " + "".join(rng.choice(alphabet) for _ in range(44)) + " end" for _ in range(40)]
    out += ["aaaaaaaaaaaaaaaaaaaa1111111111111111 and page-2021-2022-2023-2024-2025"] * 5
    return out + [" ".join("".join(rng.choice(["tion", "the", "er", "ing", "and"]) for _ in range(7)) for _ in range(60)) for _ in range(60)]


def test_spans_and_redaction(spark):
    rows = list(enumerate(texts())) + [(9000, None), (9001, "")]
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in rows], "doc_id long, text string, secret_base string, secret_spans string")
    found = secrets.with_secrets(docs.select("doc_id", "text"), secrets.thresholds(docs)).collect()
    for r in found:
        text = r["text"] or ""
        assert [tuple(s) for s in r["secret_base"]] == base(text), text
        assert set(r["secret_base"]) <= set(r["secret_spans"])
    added = {r["doc_id"] for r in found if any(s["kind"] == 3 for s in r["secret_spans"])}
    assert len(added & set(range(300, 340))) >= 30 and not added & set(range(340, 420))
    clean = {r["doc_id"]: r for r in secrets.redacted(docs).collect()}
    assert clean[9000]["text"] is None and clean[0]["secret_base"] == "a"
    for r in found:
        if len(r["secret_spans"]) == 1 and r["text"]:
            s = r["secret_spans"][0]
            assert clean[r["doc_id"]]["text"] == r["text"][: s["start"]] + "[SECRET]" + r["text"][s["end"] :]
        if not r["secret_spans"]:
            assert clean[r["doc_id"]]["text"] == r["text"]


def planted(spark, keys, copies=1):
    """The random spans' texts where each key stands in a text of short words."""
    rows = [(i, f"we saw the cat and the dog run by {key} on the way to town") for i, key in enumerate([*keys] * copies)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.with_secrets(docs, secrets.thresholds(docs)).collect()
    return {r["text"][s["start"] : s["end"]] for r in found for s in r["secret_spans"] if s["kind"] == 3}


def keys(alphabet, length, n):
    rng = random.Random(11)
    return ["".join(rng.choices(alphabet, k=length)) for _ in range(n)]


BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_a_key_is_found_at_every_size_of_corpus(spark):
    ordinary = ["the-annual-report-of-the-year-2021", "aaaaaaaaaaaaaaaaaaaa1111111111111111"]
    one = keys(BASE62, 40, 1)
    for copies in (1, 50):
        assert planted(spark, one + ordinary, copies) == set(one)
    many = keys(BASE62, 24, 20)
    assert len(planted(spark, many) & set(many)) >= 16


def test_keys_of_letters_alone_are_found(spark):
    lower, both, long_ = keys("abcdefghijklmnopqrstuvwxyz", 80, 20), keys(BASE62[:52], 32, 20), ["incomprehensibilities", "Wirtschaftswissenschaften"]
    found = planted(spark, lower + both + long_)
    assert len(found & set(lower)) >= 12 and len(found & set(both)) >= 18 and not found & set(long_)


def test_the_null_is_scored_as_tokens_are(spark):
    import numpy as np

    alphabet = next(x for name, _, x in secrets.ENCODINGS if name == "base62")
    tokens = keys(alphabet, 30, 20) + ["aB3" + "the" * 9]
    frame = spark.createDataFrame([(t,) for t in tokens], "token string").select("token", secrets.likeness(secrets.F.col("token")).alias("p"))
    found = {r["token"]: r["p"] for r in frame.collect()}
    own = secrets.likeness_of(np.array([[alphabet.index(c) + 1 for c in t] for t in tokens]), len(alphabet))
    assert np.allclose([found[t] for t in tokens], own, rtol=1e-6)


def test_edge_rows(spark, documents, no_documents):
    limits = secrets.thresholds(documents)
    assert secrets.with_secrets(documents.select("doc_id", "text"), limits).count() == documents.count()
    assert secrets.redacted(documents).schema == documents.schema
    assert secrets.redacted(no_documents).collect() == [] and secrets.thresholds(no_documents) == [2.0] * secrets.GROUPS


def test_digest_columns(spark, tmp_path):
    spark.createDataFrame([(1, 'token = "abcdef12"'), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    one, two = secrets.op4_secrets(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert one["spans"] == "assign:0:17" and one["base_sha256"] == hashlib.sha256(b"assign:0:17").hexdigest() and one["n_assign"] == 1
    assert two["spans"] == "" and two["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_plan_has_no_python(spark):
    plan = secrets.op4_secrets(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
