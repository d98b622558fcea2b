import hashlib

import pytest
from pyspark.sql import functions as F

from pixledger.llm import manifest

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, digest string, tree string, place int, n int, block int, root string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climbed(digests):
    """The root, and for each node the sibling digests on its way there."""
    nodes, paths, owners = list(digests), [[] for _ in digests], [[i] for i in range(len(digests))]
    while len(nodes) > 1:
        families = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
        for i, family in enumerate(families):
            for j in range(len(family)):
                for owner in owners[2 * i + j]:
                    paths[owner] += [d for k, d in enumerate(family) if k != j]
        owners = [sum(owners[i : i + 2], []) for i in range(0, len(nodes), 2)]
        nodes = [sha(*f) for f in families]
    return nodes[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in names:
        trees[x].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
    subs = {x: climbed([leaf(r) for r in trees[x]]) for x in names}
    root, tops = climbed([subs[x][0] for x in names])
    return [(r[0], leaf(r), subs[x][0], root, own + top) for x, top in zip(names, tops) for r, own in zip(trees[x], subs[x][1])]


def rows_of(n):
    langs = ["en", None, "", "é", "zz", "en", "en"]
    rows = [(k * 7 % n, "s", langs[k % 7], k, f"text {k} é") for k in range(n)]
    return rows + [(3, None, "en", None, None), (3, None, "en", None, None), (3, "", "en", 0, ""), (None, "s", "en", 1, "no id"), (None, None, None, None, None), (5, "s", "alone", 1, "x" * 100_000)]


@pytest.mark.parametrize("bits, n", [(1, 21), (2, 64), (10, 90)])
def test_proofs_roots_and_folding(spark, bits, n):
    rows = rows_of(n)
    docs = spark.createDataFrame([r + ("d", "t", 1, 2, 3, "r") for r in rows], COLUMNS)
    found = manifest.dataset_manifest(docs, bits).withColumn("again", manifest.folded(F.col("digest"), F.col("proof"))).withColumn("wrong", manifest.folded(F.sha2(F.lit("x"), 256), F.col("proof"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    got = [(r["doc_id"], r["digest"], r["subroot"], r["root"], [s["digest"] for s in r["proof"] if s["digest"]]) for r in found]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)
    assert all(r["again"] == r["root"] != r["wrong"] for r in found)


def test_small_tables(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert manifest.dataset_manifest(none).collect() == []
    one = spark.createDataFrame([(1, "s", "en", 3, "abc", "d", "t", 1, 2, 3, "r")], COLUMNS)
    (row,) = manifest.dataset_manifest(one).collect()
    assert row["digest"] == row["subroot"] == row["root"] == leaf((1, "s", "en", 3, "abc")) and row["proof"] == []


def test_a_third_of_equal_rows_is_dealt_to_many_tasks(spark):
    docs = spark.range(3000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "'s' AS source", "'en' AS lang", "CAST(1 AS LONG) AS n_chars", "IF(id % 3 = 0, 'same', CAST(id AS STRING)) AS text")
    leaves = docs.select(F.lit("+en").alias("tree"), "doc_id", manifest.leaf_digest().alias("digest"))
    placed = manifest._numbered(leaves, "doc_id", "digest")
    assert sorted(r[0] for r in placed.select("place").collect()) == list(range(3000))
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(8, "tree", "doc_id", "digest", "tie")
    assert max(r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()) < 900


def test_the_queue_delivers_by_label():
    sweep = manifest.BlockSweep(["a", "b", "c"], 0, 3)
    assert sweep.top == (2, 0) and sweep.digest == sha(sha("a", "b"), sha("c"))
    assert sweep.proofs([]) == [
        [{"digest": "b", "left": False}, {"digest": sha("c"), "left": False}],
        [{"digest": "a", "left": True}, {"digest": sha("c"), "left": False}],
        [{"digest": None, "left": False}, {"digest": sha("a", "b"), "left": True}],
    ]
