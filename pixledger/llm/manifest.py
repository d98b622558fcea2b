"""Merkle manifest of a dataset: digests, roots and inclusion proofs, by time-forward processing.

Every document is a leaf; the leaves of a language form a binary tree, and the languages' roots one
more tree with the dataset's root. A node is the SHA-256 of its children's hex digests end to end; a last
node without a partner is hashed alone.

Nodes carry labels (level, place) and are processed in label order: each takes its children's digests, which
have been sent ahead to its label, from a priority queue and sends its own to its parent's label. In the
reversed sweep each node takes its proof from the queue (the digests beside the path to the root) and
sends it on to its children, with what lies beside them in front. The queue is external: Spark
sorts the leaves by language and id, numbers them, and delivers messages between blocks of ``2 ** BITS``
neighbouring nodes by shuffles on (tree, block); a task's own queue holds the labels of one block.
Each pass shrinks the nodes ``2 ** BITS`` times, so two passes do for a million leaves a language, four for 10**12. No
language meets in one task: a block is a fixed number of neighbours.

Nulls count as ``-`` in a leaf and are told apart from empty texts; the null language is a tree of its
own and comes first; null ids come last. Repeated rows are leaves of their own next to each other; rows of one id are
ordered by leaf digest. An empty table gives no rows. Only the five columns of documents are read.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import stored, table

BITS = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "struct<digest:string,left:boolean>"
_PROOF = pa.list_(pa.struct([("digest", pa.string()), ("left", pa.bool_())]))


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row's fields, each as its byte count and value or as ``-``; ``changed`` replaces fields by name."""
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def _hash(*digests: str) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


class BlockSweep:
    """The nodes of one block, swept upwards in label order, and proofs delivered in the reversed order.

    ``first`` is the place of the block's first node, ``n`` the number of nodes of its level in the whole tree.
    """

    def __init__(self, digests: list[str], first: int, n: int, bits: int = BITS):
        self.first, self.counts = first, [n]
        while self.counts[-1] > 1 and len(self.counts) <= bits:
            self.counts.append(-(-self.counts[-1] // 2))
        self.nodes: dict[tuple[int, int], str] = {}
        queue = [(0, first + i, d) for i, d in enumerate(digests)]  # sorted, so a heap
        top = len(self.counts) - 1
        while queue:
            level, place, digest = heapq.heappop(queue)
            self.nodes[level, place] = digest
            if level < top:
                family = [digest]
                if queue and queue[0][:2] == (level, place | 1):
                    self.nodes[level, place | 1] = queue[0][2]
                    family.append(heapq.heappop(queue)[2])
                heapq.heappush(queue, (level + 1, place >> 1, _hash(*family)))
        self.top = (top, first >> top)

    @property
    def digest(self) -> str:
        return self.nodes[self.top]

    def proofs(self, above: list[dict]) -> list[list[dict]]:
        """The steps from each of the block's first nodes to the root, given those ``above`` the block; a step without a digest hashes alone."""
        queue, out = [(-self.top[0], -self.top[1], above)], {}
        while queue:
            level, place, steps = heapq.heappop(queue)
            level, place = -level, -place
            if not level:
                out[place] = steps
                continue
            for child in (2 * place, 2 * place + 1):
                if (level - 1, child) in self.nodes:
                    beside = {"digest": self.nodes.get((level - 1, child ^ 1)), "left": bool(child & 1)}
                    heapq.heappush(queue, (1 - level, -child, [beside, *steps]))
        return [out[place] for place in sorted(out)]


def _numbered(leaves: DataFrame, *order: str) -> DataFrame:
    """``leaves`` with ``place``, their number from 0 within each ``tree`` by ``order``, and ``n``, the tree's size.

    Rows are range-sorted by tree, order and, as equal rows may be very many, their place in the input; one
    offset a range reaches the driver.
    """
    spark = leaves.sparkSession
    keys = ["tree", *(F.col(c).asc_nulls_last() for c in order), "tie"]
    ranged = leaves.withColumn("tie", F.monotonically_increasing_id())
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).drop("tie")
    ranged = stored(ranged.withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33)
    sizes = sorted(map(tuple, ranged.groupBy(part.alias("part")).count().collect()))
    offsets, total = [], 0
    for k, size in sizes:
        offsets.append((k, total))
        total += size
    offsets = F.broadcast(spark.createDataFrame(offsets, "part bigint, offset bigint"))  # one row a range
    placed = ranged.withColumn("part", part).join(offsets, "part")
    placed = placed.withColumn("place", F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("part", "offset", "at")
    trees = placed.groupBy("tree").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    return placed.join(trees, "tree").withColumn("place", F.col("place") - F.col("first")).drop("first")


def _blocked(nodes: DataFrame, bits: int) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", bits))


def _sweep(rows: pa.Table, bits: int) -> tuple[pa.Table, BlockSweep]:
    rows = rows.sort_by("place")
    return rows, BlockSweep(rows.column("digest").to_pylist(), rows.column("place")[0].as_py(), rows.column("n")[0].as_py(), bits)


def _tops(bits: int):
    def top(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        _, sweep = _sweep(rows, bits)
        level, place = sweep.top
        return pa.table({"tree": pa.array([key[0].as_py()], pa.string()), "place": pa.array([place], pa.int64()), "n": pa.array([sweep.counts[level]], pa.int64()), "digest": [sweep.digest]})

    return top


def _risen(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """The nodes of each pass, from the given ones to one node a tree."""
    passes = [nodes]
    while (passes[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tops = _blocked(passes[-1], bits).select("tree", "block", "place", "n", "digest").groupBy("tree", "block")
        passes.append(stored(tops.applyInArrow(_tops(bits), "tree string, place bigint, n bigint, digest string"), "nodes"))
    return passes


def _delivered(names: list[str], bits: int):
    def proofs(rows: pa.Table, messages: pa.Table) -> pa.Table:
        rows, sweep = _sweep(rows, bits)
        message = messages.slice(0, 1).to_pylist()[0]
        columns = {c: rows.column(c) for c in names}
        columns["proof"] = pa.array(sweep.proofs(message["proof"]), _PROOF)
        for c in ("subroot", "root"):
            columns[c] = pa.array([message[c]] * rows.num_rows, pa.string())
        return pa.table(columns)

    return proofs


def _fallen(passes: list[DataFrame], above: DataFrame, bits: int) -> DataFrame:
    """The nodes of the first pass with proof, subroot and root, from those of each tree's top in ``above``."""
    for nodes in reversed(passes[:-1]):
        fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields), f"proof array<{_STEP}>, subroot string, root string"])
        messages = above.select("tree", F.col("place").alias("block"), "proof", "subroot", "root").groupBy("tree", "block")
        above = _blocked(nodes, bits).groupBy("tree", "block").cogroup(messages).applyInArrow(_delivered(nodes.columns, bits), fields)
    return above


def with_proofs(leaves: DataFrame, *order: str, bits: int = BITS) -> DataFrame:
    """``leaves`` (tree, digest and columns of their own) with their proof, their tree's subroot and the root.

    ``order`` names the columns that order the leaves of a tree before their digests; trees go by name. A
    proof lists a step a level: the digest beside the path, null where there is none, and whether it is on the left.
    """
    passes = _risen(stored(_numbered(leaves, *order, "digest"), "leaves"), bits)
    subroots = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    forest = _risen(stored(_numbered(subroots, "name"), "subroots"), bits)
    top = forest[-1].withColumns({"proof": F.array().cast(f"array<{_STEP}>"), "subroot": F.lit(""), "root": F.col("digest")})
    tops = _fallen(forest, top, bits).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "proof", "root")
    joined = passes[-1].join(tops, "tree")
    return _fallen(passes, joined, bits).drop("n", "place", "block")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf's digest and its proof."""
    step = lambda d, s: F.sha2(F.when(s["digest"].isNull(), d).when(s["left"], F.concat(s["digest"], d)).otherwise(F.concat(d, s["digest"])), 256)
    return F.aggregate(proof, leaf, step)


def dataset_manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, digest (of the leaf), proof, subroot and root of every document."""
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    return with_proofs(docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest")), "doc_id", bits=bits).drop("tree")


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = F.coalesce(F.concat(F.lit("+"), F.col("lang")), F.lit(""))
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    shown = F.when(tampered, leaf_digest(n_chars=F.col("n_chars") + 1)).otherwise(leaf_digest())
    leaves = docs.select(tree.alias("tree"), "doc_id", leaf_digest().alias("digest"), shown.alias("shown"))
    root = folded(F.col("shown"), F.col("proof"))
    found = with_proofs(leaves, "doc_id").withColumn("folded_root", root)
    beside = F.array_join(F.transform("proof", lambda s: s["digest"]), "")
    return found.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )
