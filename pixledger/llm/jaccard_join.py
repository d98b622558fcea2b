"""N-gram Jaccard join with filters under several global token orders.

A document's set is its distinct five-word shingles, as 63-bit hashes. Two
documents link when their Jaccard similarity is 0.8 or more. If sets x and y
link, they share at least ``ceil(0.8 |x|)`` tokens, so under *any* global order
of tokens their prefixes of ``|x| - ceil(0.8 |x|) + 1`` tokens share one. Three
orders are used and a pair must pass all of them before it is verified:

1. by hash: a cheap first sieve that needs no counts. With the prefix longer by
   e tokens, 1 + e shared tokens are needed; few documents reach that.
2. by document frequency, rarest first, counted over all documents that passed
   the sieve (every partner of such a document passed too). Tokens that one
   text alone has lead the order and make no candidates.
3. by the magnitude of the frequency, then by a second hash.

Texts with equal sets are one node. In a group of near copies not all pairs are
tried: each token's documents are first held against its least edited ones, and
what is linked thus is one component. Afterwards only pairs across components
are tried, and all of those, so no link between components is missed.

Nulls and texts without words have empty sets and link with nothing. A row with a
null id keeps a null component unless its text equals another's. Repeated rows
and repeated ids are all kept and answered. Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import ascii_words, chunks, components, in_arrow, mixed, set_apart, starts_of, stored, table, texts_of, word_hashes

SHINGLE = 5
#: The similarity as a fraction, so that tests on counts are exact.
PART, WHOLE = 4, 5
#: The prefix under the hash order is longer by one token in so many.
EXTRA = 20
STAR_ROUNDS = 2
#: Size of the bitmap of suspects' ids that tasks hold; beyond a sixteenth as many ids a join finds their texts.
MARK_BITS = 1 << 26

_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, below 2**63."""
    words, counts = ascii_words(texts)
    hashes, starts = word_hashes(words), starts_of(counts)
    if len(hashes) >= SHINGLE:
        last = len(hashes) - SHINGLE + 1
        grams = sum((hashes[k : last + k] * _POWERS[k] for k in range(SHINGLE)), np.zeros(last, np.uint64))
        grams = mixed(grams) >> np.uint64(1)
    else:
        grams = np.zeros(0, np.uint64)
    out = []
    for i, n in enumerate(counts):
        if n >= SHINGLE:
            out.append(np.unique(grams[starts[i] : starts[i + 1] - SHINGLE + 1]))
        elif n:
            own = hashes[starts[i] : starts[i + 1]]
            whole = (own * _POWERS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(int(n) * 0x5851F42D4C957F2D % (1 << 64))
            out.append(mixed(whole) >> np.uint64(1))
        else:
            out.append(grams[:0])
    return out


def _needed(n: np.ndarray | int) -> np.ndarray | int:
    return -(-PART * n // WHOLE)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(starts_of([len(p) for p in parts]), pa.int32()), pa.array(values.astype(np.int64)))


def _sign(batches):
    """doc_id, set size, set digest and the prefix under the hash order, once per set and task."""
    seen: set[bytes] = set()
    for batch in chunks(batches, "text"):
        sets = shingle_sets(texts_of(batch))
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        prefixes = []
        for s, node in zip(sets, nodes):
            n = len(s)
            new = n and node not in seen
            if new:
                seen.add(node)
            prefixes.append(s[: n - _needed(n) + 1 + n // EXTRA] if new else s[:0])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary()), _lists(prefixes)],
            ["doc_id", "n", "node", "prefix"],
        )


def _marks(ids: DataFrame) -> np.ndarray | None:
    """A bitmap of hashed ids, ``MARK_BITS`` at most, or None where there are too many ids for it to sift."""
    if ids.count() > MARK_BITS // 16:
        return None
    place = f"pmod(xxhash64(doc_id), {MARK_BITS})"
    words = ids.select(F.expr(f"{place} div 64").alias("w"), F.expr(f"shiftleft(1L, CAST({place} % 64 AS INT))").alias("b"))
    out = np.zeros(MARK_BITS // 64, np.uint64)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).collect():  # MARK_BITS / 64 rows at most
        out[row["w"]] = row["b"] % (1 << 64)
    return out


def _as_they_are(batches):
    return batches


def _chosen_texts(read: DataFrame, ids: DataFrame, rows=_as_they_are, fields: str = "text string") -> DataFrame:
    """``rows`` over the texts of the documents with these ids; few others may be among them, which does no harm.

    Sifting and ``rows`` share one Python worker a task.
    """
    marks = _marks(ids)
    if marks is None:
        ids = ids.withColumnRenamed("doc_id", "chosen_id")  # null is an id like others here
        chosen = read.join(ids.hint("shuffle_hash"), read["doc_id"].eqNullSafe(ids["chosen_id"]), "left_semi").select("text")
        return in_arrow(chosen, rows, fields)

    def marked(batches):
        for batch in batches:
            place = batch.column("place").to_numpy().astype(np.uint64)
            here = (marks[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1)
            yield batch.filter(pa.array(here.astype(bool))).select(["text"])

    placed = read.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS)).alias("place"))
    return in_arrow(placed, lambda batches: rows(marked(batches)), fields)


def _sets(batches):
    for batch in chunks(batches, "text"):
        sets = [s for s in shingle_sets(texts_of(batch)) if len(s)]
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        last = [int(s[len(s) - _needed(len(s))]) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(last, pa.int64()), _lists(sets)],
            ["node", "n", "last", "tokens"],
        )


def _suspects(signed: DataFrame) -> DataFrame:
    """Nodes whose prefix under the hash order holds enough tokens that other nodes' prefixes hold too."""
    posts = signed.select("node", "n", F.explode("prefix").alias("token")).repartition("token")
    shared = posts.groupBy("token").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("token")
    hits = posts.join(shared.hint("shuffle_hash"), "token").select("node", "n", "token").distinct()
    return hits.groupBy("node").agg(F.count("*").alias("k"), F.first("n").alias("n")).where(f"k >= 1 + floor(n / {EXTRA})").select("node")


def _ordered(sets: DataFrame) -> DataFrame:
    """node, n, u (tokens no other has), the shared tokens, and the prefixes p1, p2, p3 under the three orders."""
    posts = sets.select("node", "n", "last", F.explode("tokens").alias("token")).repartition("token")
    often = posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    rows = posts.join(often.hint("shuffle_hash"), "token")
    kept = rows.groupBy("node").agg(
        F.first("n").alias("n"), F.first("last").alias("last"), F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ranked")
    )
    kept = kept.withColumn("u", F.col("n") - F.size("ranked")).withColumn("p", F.expr(f"n - ceil({PART} * n / {WHOLE}) + 1 - u")).where("p > 0")
    third = F.sort_array(F.transform("ranked", lambda x: F.struct(F.floor(F.log2(x["df"])).alias("g"), F.xxhash64(x["token"], F.lit(3)).alias("h"), x["token"].alias("token"))))
    return kept.select(
        "node", "n", "u",
        F.expr("ranked.token").alias("tokens"),
        F.expr("filter(ranked.token, t -> t <= last)").alias("p1"),
        F.expr("slice(ranked.token, 1, CAST(p AS INT))").alias("p2"),
        F.slice(third["token"], 1, F.col("p").cast("int")).alias("p3"),
    )


def _may_link() -> str:
    """Bounds on the shared tokens of rows x and y that meet at places x.pos and y.pos of their prefixes."""
    need = f"ceil({PART} * (x.n + y.n) / {PART + WHOLE})"
    return (
        f"x.node <> y.node AND {WHOLE} * least(x.n, y.n) >= {PART} * greatest(x.n, y.n)"
        f" AND least(x.n - x.u, y.n - y.u) >= {need} AND 1 + least(x.n - x.pos, y.n - y.pos) >= {need}"
    )


def _as_pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _star_pairs(posts: DataFrame, turn: int) -> DataFrame:
    """Each token's rows against one of them: the least edited, in later turns one by hash."""
    key = F.struct(
        (F.col("u") / F.col("n") if turn == 0 else F.lit(0.0)).alias("k"),
        F.xxhash64("node", "token", F.lit(turn)).alias("h"), "node", "n", "u", "pos", "root",
    )
    best = posts.groupBy("token").agg(F.min(key).alias("c"), F.count("*").alias("m")).where("m > 1").select("token", "c.*")
    return _as_pairs(posts.alias("y").join(best.alias("x"), F.expr(f"x.token = y.token AND x.root <> y.root AND {_may_link()}")))


def _cross_pairs(posts: DataFrame) -> DataFrame:
    """All pairs of a token's rows that lie in different components.

    Rows of a token's largest component are never paired with each other.
    """
    sizes = posts.groupBy("token", "root").agg(F.count("*").alias("m"))
    most = sizes.groupBy("token").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.count("*").alias("roots"), F.sum("m").alias("all"))
    open_ = posts.join(most.where("roots > 1"), "token")
    rest, every = open_.where("root <> main").alias("x"), open_.alias("y")
    return _as_pairs(rest.join(every, F.expr(f"x.token = y.token AND x.root <> y.root AND {_may_link()}")))


def _verified(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share prefix tokens under the other orders too and are similar enough, exactly."""
    x = nodes.select(F.col("node").alias("a"), F.struct("n", "tokens", "p1", "p3").alias("x"))
    y = nodes.select(F.col("node").alias("b"), F.struct("n", "tokens", "p1", "p3").alias("y"))
    met = pairs.join(x, "a").join(y, "b").where("arrays_overlap(x.p1, y.p1) AND arrays_overlap(x.p3, y.p3)")
    common = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return met.where((PART + WHOLE) * common >= PART * (F.col("x.n") + F.col("y.n"))).select("a", "b")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node) per document, and links (a, b) between nodes that connect each component.

    Two nodes are in one component of these links exactly if they are in one of
    all links; links inside a component already known are not all listed.
    """
    read = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    signed = stored(in_arrow(read, _sign, f"doc_id {id_type}, n long, node binary, prefix array<bigint>"), "signed")
    suspects = stored(_suspects(signed), "suspects")
    chosen = signed.join(suspects.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    sets = _chosen_texts(read, stored(chosen, "chosen"), _sets, "node binary, n long, last long, tokens array<bigint>").dropDuplicates(["node"])
    nodes = stored(_ordered(stored(sets, "sets")), "ordered")
    posts = nodes.select("node", "n", "u", F.posexplode("p2").alias("at", "token")).select("token", "node", "n", "u", (F.col("u") + F.col("at") + 1).alias("pos"))
    edges = None
    rooted = posts.withColumn("root", F.col("node"))
    for turn in range(STAR_ROUNDS):
        found = stored(_verified(_star_pairs(rooted, turn), nodes), "links")
        edges = found if edges is None else edges.union(found)
        roots = components(edges)
        rooted = posts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted, "rooted")
    return signed.select("doc_id", "n", "node"), edges.union(stored(_verified(_cross_pairs(rooted), nodes), "links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links reach, own id included."""
    signed, edges = links(docs)
    roots = components(edges)
    rooted = signed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return rooted.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; of rows with that id and unequal texts, all."""
    keep = jaccard_components(docs).where("doc_id <=> component_id").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")


def _noded(batches):
    for batch in chunks(batches, "text"):
        sets = shingle_sets(texts_of(batch))
        nodes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(nodes, pa.binary())], ["doc_id", "key", "node"])


def one_row_per_group(docs: DataFrame) -> DataFrame:
    """One row of each component: that of the smallest id (nulls last), among rows of that id the one whose text's digest is smallest.

    Texts without words link with nothing; of their rows, one of each id and text stays.
    """
    apart = set_apart(docs, "doc_id", "text").withColumn("row_key", F.sha2(F.col("text").cast("binary"), 256))
    _, edges = links(docs)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    read = apart.select("doc_id", "text", F.col("row_key").alias("key"))
    rows = in_arrow(read, _noded, f"doc_id {id_type}, key string, node binary").distinct()
    rooted = rows.join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    alone = F.when(F.col("root").isNull(), F.struct("doc_id", "key"))
    least = rooted.groupBy("root", alone.alias("alone")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("c"))
    keep = stored(least.select(F.col("c.doc_id").alias("keep_id"), F.col("c.key").alias("keep_key")), "kept")
    once = apart.dropDuplicates(["doc_id", "row_key"])  # copies are dropped before the shuffle, in each task
    match = once["doc_id"].eqNullSafe(keep["keep_id"]) & once["row_key"].eqNullSafe(keep["keep_key"])
    return once.join(keep, match, "left_semi").drop("row_key").toDF(*docs.columns)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
