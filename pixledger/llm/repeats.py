"""Removal of passages that earlier documents hold too, by Rabin-Karp hashes of every window of words.

A window is ``WINDOW`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one text. The hash of any span of words is a
polynomial in the words' hashes, taken for all windows of a chunk from one array of prefix sums. Spark
counts the hashes over all documents: each window's smallest document id, combined in the tasks before
the shuffle, so that a passage of very many documents sends one row a task. Windows that also start in a
document with a smaller id go back to their documents (Spark splits hot windows in that join), where
overlapping and touching ones merge into maximal intervals of words to remove.

Most windows stand in one document alone. So that these need not be shuffled, each window has an anchor: the
smallest hash among its spans of half its length. Equal windows have equal anchors, and neighbouring
windows mostly share one, so there are about 13 times fewer. Anchors are counted first; then every window
whose anchor another document holds too. Nothing that can repeat is left out.

Every window is judged on the input. Windows are compared by 64-bit hashes; among 10**9 different
ones a false match of any two is expected 0.03 times.

A null text counts as empty; empty texts and texts of fewer words than a window lose nothing. Rows
with a null id lose nothing and take nothing from others, as no id is smaller. Repeated rows get equal
answers, and rows of one id take nothing from each other; an id's texts are told apart by a hash of the
text. Only the id and text columns are read; other columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixledger.llm.common import chunks, mixed, raw, set_apart, starts_of, stored, table, texts_of, word_hashes, words_by

WINDOW = 50
#: Odd, so that it has an inverse modulo 2**64; 5 modulo 8, so that its powers repeat late.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_SAME = bytes(range(256))


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, unchanged, and each text's word count."""
    return words_by(*raw(texts), _SAME)


def joined_words(words: pa.Array, counts: np.ndarray, keep: np.ndarray) -> pa.Array:
    """Each text's words that ``keep`` marks, joined by one space."""
    starts, kept = starts_of(counts), np.concatenate([[0], np.cumsum(keep)])
    lists = pa.LargeListArray.from_arrays(pa.array(kept[starts], pa.int64()), words.filter(pa.array(keep)))
    return pc.binary_join(lists, pa.scalar(" ", words.type))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class SpanHashes:
    """Rabin-Karp hashes of any spans of a sequence of 64-bit word hashes, from one array of prefix sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(BASE, len(hashes)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(hashes) + 1)

    def at(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[starts + size] - self.sums[starts]) * self.back[starts]

    def blocks(self, size: int) -> np.ndarray:
        """The spans of ``size`` end to end from the first word on."""
        edges = self.sums[::size]
        return (edges[1:] - edges[:-1]) * self.back[::size][: len(edges) - 1]


def window_hashes(hashes: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every window of ``size`` words, in order, and each text's number of windows."""
    n = np.maximum(counts - size + 1, 0)
    at = np.repeat(starts_of(counts)[:-1] - starts_of(n)[:-1], n) + np.arange(n.sum())
    return mixed(SpanHashes(hashes).at(at, size)), n


def anchors(hashes: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """The anchor of every window of ``size`` words: the smallest hash of its spans of half as many words."""
    half = size // 2
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    least = mixed(SpanHashes(hashes).at(np.arange(len(hashes) - half + 1), half))
    wide, reach = size - half + 1, 1
    while reach < wide:  # minima over ``reach`` neighbouring spans, doubled until they span a window
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    n = np.maximum(counts - size + 1, 0)
    return least[np.repeat(starts_of(counts)[:-1] - starts_of(n)[:-1], n) + np.arange(n.sum())]


def _rows(batch: pa.RecordBatch, name: str, values: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    owners = pa.array(owner)
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), batch.column("doc_id").take(owners), batch.column("mark").take(owners)], [name, "doc_id", "mark"])


def _anchored(size: int):
    def rows(batches):
        for batch in chunks(batches, "text"):
            words, counts = split_words(texts_of(batch))
            found = anchors(word_hashes(words), counts, size)
            owner = np.repeat(np.arange(len(counts)), np.maximum(counts - size + 1, 0))
            new = np.concatenate([[True], (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])])[: len(found)]
            yield _rows(batch, "anchor", found[new], owner[new])

    return rows


def _windowed(size: int):
    """The windows whose anchor is among the document's shared ones."""

    def rows(batches):
        for batch in chunks(batches, "text"):
            words, counts = split_words(texts_of(batch))
            hashes = word_hashes(words)
            windows, n = window_hashes(hashes, counts, size)
            found, at = anchors(hashes, counts, size), starts_of(n)
            shared = batch.column("anchors")
            kept = [np.flatnonzero(np.isin(found[at[i] : at[i + 1]], shared[i].values.to_numpy().view(np.uint64))) + at[i] for i in range(len(n))]
            owner = np.repeat(np.arange(len(n)), [len(k) for k in kept])
            yield _rows(batch, "window", windows[np.concatenate(kept)] if kept else windows, owner)

    return rows


def covered(hit: np.ndarray, n_words: int, size: int) -> list[tuple[int, int]]:
    """The maximal intervals [start, end) of words that windows starting where ``hit`` cover."""
    at = np.flatnonzero(hit)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    return list(zip(first.tolist(), np.minimum(last + size, n_words).tolist()))


def _marked(size: int, types: list[pa.DataType], names: list[str]):
    def rows(batches):
        for batch in chunks(batches, "text"):
            words, counts = split_words(texts_of(batch))
            hashes, n = window_hashes(word_hashes(words), counts, size)
            starts, at = starts_of(counts), starts_of(n)
            repeats, spans, keep = batch.column("windows"), [], np.ones(len(words), bool)
            for i in range(batch.num_rows):
                found = repeats[i].values.to_numpy().view(np.uint64) if repeats[i].is_valid else hashes[:0]
                spans.append(covered(np.isin(hashes[at[i] : at[i + 1]], found), int(counts[i]), size) if len(found) else [])
                for a, b in spans[-1]:
                    keep[starts[i] + a : starts[i] + b] = False
            kept = joined_words(words, counts, keep)
            columns = [*(batch.column(c) for c in names), pa.array(counts, pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], types[-2]), kept.cast(types[-1])]
            yield pa.RecordBatch.from_arrays(columns, [*names, "n_words", "spans", "kept"])

    return rows


_SPANS = "array<struct<start:bigint,end:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _met(posts: DataFrame, key: str, chosen: Column) -> DataFrame:
    """doc_id, mark and the ``chosen`` of those keys that documents of different ids hold."""
    seen = posts.groupBy(key).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    several = stored(seen.where("least < most").select(key, "least"), f"{key}-counts")
    met = posts.join(several.hint("shuffle_hash"), key).where(chosen)
    return met.groupBy("doc_id", "mark").agg(F.collect_set(key).alias(f"{key}s"))


def _with_repeats(docs: DataFrame, size: int) -> DataFrame:
    """All columns of ``docs`` (id and text as named, none clashing), n_words, spans and kept."""
    read = docs.select("doc_id", "text", F.xxhash64("text").alias("mark")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    fields = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark bigint"
    posts = stored(read.mapInArrow(_anchored(size), f"anchor bigint, {fields}"), "anchor-posts")
    suspects = stored(_met(posts, "anchor", F.lit(True)), "anchors")
    posts = stored(read.join(suspects, ["doc_id", "mark"]).mapInArrow(_windowed(size), f"window bigint, {fields}"), "window-posts")
    hits = stored(_met(posts, "window", F.col("doc_id") > F.col("least")), "windows")
    joined = docs.withColumn("mark", F.xxhash64("text")).join(hits, ["doc_id", "mark"], "left")
    names = docs.columns
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"n_words bigint, spans {_SPANS}, kept string"])
    types = [*(to_arrow_type(f.dataType) for f in docs.schema.fields), pa.int64(), _SPANS_ARROW, pa.string()]
    return joined.select(*names, "windows").mapInArrow(_marked(size, types, names), fields)


def repeated_spans(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start and end of each stretch of words to remove) and kept (the other words, joined by a space)."""
    return _with_repeats(docs.select("doc_id", "text"), size).select("doc_id", "n_words", "spans", "kept")


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``; a text that loses passages becomes its other words, joined by a space."""
    apart = set_apart(docs, "doc_id", "text")
    found = _with_repeats(apart, size)
    text = F.when(F.size("spans") > 0, F.col("kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*apart.columns).toDF(*docs.columns)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
