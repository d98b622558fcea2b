"""Helpers shared by the text operators: bounded Arrow chunks, words, hashes, stored tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pixledger.session import shared_dir

CHUNK_BYTES = 1 << 20
#: Rows that Spark hands to a Python worker at once; its default lets a batch of long texts take tens of MB on either side.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written below the shared checkpoint folder and read again: cuts the lineage, survives lost executors.

    The shuffle files behind it are no longer needed then; Spark removes them
    once the driver's garbage is collected, so that is asked for.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterable[pa.RecordBatch]], fields: str | StructType) -> DataFrame:
    """``mapInArrow`` on batches of at most ``BATCH_ROWS`` rows; the session keeps that bound."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_KEY)) <= BATCH_ROWS:
        conf.set(_BATCH_KEY, BATCH_ROWS)
    return df.mapInArrow(rows, fields)


def set_apart(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with all columns but ``names`` called by their place, so that no added column can clash with them."""
    return docs.toDF(*[c if c in names else f"kept_{i}" for i, c in enumerate(docs.columns)])


def chunks(batches: Iterable[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
            pa.default_memory_pool().release_unused()  # workers outlive their tasks


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column as large strings, null as empty."""
    return pc.fill_null(batch.column(column).cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and each text's offset with the end of the last."""
    n = len(texts)
    if not n:
        return b"", np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    return (data[int(offsets[0]) : int(offsets[-1])].to_pybytes() if data else b""), offsets - offsets[0]


def words_by(data: bytes, offsets: np.ndarray, translate: bytes) -> tuple[pa.Array, np.ndarray]:
    """All words of texts after a byte translation that maps what separates words to white space; each text's word count."""
    texts = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(data.translate(translate)))
    split = pc.ascii_split_whitespace(texts)
    flat, owner = split.flatten(), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(full), owner.filter(full).to_numpy()
    return flat, np.bincount(owner, minlength=len(texts))


_LOWER = bytes(range(256)).lower()


def ascii_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z lowered, and each text's word count."""
    return words_by(*raw(texts), _LOWER)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash per word; each distinct word of the chunk is hashed once."""
    if not len(words):
        return np.zeros(0, np.uint64)
    coded = words.dictionary_encode()
    values = coded.dictionary.to_pylist()
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values), np.uint64, len(values))
    return hashed[coded.indices.to_numpy()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit integers whose every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def starts_of(counts: np.ndarray) -> np.ndarray:
    """Offsets of groups laid end to end, with the end of the last."""
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges`` (a, b) to (node, root): the smallest node of each connected component.

    Alternates joining every node's larger neighbours, then its smaller ones,
    to the smallest; each round's edges go to checkpoint files. Hubs are
    aggregated before the shuffle and joined by AQE's skew split.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "components"))
    edges = edges.select("a", "b").where("a <> b").distinct()
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.union(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
