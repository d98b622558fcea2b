"""Packing along a space-filling curve.

Each document's token ids give a hashed vector (counts of ids by residue), which a
fixed matrix of signs projects to four dimensions. Their standard scores, taken
over all documents, are cut to ten bits each and placed on a Hilbert curve; a hash
of the row fills the key's lower bits, so that copies spread over ranges. Rows are
dealt to ranges of the key with near-equal row counts, sorted within each, and laid
end to end: a range starts where the tokens of the ranges before it end, so every
sequence but the very last is full and neighbours on the curve share sequences.

Null and empty texts have the end token only. Repeated rows are packed each. Row
order among equal rows is open, and makes no difference. Only ids and texts are read.
"""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import chunks, mixed, starts_of, stored, table, texts_of
from pixledger.llm.tokens import encoder, id_type

SEQUENCE = 2048
END = 1
DIMENSIONS, BITS, BUCKETS = 4, 10, 64
_CHUNK = 1 << 20


def _signs() -> np.ndarray:
    cells = mixed(np.arange(1, BUCKETS * DIMENSIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(cells & np.uint64(1), 1.0, -1.0).reshape(BUCKETS, DIMENSIONS)


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of points with ``bits`` bits in each dimension, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & (q - 1)
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= np.where(on, 0, swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _tokenised(path: str):
    def rows(batches):
        signs = _signs()
        for batch in chunks(batches, "text", _CHUNK):
            texts = texts_of(batch)
            ids, counts = encoder(path).encode(texts)
            owner = np.repeat(np.arange(len(counts)), counts)
            hashed = np.bincount(owner * BUCKETS + ids % BUCKETS, minlength=len(counts) * BUCKETS).reshape(len(counts), BUCKETS)
            length = np.sqrt((hashed.astype(float) ** 2).sum(1, keepdims=True))
            projected = (hashed / np.maximum(length, 1)) @ signs
            ends = starts_of(counts)
            whole = np.insert(ids, ends[1:], END)
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(counts), [None, pa.py_buffer((ends + np.arange(len(ends))) * ids.itemsize), pa.py_buffer(whole)]
            ).cast(pa.binary())
            spread = [xxhash.xxh3_64_intdigest(b"%s:%d" % (str(i).encode(), n)) >> 1 for i, n in zip(batch.column("doc_id").to_pylist(), counts)]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1) * DIMENSIONS, pa.int32()), pa.array(projected.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts + 1), vectors, pa.array(spread, pa.int64()), data], ["doc_id", "n", "at", "spread", "ids"]
            )
        encoder(path).known.clear()  # the worker may serve other tasks next

    return rows


def _keys(batch: pa.RecordBatch, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    scores = (batch.column("at").flatten().to_numpy().reshape(-1, DIMENSIONS) - mean) / scale
    cells = np.clip((1 / (1 + np.exp(-np.clip(1.7 * scores, -30, 30)))) * (1 << BITS), 0, (1 << BITS) - 1)
    free = 62 - DIMENSIONS * BITS
    return (hilbert_key(cells) << free) | (batch.column("spread").to_numpy() >> (63 - free))


def _keyed(mean, scale, bounds=None):
    def rows(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = _keys(batch, mean, scale)
            out = {"key": pa.array(keys), "doc_id": batch.column("doc_id"), "n": batch.column("n")}
            if bounds is not None:
                out["part"] = pa.array(np.searchsorted(bounds, keys, side="right").astype(np.int32))
            if "ids" in batch.schema.names:
                out["ids"] = batch.column("ids")
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows


def _pieces(begins: dict[int, int], width: int, with_ids: bool):
    def rows(batches):
        part, at = None, 0
        for batch in chunks(batches, "ids", _CHUNK):
            out = {k: [] for k in ("row", "start", "length", "crc", "tokens", "sequence", "offset", "ids")}
            parts, sizes, blobs = batch.column("part").to_pylist(), batch.column("n").to_pylist(), batch.column("ids")
            for i, (p, n) in enumerate(zip(parts, sizes)):
                if p != part:
                    part, at = p, begins[p]
                ids = np.frombuffer(blobs[i].as_buffer(), np.dtype(f"<u{width}")).astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, SEQUENCE - at % SEQUENCE)
                    piece = ids[start : start + length].tobytes()
                    for name, value in zip(out, (i, start, length, zlib.crc32(piece), n, at // SEQUENCE, at % SEQUENCE, piece if with_ids else None)):
                        out[name].append(value)
                    start, at = start + length, at + length
            columns = [batch.column("doc_id").take(pa.array(out.pop("row"), pa.int64()))]
            blobs = out.pop("ids")
            columns += [pa.array(v, pa.int64()) for v in out.values()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows


def packed(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian unsigned 32-bit)."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    width = id_type(path).itemsize
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n long, at array<double>, spread long, ids binary"
    tokens = stored(docs.select("doc_id", "text").mapInArrow(_tokenised(path), schema), "tokens")
    stats = tokens.agg(*[f(F.element_at("at", i + 1)) for f in (F.avg, F.stddev_pop) for i in range(DIMENSIONS)], F.sum("n")).first()
    if stats[-1] is None:
        fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        return docs.sparkSession.createDataFrame([], fields + (", ids binary" if with_ids else ""))
    mean, scale = np.array(stats[:DIMENSIONS]), np.maximum(np.array(stats[DIMENSIONS:-1]), 1e-9)
    light = tokens.select("doc_id", "n", "at", "spread")
    ranges = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = light.mapInArrow(_keyed(mean, scale), f"key long, doc_id {kind}, n long")
    shares = [k / ranges for k in range(1, ranges)]
    bounds = np.array(cuts.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0], np.int64)
    sums = light.mapInArrow(_keyed(mean, scale, bounds), f"key long, doc_id {kind}, n long, part int").groupBy("part").agg(F.sum("n").alias("n")).collect()
    begins, at = {}, 0
    for row in sorted(sums):  # one row per range
        begins[row["part"]], at = at, at + row["n"]
    dealt = tokens.mapInArrow(_keyed(mean, scale, bounds), f"key long, doc_id {kind}, n long, part int, ids binary")
    ordered = dealt.repartition("part").sortWithinPartitions("part", "key", "doc_id", "n", F.crc32("ids"))
    fields = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ordered.mapInArrow(_pieces(begins, width, with_ids), fields + (", ids binary" if with_ids else ""))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), with_ids=False)
