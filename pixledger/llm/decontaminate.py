"""Benchmark decontamination with an FM-index per training shard.

A shard is a bounded chunk of documents inside a Spark task. Its words become
one sequence with a separator of its own after each document; the suffix order
gives the Burrows-Wheeler transform, a wavelet matrix over it answers ranks, and
every sixteenth position is kept to locate rows. Benchmark windows (ten words;
a shorter item is one window) are searched backwards, all at once, and the rows
found are walked back to kept positions. Overlapping occurrences merge to spans.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one
broadcast per block; a larger benchmark takes more passes, each of which adds
its spans and items to the rows.

Words: A-Z lowered, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Null and empty
texts have no words. Null items of the benchmark have no windows; items with equal
windows are all named. Repeated rows are answered each. A null item id is left out
of the item list though its windows count. Other columns pass through.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import chunks, in_arrow, raw, set_apart, starts_of, stored, table, texts_of, words_by

WINDOW = 10
BLOCK_BYTES = 4 << 20
SAMPLED = 16
SHARD_BYTES = 2 << 20

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TO_WORDS = bytes(b if _WORD_BYTES[b] else 0x20 for b in bytes(range(256)).lower())


def words_of(data: bytes, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    return words_by(data, offsets, _TO_WORDS)


def word_ends(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the start and end of every word, in the order of ``words_of``."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD_BYTES[np.frombuffer(data.translate(_TO_WORDS), np.uint8)]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]  # words do not run on into the next text
    starts[cut] = inside[cut + 1]
    ends[cut - 1] = inside[cut]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Positions by suffix; every document's separator is a symbol of its own, so that ties end there."""
    n = len(sequence)
    width = max(1, int(sequence.max()).bit_length()) if n else 1
    depth = max(1, 62 // width)
    key, padded = np.zeros(n, np.int64), np.concatenate([sequence, np.zeros(depth, np.int64)])
    for k in range(depth):
        key = (key << width) | padded[k : n + k]

    def ranked(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        return rank

    rank = ranked(key)
    bits = max(1, n.bit_length())
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            break
        ahead = open_ + depth
        key = (rank[open_] << bits) | np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(key)
        key, at = key[order], open_[order]
        own = rank[at]
        place = np.arange(len(at))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), place, 0))
        sub = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), place, 0))
        rank[at] = own + sub - group
        depth *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order


class WaveletMatrix:
    """Rank of a symbol in a prefix of a sequence, for many queries at once."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        current = sequence
        for level in range(bits - 1, -1, -1):
            bit = ((current >> level) & 1).astype(bool)
            ones = np.zeros(len(current) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(current) - int(ones[-1]))
            current = np.concatenate([current[~bit], current[bit]])

    def rank(self, symbols: np.ndarray, until: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low, high = np.zeros(len(symbols), np.int64), until.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbols >> (self.bits - 1 - k)) & 1).astype(bool)
            l1, h1 = ones[low], ones[high]
            low = np.where(one, zeros + l1, low - l1)
            high = np.where(one, zeros + h1, high - h1)
        return high - low


class FMIndex:
    """Backward search and location over a sequence of symbols from 1 up."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        order = suffix_order(sequence)
        self.bwt = sequence[order - 1]
        self.before = starts_of(np.bincount(sequence, minlength=n_symbols + 1))
        self.ranks = WaveletMatrix(self.bwt, max(1, int(n_symbols).bit_length()))
        kept = order % SAMPLED == 0
        self.kept = kept
        self.kept_before = starts_of(kept)
        self.kept_at = order[kept]
        self.n = len(sequence)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row range of each phrase; phrases of one length are the rows of a matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbols = column[alive]
            low[alive] = self.before[symbols] + self.ranks.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.ranks.rank(symbols, high[alive])
            alive = alive[low[alive] < high[alive]]
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The sequence position of each row, walked back to a kept one."""
        out, steps = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        alive, rows = np.arange(len(rows)), rows.copy()
        while len(alive):
            at = rows[alive]
            here = self.kept[at]
            out[alive[here]] = self.kept_at[self.kept_before[at[here]]] + steps[alive[here]]
            alive, at = alive[~here], at[~here]
            symbols = self.bwt[at]
            rows[alive] = self.before[symbols] + self.ranks.rank(symbols, at)
            steps[alive] += 1
        return out


def windows_of(items: list[tuple[str | None, str | None]]) -> tuple[pa.Array, dict[int, tuple[np.ndarray, list[list[str]]]]]:
    """The words of a block of items, and by window length the distinct windows over them with the items that have each."""
    texts = pa.array([text or "" for _, text in items], pa.large_string())
    words, counts = words_of(*raw(texts))
    coded = words.dictionary_encode()
    codes, starts = coded.indices.to_numpy(), starts_of(counts)
    found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
    for (item, _), start, n in zip(items, starts, counts):
        length = min(int(n), WINDOW)
        for k in range(start, start + n - length + 1) if length else ():
            found[length][tuple(codes[k : k + length].tolist())].update([] if item is None else [item])
    return coded.dictionary, {m: (np.array(list(x), np.int64), [sorted(v) for v in x.values()]) for m, x in found.items()}


def occurrences(words: pa.Array, counts: np.ndarray, vocabulary: pa.Array, windows: dict) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
    """Word ranges (start, end) of a shard that windows fill, and the items found in each of its documents."""
    coded = words.dictionary_encode()
    n_docs, starts = len(counts), starts_of(counts)
    there = pc.index_in(vocabulary, coded.dictionary)
    if there.null_count == len(there):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), {}
    known = pc.fill_null(there, -1).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(n_docs), counts)
    sequence = np.empty(len(words) + n_docs, np.int64)
    sequence[np.arange(len(words)) + owner] = coded.indices.to_numpy() + n_docs + 1
    sequence[starts[1:] + np.arange(n_docs)] = np.arange(1, n_docs + 1)
    index = FMIndex(sequence, len(coded.dictionary) + n_docs)
    begins, ends, items = [], [], defaultdict(set)
    for length, (phrases, names) in windows.items():
        symbols = known[phrases]
        some = np.flatnonzero((symbols >= 0).all(1))
        low, high = index.search(symbols[some] + n_docs + 1)
        times = high - low
        phrase = np.repeat(some, times)
        rows = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)
        at = index.locate(rows)
        document = np.searchsorted(starts[:-1] + np.arange(n_docs), at, side="right") - 1
        begins.append(at - document)
        ends.append(at - document + length)
        for code in np.unique(document * len(names) + phrase).tolist():
            items[code // len(names)].update(names[code % len(names)])
    return np.concatenate(begins), np.concatenate(ends), items


def _covered(begins: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    change = np.bincount(begins, minlength=n + 1) - np.bincount(ends, minlength=n + 1)
    return np.cumsum(change)[:n] > 0


def _spans(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of True inside each text, as word places (start, end)."""
    padded = np.concatenate([[False], mask, [False]])
    first, last = padded[1:-1] & ~padded[:-2], padded[1:-1] & ~padded[2:]
    cut = starts[(starts > 0) & (starts < len(mask))]
    first[cut] = mask[cut]
    last[cut - 1] = mask[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _searched(vocabulary: pa.Array, windows: dict, cut: bool):
    def found(batches):
        for batch in chunks(batches, "text", SHARD_BYTES):
            data, offsets = raw(texts_of(batch))
            words, counts = words_of(data, offsets)
            starts = starts_of(counts)
            begins, ends, items = occurrences(words, counts, vocabulary, windows)
            mask = _covered(begins, ends, len(words))
            shift = starts[pc.list_parent_indices(batch.column("bench_from")).to_numpy()]
            mask |= _covered(*(batch.column(c).flatten().to_numpy() + shift for c in ("bench_from", "bench_to")), len(words))
            first, last = _spans(mask, starts)
            document = np.searchsorted(starts, first, side="right") - 1
            at = pa.array(starts_of(np.bincount(document, minlength=len(counts))), pa.int32())
            earlier = batch.column("bench_items").to_pylist()
            named = [sorted(items.get(i, set()).union(old)) for i, old in enumerate(earlier)]
            new = {
                "bench_words": pa.array(counts),
                "bench_from": pa.ListArray.from_arrays(at, pa.array((first - starts[document]).astype(np.int64))),
                "bench_to": pa.ListArray.from_arrays(at, pa.array((last - starts[document]).astype(np.int64))),
                "bench_items": pa.array(named, pa.list_(pa.string())),
            }
            out = pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], batch.schema.names)
            yield from _cut([out]) if cut else (out,)

    return found


def contamination(docs: DataFrame, benchmark: DataFrame, cut: bool = False) -> DataFrame:
    """``docs`` with bench_words (the word count), bench_from and bench_to (word spans filled by windows) and bench_items.

    With ``cut`` the spans are taken out of the texts once all blocks are searched.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // (BLOCK_BYTES // 2)) if size > BLOCK_BYTES else 1
    out = docs.withColumns(
        {"bench_words": F.lit(0).cast("long"), "bench_from": F.array().cast("array<long>"), "bench_to": F.array().cast("array<long>"), "bench_items": F.array().cast("array<string>")}
    )
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES at most
        vocabulary, windows = windows_of([(r["item_id"], r["text"]) for r in rows])
        out = in_arrow(out, _searched(vocabulary, windows, cut and block + 1 == blocks), out.schema)
        if block + 1 < blocks:
            out = stored(out, "contamination")
    return out


def _cut(batches):
    for batch in chunks(batches, "text"):
        data, offsets = raw(texts_of(batch))
        begin, end = word_ends(data, offsets)
        words = np.searchsorted(begin, offsets)
        texts = batch.column("text").to_pylist()
        froms, tos = batch.column("bench_from").to_pylist(), batch.column("bench_to").to_pylist()
        for i, (spans, ends) in enumerate(zip(froms, tos)):
            if spans:
                parts, at = [], offsets[i]
                for a, b in zip(spans, ends):
                    parts.append(data[at : begin[words[i] + a]])
                    at = end[words[i] + b - 1]
                texts[i] = b"".join([*parts, data[at : offsets[i + 1]]]).decode()
        yield batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the benchmark spans in their texts; ``n_chars`` follows the text where there is one."""
    apart = set_apart(docs, "text", "n_chars")
    out = contamination(apart, benchmark, cut=True)
    if "n_chars" in docs.columns:
        count = F.when(F.size("bench_from") > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(apart.columns).toDF(*docs.columns)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.arrays_zip("bench_from", "bench_to"), F.lit(0).cast("long"), lambda n, x: n + x["bench_to"] - x["bench_from"])
    joined = F.array_join(F.sort_array("bench_items"), ",")
    return found.select(
        "doc_id", F.col("bench_words").alias("n_words"), hit.alias("n_hit"), F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.size("bench_from") > 0).alias("contaminated"),
    )
