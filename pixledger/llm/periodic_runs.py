"""Runs of periodically repeated words, by recursive frequency splitting and a lag scan.

A run is a stretch of consecutive words ``[^\\x20\\x09-\\x0D]+`` of a text with smallest period q whose
length is ``max(SHORTEST, REPEATS * q)`` or more and that no neighbouring word extends keeping
period q. Every word of a run stands in it ``REPEATS`` times at least. So a word that stands more rarely in
its current segment belongs to no run there and splits the segment; counting goes on in the
smaller segments until none splits. All texts of a chunk split side by side.

Segments that survive are scanned by lags: words q apart are compared for every q up to a
``REPEATS``-th of the length. Short segments are compared whole, all together. In a segment of
more than ``LONG`` words each lag first compares every q-th word (n/q comparisons, so n log n for all
lags): a run has two whole neighbouring blocks of q words that equal their next ones. Only where such
a pair passes a few such combs, and no run with a divisor of q is known already, are all words compared.
A stretch found at several lags is a run of the smallest.

A null text counts as empty; empty texts have no runs. Rows are judged one by one: repeated rows
get equal answers, null ids are kept, a text is never cut. Only the id and text columns are read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixledger.llm.common import chunks, mixed, starts_of, table, texts_of
from pixledger.llm.repeats import SpanHashes, joined_words, split_words

SHORTEST = 6
REPEATS = 4
LONG = 2048


def surviving(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the segments left when words too rare in their segment have split it, again and again."""
    at = np.arange(len(ids))
    segment = np.repeat(np.arange(len(counts)), counts)
    kinds = int(ids.max()) + 1 if len(ids) else 1
    while len(at):
        _, place, often = np.unique(segment * kinds + ids[at], return_inverse=True, return_counts=True)
        stays = often[place] >= REPEATS
        whole = stays.all()
        at, segment = at[stays], segment[stays]
        if not len(at):
            break
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(segment) != 0)])
        segment = np.cumsum(new) - 1
        size = np.bincount(segment)
        if whole and (size >= SHORTEST).all():
            first = np.flatnonzero(new)
            return at[first], size
        full = size[segment] >= SHORTEST
        at, segment = at[full], segment[full]
    return np.zeros(0, np.int64), np.zeros(0, np.int64)


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the stretches of True that are ``least`` long or longer."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    start, size = edge[::2], edge[1::2] - edge[::2]
    return start[size >= least], size[size >= least]


def _equal_for(q: int) -> int:
    """How many words in a row must equal those q further on."""
    return max(SHORTEST - q, (REPEATS - 1) * q)


def scan_short(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, lag) of all periodic stretches of the segments, compared side by side, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    ends = starts_of(sizes)
    segment = np.repeat(np.arange(len(sizes)), sizes)
    at = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
    words, out = ids[at], []
    for q in range(1, int(sizes[0]) // REPEATS + 1 if len(sizes) else 1):
        n = ends[np.searchsorted(-sizes, -REPEATS * q, side="right")]
        same = (words[: n - q] == words[q:n]) & (segment[: n - q] == segment[q:n])
        for s, k in zip(*_stretches(same, _equal_for(q))):
            out.append((int(at[s]), int(k) + q, q))
    return out


def scan_long(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, lag) of the periodic stretches of one segment but those known at a divisor of the lag."""
    n, hashes = len(words), SpanHashes(mixed(words.astype(np.uint64) + np.uint64(1)))
    known: dict[int, tuple[list[int], list[int]]] = {}  # starts and ends by period, ascending: such runs overlap by less than the period
    for q in range(1, n // REPEATS + 1):
        blocks = hashes.blocks(q)
        same = blocks[1:] == blocks[:-1]
        paired = np.flatnonzero(same[1:] & same[:-1])
        if not len(paired):
            continue
        for group in np.split(paired, np.flatnonzero(np.diff(paired) > 1) + 1):
            low, high = int(group[0]) * q, int(group[-1] + 3) * q
            if any(q % p == 0 and (i := bisect_right(starts, low)) and ends[i - 1] >= high for p, (starts, ends) in known.items()):
                continue
            low, high = max(0, low - q), min(n, high + q)
            start, size = _stretches(words[low : high - q] == words[low + q : high], _equal_for(q))
            for s, k in zip(start.tolist(), size.tolist()):
                starts, ends = known.setdefault(q, ([], []))
                starts.append(low + s)
                ends.append(low + s + k + q)
    return [(s, e - s, q) for q, runs in known.items() for s, e in zip(*runs)]


def find_runs(ids: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period; ``ids`` are the texts' words end to end as numbers."""
    starts, sizes = surviving(ids, counts)
    long = sizes > LONG
    found = scan_short(ids, starts[~long], sizes[~long])
    for a, n in zip(starts[long].tolist(), sizes[long].tolist()):
        found += [(a + s, k, q) for s, k, q in scan_long(ids[a : a + n])]
    least: dict[tuple[int, int], int] = {}
    for s, k, q in found:
        least[s, k] = min(q, least.get((s, k), q))
    bounds = starts_of(counts)
    out: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    for (s, k), q in least.items():
        text = int(np.searchsorted(bounds, s, side="right")) - 1
        out[text].append((s - int(bounds[text]), k, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _searched(id_type: pa.DataType):
    def rows(batches):
        for batch in chunks(batches, "text"):
            words, counts = split_words(texts_of(batch))
            runs = find_runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), counts)
            keep, starts = np.ones(len(words), bool), starts_of(counts)
            for i, found in enumerate(runs):
                for s, k, q in found:
                    keep[starts[i] + s + q : starts[i] + s + k] = False
            kept = joined_words(words, counts, keep).cast(pa.string())
            listed = pa.array([[{"start": s, "length": k, "period": q} for s, k, q in found] for found in runs], _RUNS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_type), listed, kept], ["doc_id", "runs", "collapsed"])

    return rows


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period) and collapsed: the words outside every run's later periods, joined by a space."""
    kind = docs.schema["doc_id"].dataType
    fields = f"doc_id {kind.simpleString()}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(_searched(to_arrow_type(kind)), fields)


def strongest(runs: Column) -> Column:
    """The run of greatest length / period, null if there is none; of equal ones the first, then the one of smallest period."""
    best = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, best, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in every tenth text by crc32 of the id the words from some place on become a repetition of those first there.

    With h the crc32 of the decimal id and g = h div 10, word i >= a = g % n becomes word a + (i - a) % p,
    p = 1 + (n - a) div (3 + g % 8). Other texts, and those of null ids, stay as they are.
    """
    kind = docs.schema["doc_id"].dataType

    def edited(batches):
        for batch in chunks(batches, "text"):
            words, counts = split_words(texts_of(batch))
            starts, take = starts_of(counts), np.arange(len(words))
            crc = batch.column("crc").to_pylist()
            for i, n in enumerate(counts.tolist()):
                if n and crc[i] is not None and crc[i] % 10 == 0:
                    g = crc[i] // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    take[starts[i] + a : starts[i + 1]] = starts[i] + a + np.arange(n - a) % p
            text = joined_words(words.take(pa.array(take)), counts, np.ones(len(words), bool))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text.cast(pa.string())], ["doc_id", "text"])

    read = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("crc"))
    return read.mapInArrow(edited, f"doc_id {kind.simpleString()}, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_repeats(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
