"""Document fingerprints from prefix polynomial hashes.

For a chunk of texts one array holds, at every code point, the sum of all code
points before it times powers of a base, modulo a prime. Any two spans are compared
in constant time by shifting both differences to the same power, and the longest
common extension of two places is found by binary search over span lengths.

A fingerprint is written as hex: the text's length, two whole-text hashes (two
bases), and a sketch of ``SLOTS`` bins. Every span of ``SPAN`` code points, hashed from
the prefix array, falls into a bin by its hash and the smallest in a bin counts;
empty bins stay marked. The likeness of two fingerprints is the share of equal bins
among those filled in either; equal whole-text hashes make it 1.

Null text counts as empty; two empty texts have likeness 1, an empty and a full one
0. Texts shorter than a span have one span, the text. ``neighbour_edits`` pairs each
row with the next in descending order of id, null ids last; rows of one id are
ordered by text, and the last row's next is the first. Other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pixledger.llm.common import chunks, mixed, raw, table

PRIME = (1 << 31) - 1
BASES = (911_382_323, 972_663_749)
SPAN = 12
SLOTS = 64
_EMPTY = 0xFFFF
#: Bytes of text at once; each takes about a hundred times as many in arrays.
_CHUNK = 1 << 19
_POWERS_KEPT = 1 << 21


@functools.lru_cache(4)
def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo the prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), PRIME) % PRIME])
    return out[:n]


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(_POWERS_KEPT, 1 << int(n).bit_length()))[:n]


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' code points end to end and each text's first place, with the end of the last."""
    data, offsets = raw(texts)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return points, before[offsets]


class PrefixHashes:
    """Hashes of every prefix of a sequence of code points (fewer than 2**32 of them)."""

    def __init__(self, points: np.ndarray, base: int = BASES[0]):
        self.base = base
        self.power = powers(base, len(points) + 1)
        self.sums = np.concatenate([[0], np.cumsum((points + 1) * self.power[:-1] % PRIME)]) % PRIME

    def raised(self, start: np.ndarray, end: np.ndarray, to: np.ndarray | int) -> np.ndarray:
        """Hash of [start, end) as if it started at place ``to``, which is not before ``start``."""
        return (self.sums[end] - self.sums[start]) % PRIME * self.power[np.asarray(to) - start] % PRIME

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` at a and at b are equal (up to collisions of the hash)."""
        to = np.maximum(a, b)
        return self.raised(a, a + length, to) == self.raised(b, b + length, to)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Longest common extensions, at most ``most`` long, by binary search for all pairs at once."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64).copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(a, b, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


def sketches(hashes: PrefixHashes, starts: np.ndarray) -> np.ndarray:
    """For each text the bins' smallest span hashes, 16 bits each; ``starts`` are the texts' first places with the end."""
    sizes = np.diff(starts)
    n_texts, total = len(sizes), int(starts[-1])
    owner = np.repeat(np.arange(n_texts), sizes)
    place = np.arange(total)
    end = np.minimum(place + SPAN, starts[1:][owner])
    whole = (end - place == SPAN) | (place == starts[:-1][owner])
    place, end, owner = place[whole], end[whole], owner[whole]
    inverse = powers(pow(BASES[0], PRIME - 2, PRIME), total)
    value = mixed(((hashes.sums[end] - hashes.sums[place]) % PRIME * inverse[place] % PRIME).astype(np.uint64) + np.uint64(1))
    slot = (value >> np.uint64(58)).astype(np.int64)
    rank = ((value >> np.uint64(20)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    least = np.full(n_texts * SLOTS, 1 << 32, np.int64)
    np.minimum.at(least, owner * SLOTS + slot, rank)
    return np.where(least < 1 << 32, (least * 2_654_435_761 >> 16) % _EMPTY, _EMPTY).reshape(n_texts, SLOTS).astype(np.uint16)


def fingerprints(points: np.ndarray, starts: np.ndarray) -> tuple[list[str], PrefixHashes]:
    """A fingerprint of each text, and the prefix hashes of all."""
    first, second = PrefixHashes(points), PrefixHashes(points, BASES[1])
    bins = sketches(first, starts)
    a, b = starts[:-1], starts[1:]
    shifted = [(h.sums[b] - h.sums[a]) % PRIME * powers(pow(h.base, PRIME - 2, PRIME), int(starts[-1]) + 1)[a] % PRIME for h in (first, second)]
    rows = bins.astype(">u2").tobytes().hex()
    width = SLOTS * 4
    out = [f"{n:x}-{x:08x}{y:08x}-{rows[i * width : (i + 1) * width]}" for i, (n, x, y) in enumerate(zip((b - a).tolist(), shifted[0].tolist(), shifted[1].tolist()))]
    return out, first


def likeness(a: str, b: str) -> float:
    """Share of equal bins of two fingerprints, 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rsplit("-", 1)[1]), ">u2") for f in (a, b))
    return float(_alike(x[None], y[None])[0])


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    filled = (x != _EMPTY) | (y != _EMPTY)
    return ((x == y) & filled).sum(1) / np.maximum(filled.sum(1), 1)


def _bins(prints: list[str]) -> np.ndarray:
    joined = "".join(p.rsplit("-", 1)[1] for p in prints)
    return np.frombuffer(bytes.fromhex(joined), ">u2").reshape(-1, SLOTS)


def _alikes(a: list[str], b: list[str]) -> np.ndarray:
    equal = np.fromiter((x == y for x, y in zip(a, b)), bool, len(a))
    return np.where(equal, 1.0, _alike(_bins(a), _bins(b)))


def _described(ids: list, texts: list[str]) -> list[list]:
    """Columns for all texts but the last, which is only the next of the one before."""
    edited = [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(texts, texts[1:])]
    points, starts = code_points(pa.array([*texts, *edited], pa.large_string()))
    prints, hashes = fingerprints(points, starts)
    n = len(edited)
    own, new = starts[:n], starts[n + 1 : -1]
    sizes = np.diff(starts)
    shared = hashes.common(own, new, np.minimum(sizes[:n], sizes[n + 1 :]))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    return [ids[:n], sizes[:n].tolist(), sha, prints[:n], prints[n + 1 :], _alikes(prints[:n], prints[n + 1 :]).tolist(), _alikes(prints[:n], prints[1 : n + 1]).tolist(), shared.tolist()]


_FIELDS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix"]


def _paired(id_type: pa.DataType):
    types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def rows(batches):
        """Rows come by (part, place); a row with own = 0 is the first of the next part and only ends this one."""
        part, held, done = None, None, True
        for batch in chunks(batches, "text", _CHUNK):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            parts, owns = batch.column("part").to_pylist(), batch.column("own").to_pylist()
            at = 0
            while at < len(ids):
                stop = at
                while stop < len(ids) and parts[stop] == parts[at] and owns[stop]:
                    stop += 1
                if parts[at] != part:
                    part, held, done = parts[at], None, False
                ends = stop < len(ids) and parts[stop] == part and not owns[stop]
                if not done:
                    own_ids, own_texts = ids[at : stop + ends], texts[at : stop + ends]
                    if held is not None:
                        own_ids, own_texts = [held[0], *own_ids], [held[1], *own_texts]
                    if len(own_texts) > 1:
                        columns = _described(own_ids, own_texts)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _FIELDS)
                    if own_texts:
                        held = (own_ids[-1], own_texts[-1])
                    done = ends
                at = stop + 1 if stop < len(ids) and not owns[stop] else stop

    return rows


def neighbour_edits(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its text with the later half taken from the next document's start, and likenesses.

    Rows are dealt to ranges of ids by quantiles. The first row of each range is
    also sent to the range before, so that only one pass shuffles texts. One
    bound per range reaches the driver.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    read = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    place = F.coalesce(-F.col("doc_id").cast("double"), F.lit(float("inf")))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(place.alias("place"))
    shares = [k / ranges for k in range(1, ranges)]
    found = ids.where("place < double('inf')").agg(F.percentile_approx("place", shares, 20 * ranges)).first()[0] or []
    bounds = np.unique(np.array(found, float))

    def part_of(batches):
        for batch in batches:
            parts = np.searchsorted(bounds, batch.column("place").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(parts), batch.column("place")], ["part", "place"])

    firsts = ids.mapInArrow(part_of, "part int, place double").groupBy("part").agg(F.min("place").alias("place")).collect()
    firsts = sorted((r["part"], r["place"]) for r in firsts)  # one row per range
    before = {p: firsts[k - 1][0] if k else firsts[-1][0] for k, (p, _) in enumerate(firsts)}
    heads = dict(firsts)

    def dealt(batches):
        for batch in chunks(batches, "text"):
            places = batch.column("place").to_numpy()
            parts = np.searchsorted(bounds, places, side="right")
            ahead = np.flatnonzero(places == np.array([heads.get(p, np.nan) for p in parts.tolist()]))
            rows = np.concatenate([np.arange(len(parts)), ahead])
            to = np.concatenate([parts, [before[p] for p in parts[ahead].tolist()]]).astype(np.int32)
            own = np.concatenate([np.ones(len(parts), np.int32), np.zeros(len(ahead), np.int32)])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(own), taken.column("place"), taken.column("doc_id"), taken.column("text")], ["part", "own", "place", "doc_id", "text"])

    id_name = kind.simpleString()
    moved = read.withColumn("place", place).mapInArrow(dealt, f"part int, own int, place double, doc_id {id_name}, text string")
    ordered = moved.repartition("part").sortWithinPartitions("part", F.desc("own"), "place", F.desc("doc_id"), "text")
    fields = f"doc_id {id_name}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    return ordered.mapInArrow(_paired(to_arrow_type(kind)), fields)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_edits(table(spark, sf_dir, "documents"))
