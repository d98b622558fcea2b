"""Token ids of whole texts with a public byte-level BPE vocabulary, each distinct piece of a chunk encoded once.

The vocabulary's pattern cuts a text into pieces that cover it without gaps, so
the cuts of a whole chunk are found with array operations on its code points and
the pieces are encoded as a dictionary. Texts that hold a special token's string
or a code point unknown to this Python's Unicode tables go to the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata

import numpy as np
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from pixledger.llm.common import raw, starts_of

_OTHER, _LETTER, _NUMBER, _BLANK, _SPACE, _UNKNOWN = range(6)
#: The code points of Unicode's White_Space property.
_BLANKS = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern cuts off after an apostrophe.
_ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
_CACHED = 50_000


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.array([_UNKNOWN if (c := unicodedata.category(chr(i))) == "Cn" else kinds.get(c[0], _OTHER) for i in range(0x110000)], np.uint8)
    table[_BLANKS] = _BLANK
    table[32] = _SPACE
    return table


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; ``first`` marks the first of each text."""
    n = len(points)
    kind = _classes()[points]
    blank = (kind == _BLANK) | (kind == _SPACE)
    before, last = np.concatenate([[_OTHER], kind[:-1]]), np.concatenate([first[1:], [True]])
    after_blank = np.concatenate([[False], blank[:-1]])
    next_full = ~np.concatenate([blank[1:], [True]]) & ~last
    start = np.where(blank, ~after_blank | next_full, np.where(after_blank, before != _SPACE, kind != before)) | first
    marks = np.flatnonzero((points == 0x27) & start)
    ahead = np.concatenate([points, np.zeros(3, points.dtype)])
    end_of = np.searchsorted(np.flatnonzero(first), marks, side="right")
    ends = np.append(np.flatnonzero(first), n)[end_of]
    for ending in _ENDINGS:
        size = len(ending) + 1
        hit = marks + size <= ends
        for k, letter in enumerate(ending):
            hit &= ahead[marks + 1 + k] == ord(letter)
        for k in range(1, size):
            start[marks[hit] + k] = False
        follow = (marks + size)[hit & (marks + size < ends)]
        start[follow] = True
    return start


def _byte_symbols() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by the vocabulary file at ``path``."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        self.special = [t["content"] for t in held["added_tokens"]]
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in self.special}
        self.pieces = tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, np.ndarray] = {}
        self.kind = id_type(path).type

    def _piece(self, piece: bytes) -> np.ndarray:
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.pieces._core_bpe.encode_single_piece(piece), self.kind)
            if len(self.known) >= _CACHED:
                self.known.clear()
            self.known[piece] = found
        return found

    @functools.cached_property
    def exact(self) -> Tokenizer:
        """The tokenizer itself, made when a text needs it."""
        return Tokenizer.from_file(self.path)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and the number of each text's."""
        n = len(texts)
        data, offsets = raw(texts)
        if not data:
            return np.zeros(0, self.kind), np.zeros(n, np.int64)
        held = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((held & 0xC0) != 0x80)
        points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(points), bool)
        full = np.flatnonzero(np.diff(offsets))
        first[np.searchsorted(at, offsets[full])] = True
        cuts = np.append(at[piece_starts(points, first)], len(data)).astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
        codes = pieces.indices.to_numpy()
        encoded = [self._piece(p) for p in pieces.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        each = sizes[codes]
        begins = starts_of(each)
        from_ = starts_of(sizes)[codes] - begins[:-1]
        ids = np.concatenate(encoded)[np.repeat(from_, each) + np.arange(begins[-1])]
        owner = np.searchsorted(offsets[full], cuts[:-1], side="right") - 1
        counts = np.zeros(n, np.int64)
        counts[full] = np.bincount(owner, weights=each, minlength=len(full)).astype(np.int64)
        odd = self._odd(data, offsets, points, at)
        return self._replaced(ids, counts, texts, odd) if odd else (ids, counts)

    def _odd(self, data: bytes, offsets: np.ndarray, points: np.ndarray, at: np.ndarray) -> list[int]:
        """Texts that the pieces do not answer for."""
        places = at[np.flatnonzero(_classes()[points] == _UNKNOWN)].tolist()
        for special in map(str.encode, self.special):
            k = data.find(special)
            while k >= 0:
                places.append(k)
                k = data.find(special, k + 1)
        return np.unique(np.searchsorted(offsets, places, side="right") - 1).tolist() if places else []

    def _replaced(self, ids, counts, texts, odd):
        parts, starts = np.split(ids, np.cumsum(counts)[:-1]), counts.copy()
        for i, found in zip(odd, self.exact.encode_batch([texts[i].as_py() for i in odd], add_special_tokens=False)):
            parts[i] = np.array(found.ids, self.kind)
            starts[i] = len(parts[i])
        return np.concatenate(parts), starts


@functools.cache
def id_type(path: str) -> np.dtype:
    """The narrowest type that holds the ids of a vocabulary file; the tokenizer is not made."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    most = max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"])])
    return np.dtype(np.uint16 if most < 1 << 16 else np.uint32)


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)
