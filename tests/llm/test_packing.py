import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from pixledger.llm.packing import END, SEQUENCE, hilbert_key, packed
from pixledger.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_the_tokenizers_own():
    rng = random.Random(5)
    letters = "ab'sdtrevlm  \n\t.,!0é² 　\U0001F600Ω͸"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["", "a<|endoftext|>b", "don't we'll 's x''s \n's"]
    ids, counts = encoder(PATH).encode(pa.array(texts, pa.large_string()))
    found = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert found == [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_hilbert_neighbours_touch():
    bits, dims = 2, 4
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
    keys = hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    ordered = cells[np.argsort(keys)]
    assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()


def test_pieces_cover_every_document(spark, documents, no_documents):
    rows = packed(documents).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = sorted(tuple(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [END]) for r in documents.select("text").collect())
    sequences = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        sequences[r["sequence_id"]].append((r["offset"], r["doc_id"], r["start"], r["doc_tokens"], ids))
    stream = []
    for s in sorted(sequences):
        at = 0
        for offset, *rest in sorted(sequences[s], key=lambda x: x[0]):
            assert offset == at
            at += len(rest[-1])
            stream.append(rest)
        assert at == SEQUENCE or s == max(sequences)
    found, open_ = [], []
    for _, start, total, ids in stream:
        assert start == len(open_)
        open_ += ids
        if len(open_) == total:
            found.append(tuple(open_))
            open_ = []
    assert sorted(found) == expected and not open_
    assert packed(no_documents).collect() == []
