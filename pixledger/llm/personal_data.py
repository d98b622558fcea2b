"""Personal data: fixed patterns, and a skip-chain conditional random field that adds spans.

The field's nodes are the tokens that hold a digit or an ``@``; all others are observed
as outside, which separates the chain there. Neighbouring nodes share a chain
potential; each occurrence of a token (stripped of punctuation) or of a digit string
shares a skip potential with the next occurrence of it in the document, however
far. Node potentials come from hashed features: the token's shape and its neighbours',
Luhn's test, address parts, digit counts. Weights maximise the pseudo-likelihood of
the fixed patterns' own matches in a sample of at most about ``SAMPLE`` documents.
Damped loopy messages give each node's label; runs of nodes with one label and at
least ``SURE`` belief that touch no fixed span are added.

Null text counts as empty and has no spans. Equal rows get equal spans. Without
any match in the sample nothing is added. Texts are processed whole, and runs of
one character do not slow the patterns (they never rescan a run). Offsets count code
points, the end is exclusive. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import chunks, table, texts_of

KINDS = ["email", "ip", "card", "phone"]
SAMPLE = 3_000
SURE = 0.9
ROUNDS, DAMP = 12, 0.3
WIDTH = 512
_LABELS = len(KINDS) + 1
_OUT = len(KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_MARK = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` with the local part that reaches back to the last match at most."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15]
    return sorted(out)


def _shape(token: str) -> str:
    kinds = re.sub(r"[^\W\d_]+", "a", _DIGITS.sub(lambda m: f"9{min(len(m[0]), 20)};", token))
    return kinds[:40]


def _features(words: list[str], k: int) -> list[int]:
    token = words[k].strip("\"'<>[]{},;:!?")
    token = token.rstrip(".") if not token.startswith(".") else token
    digits = "".join(_DIGITS.findall(token))
    parts = token.split(".")
    near = [_shape(words[j].strip("\"'<>[]{},;:!?.")) if 0 <= j < len(words) else "" for j in (k - 1, k + 1)]
    marked = [bool(_MARK.search(s)) for s in near]
    names = [
        "bias", f"shape={_shape(token)}", f"digits={min(len(digits), 20)}", f"letters={token.strip('0123456789') != ''}", f"at={'@' in token}", f"dots={min(token.count('.'), 4)}",
        f"luhn={12 <= len(digits) <= 19 and digits == token.replace('-', '') and luhn(digits)}",
        f"address={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"plus={token.startswith('+')}", f"before={near[0] if marked[0] else marked[0]}", f"after={near[1] if marked[1] else marked[1]}",
    ]
    return [xxhash.xxh3_64_intdigest(n) % WIDTH for n in names]


def graph(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of a text: spans (start, end), features, chain edges and skip edges (earlier, later)."""
    spans, words = [], []
    for m in _TOKEN.finditer(text):
        spans.append(m.span())
        words.append(m[0])
    nodes = [k for k, w in enumerate(words) if _MARK.search(w)]
    rows = [_features(words, k) for k in nodes]
    chain = [(i - 1, i) for i in range(1, len(nodes)) if nodes[i] == nodes[i - 1] + 1]
    last: dict[str, int] = {}
    skip = []
    for i, k in enumerate(nodes):
        digits = "".join(_DIGITS.findall(words[k]))
        keys = {words[k].strip("\"'<>[]{}(),;:!?.").lower()} | ({digits} if len(digits) >= 6 else set())
        for key in keys:
            if key in last and last[key] != i:
                skip.append((last[key], i))
            last[key] = i
    pairs = lambda x: np.array(sorted(set(x)), np.int64).reshape(-1, 2)
    width = len(rows[0]) if rows else 11
    return np.array([spans[k] for k in nodes], np.int64).reshape(-1, 2), np.array(rows, np.int64).reshape(-1, width), pairs(chain), pairs(skip)


def _soft(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(-1, keepdims=True))
    return raised / raised.sum(-1, keepdims=True)


def fit(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> dict:
    """Weights of largest pseudo-likelihood, by Adam."""
    hot = np.eye(_LABELS)[labels]
    shapes = [(WIDTH, _LABELS), (_LABELS, _LABELS), (_LABELS, _LABELS)]
    weights = [np.zeros(s) for s in shapes]
    first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    for t in range(1, steps + 1):
        node, link, same = weights
        logits = node[features].sum(1)
        np.add.at(logits, chain[:, 1], link[labels[chain[:, 0]]])
        np.add.at(logits, chain[:, 0], link[:, labels[chain[:, 1]]].T)
        for a, b in ((0, 1), (1, 0)):
            np.add.at(logits, skip[:, b], same[labels[skip[:, a]]])
        wrong = (_soft(logits) - hot) / len(labels)
        grads = [np.zeros(s) for s in shapes]
        np.add.at(grads[0], features, wrong[:, None, :])
        grads[1] = hot[chain[:, 0]].T @ wrong[chain[:, 1]] + wrong[chain[:, 0]].T @ hot[chain[:, 1]]
        grads[2] = hot[skip[:, 0]].T @ wrong[skip[:, 1]] + hot[skip[:, 1]].T @ wrong[skip[:, 0]]
        grads[2] = (grads[2] + grads[2].T) / 2
        for k, g in enumerate(grads):
            g = g + ridge * weights[k] / len(labels) ** 0.5
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {"node": weights[0], "chain": weights[1], "skip": weights[2]}


def beliefs(model: dict, features: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Label beliefs of the nodes after damped loopy sum-product messages."""
    unary = model["node"][features].sum(1)
    edges = np.concatenate([chain, skip])
    if not len(edges):
        return _soft(unary)
    forward = np.concatenate([np.broadcast_to(model["chain"], (len(chain), _LABELS, _LABELS)), np.broadcast_to(model["skip"], (len(skip), _LABELS, _LABELS))])
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
    back = np.roll(np.arange(2 * len(edges)), len(edges))
    messages = np.zeros((2 * len(edges), _LABELS))
    for _ in range(rounds):
        belief = unary.copy()
        np.add.at(belief, target, messages)
        open_ = (belief[source] - messages[back])[:, :, None] + potential
        top = open_.max(1)
        new = top + np.log(np.exp(open_ - top[:, None, :]).sum(1))
        messages = DAMP * messages + (1 - DAMP) * (new - new.max(1, keepdims=True))
    belief = unary.copy()
    np.add.at(belief, target, messages)
    return _soft(belief)


def added_spans(model: dict, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the field that touch no base span."""
    spans, features, chain, skip = graph(text)
    if not len(spans):
        return []
    found = beliefs(model, features, chain, skip)
    labels = np.where(found.max(1) >= SURE, found.argmax(1), _OUT)
    joined = {int(b) for a, b in chain if labels[a] == labels[b] and labels[b] != _OUT}
    out: list[list[int]] = []
    for i in np.flatnonzero(labels != _OUT).tolist():
        if i in joined:
            out[-1][2] = int(spans[i, 1])
        else:
            out.append([int(spans[i, 0]), int(labels[i]), int(spans[i, 1])])
    kept = []
    for start, kind, end in out:
        while end > start and not (text[end - 1].isalnum()):
            end -= 1
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        if start < end and not any(a < end and b > start for a, _, b in base):
            kept.append((start, kind, end))
    return kept


def _labels(spans: np.ndarray, base: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind of the base span that covers half of a node or more."""
    out = np.full(len(spans), _OUT, np.int64)
    for start, kind, end in base:
        shared = np.minimum(spans[:, 1], end) - np.maximum(spans[:, 0], start)
        out[2 * shared >= spans[:, 1] - spans[:, 0]] = kind
    return out


def _marked(texts: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring_regex(texts, "[0-9@]").to_numpy(zero_copy_only=False))


def train(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model of a sample of documents with marks; None where no fixed pattern matches."""
    held = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    total = held.count()
    share = int(min(1.0, sample / max(total, 1)) * 1_000_000)
    chosen = held.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share).distinct()

    def nodes(batches):
        for batch in batches:
            for text in batch.column("text").to_pylist():
                spans, features, chain, skip = graph(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x.ravel().tolist()], pa.list_(pa.int64())) for x in (features, _labels(spans, base_spans(text)), chain, skip)], ["features", "labels", "chain", "skip"]
                )

    rows = chosen.mapInArrow(nodes, ", ".join(f"{n} array<long>" for n in ("features", "labels", "chain", "skip"))).collect()
    rows = sorted(rows)  # the same order on every run
    labels = [np.array(r["labels"], np.int64) for r in rows if r["labels"]]
    if not labels or all((x == _OUT).all() for x in labels):
        return None
    begins = np.cumsum([0, *map(len, labels)])[:-1]
    rows = [r for r in rows if r["labels"]]
    stacked = lambda name: np.concatenate([np.array(r[name], np.int64).reshape(-1, 2) + b for r, b in zip(rows, begins)])
    features = np.concatenate([np.array(r["features"], np.int64).reshape(len(x), -1) for r, x in zip(rows, labels)])
    return fit(features, np.concatenate(labels), stacked("chain"), stacked("skip"))


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))


def personal_data(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, base and spans of every row: sorted arrays of (start, kind, end)."""

    def found(batches):
        for batch in chunks(batches, "text"):
            texts = texts_of(batch)
            base, spans = [[] for _ in range(len(texts))], [[] for _ in range(len(texts))]
            for i in _marked(texts).tolist():
                text = texts[i].as_py()
                own = base_spans(text)
                more = added_spans(model, text, own) if model else []
                base[i], spans[i] = own, sorted(own + more)
            told = lambda rows: pa.array([[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in row] for row in rows], _SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), told(base), told(spans)], ["doc_id", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    span = "array<struct<start:long,kind:string,end:long>>"
    return docs.select("doc_id", "text").mapInArrow(found, f"doc_id {kind}, base {span}, spans {span}")


def _written(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, train(docs))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(_written("base").cast("binary"), 256).alias("base_sha256"), _written("spans").alias("spans"))
