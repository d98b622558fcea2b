"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled 1; unlabelled web text is a sample of
all documents outside the held-out fold; documents labelled 0 are never used.
The class prior (the share of good text in the unlabelled) comes from the best
bin: for a positive-against-unlabelled score, the smallest ratio of the
unlabelled to the positive share above any threshold, with a margin for chance.
A linear model then minimises the non-negative unbiased risk
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))`` with the logistic loss;
where the bracket is negative, its gradient is turned round.

Features describe form, not topic or language: frequencies of pairs of
character classes, and ratios of words, lines and lengths. They are computed in
bounded Arrow chunks of whole texts. The prior is a statistic of the corpus: its scores
come from all unlabelled documents outside the held-out fold that the first fit did not see, as one
histogram of ``BINS`` bins. At most about ``SAMPLE`` positives and as many unlabelled rows, drawn by a
hash of the id, reach the driver for the two fits; every document is scored.

A null text counts as empty; empty texts get a score as well. Repeated rows
get equal scores. An id is a positive if any of its label rows says 1. Without
any positive, every score is 0.5. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import ascii_words, chunks, in_arrow, raw, table, texts_of

SAMPLE = 10_000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
#: Bins of the first model's scores from which the class prior is taken.
BINS = 4096

#: Character classes of bytes; bytes of 128 and more belong to letters.
_CLASSES = ["\n", " \t\r\x0b\x0c", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "#$%&*", "|", "\"'`", "()[]{}<>", "-_~=+", "@/\\^"]
_K = len(_CLASSES) + 2
_CLASS_OF = np.full(256, _K - 1, np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _chars]] = _i
_CLASS_OF[128:] = _CLASSES.index("abcdefghijklmnopqrstuvwxyz")
_CLASS_OF[:9] = _CLASS_OF[14:32] = _CLASS_OF[127] = _K - 2
N_FEATURES = _K * _K + 6


def features(texts: pa.Array) -> np.ndarray:
    """One row of features per text; all zero but for the last for an empty one."""
    n = len(texts)
    data, offsets = raw(texts)
    data = np.frombuffer(data, np.uint8)
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(n), sizes)
    kind = _CLASS_OF[data]
    pairs = np.zeros((n, _K * _K))
    if len(data) > 1:
        code = (owner[1:] * _K + kind[:-1]) * _K + kind[1:]
        pairs = np.bincount(code[owner[1:] == owner[:-1]], minlength=n * _K * _K).reshape(n, -1).astype(float)
    words, counts = ascii_words(texts)
    coded = words.dictionary_encode()
    distinct = np.zeros(n)
    if len(words):
        key = np.repeat(np.arange(n), counts) * (len(coded.dictionary) + 1) + coded.indices.to_numpy()
        distinct = np.bincount(np.unique(key) // (len(coded.dictionary) + 1), minlength=n)
    lines = np.bincount(owner[data == 10], minlength=n) + 1
    full, some = np.maximum(sizes, 1), np.maximum(counts, 1)
    extra = np.stack(
        [np.sqrt(distinct / some), (distinct / some < 0.3) * (counts > 30), np.log1p(sizes / some), np.log1p(some / lines), np.minimum(counts, 20) / 20, np.ones(n)], 1
    )
    extra[sizes == 0, :-1] = 0
    return np.hstack([np.sqrt(pairs / full[:, None]), extra]).astype(np.float32)


def _described(batches):
    for batch in chunks(batches, "text"):
        rows = features(texts_of(batch))
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("apart"), values], ["apart", "features"])


def _fetched(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the rows, and which are kept apart from the first fit; as Arrow, since lists of Python floats take ten times the memory."""
    found = in_arrow(df, _described, "apart boolean, features array<float>").toArrow()
    rows = found.column("features").combine_chunks().flatten().to_numpy().reshape(-1, N_FEATURES)
    return rows, found.column("apart").to_numpy()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def _descend(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Adam from zero; ``gradient(w)`` of the risk."""
    w, m, v = np.zeros((3, size), np.float32)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + np.float32(1e-8))
    return w


def bins_of(at: np.ndarray) -> np.ndarray:
    """Bins of logits, 0 to ``BINS`` - 1."""
    return np.minimum((_sigmoid(at) * BINS).astype(np.int64), BINS - 1)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, chance: float = 0.05) -> float:
    """The best bin's share of positives among the unlabelled, from histograms over ``BINS`` bins of rows not trained on."""
    n_p, n_u = positive.sum(), unlabelled.sum()
    if min(n_p, n_u) <= 10:
        return 0.5
    above_p, above_u = (np.concatenate([np.cumsum(h[::-1])[::-1], [0]]) / h.sum() for h in (positive, unlabelled))
    cuts = np.flatnonzero((above_p >= 0.1) & (above_p <= 0.98))
    if not len(cuts):
        cuts = np.flatnonzero(above_p > 0)[-1:]
    margin = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(n_p) + 1 / np.sqrt(n_u))
    best = cuts[np.argmin((above_u[cuts] + margin) / above_p[cuts])]
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def contrast(positive: np.ndarray, unlabelled: np.ndarray, apart_p: np.ndarray, apart_u: np.ndarray, rate: float = 0.05) -> dict:
    """Mean, scale and weights of a first model that tells positives from unlabelled rows, fitted on the rows not ``apart``."""
    both = np.vstack([positive, unlabelled])
    mean, scale = both.mean(0), both.std(0) + 1e-3
    mean[-1], scale[-1] = 0, 1
    model = {"mean": mean, "scale": scale}
    p, u = (standardised(model, rows[~apart] if (~apart).any() else rows) for rows, apart in ((positive, apart_p), (unlabelled, apart_u)))

    def against(w):
        return (_sigmoid(p @ w) - 1) @ p / len(p) + _sigmoid(u @ w) @ u / len(u) + 0.01 * w

    return model | {"weights": _descend(against, p.shape[1], 200, rate)}


def risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: ``prior`` times that of the positives, and that of the negatives, which can fall below 0."""
    good, bad = np.logaddexp(0, -(p @ w)).mean(), np.logaddexp(0, p @ w).mean()
    return prior * good, np.logaddexp(0, u @ w).mean() - prior * bad


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient of the non-negative risk; where the negatives' part is below 0, the way back up for it alone."""
    at_p, at_u = p @ w, u @ w
    good, bad = (_sigmoid(at_p) - 1) @ p / len(p), _sigmoid(at_p) @ p / len(p)
    rest = np.logaddexp(0, at_u).mean() - prior * np.logaddexp(0, at_p).mean()
    rest_g = _sigmoid(at_u) @ u / len(u) - prior * bad
    return prior * good + rest_g if rest >= 0 else -rest_g


def fit(first: dict, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, ridge: float = 1e-4) -> dict:
    """The model that minimises the non-negative risk under ``prior``, with the mean and scale of ``first``."""
    p, u = standardised(first, positive), standardised(first, unlabelled)
    weights = _descend(lambda w: risk_gradient(w, p, u, prior) + ridge * w, p.shape[1], steps, rate)
    return first | {"weights": weights, "prior": prior}


def standardised(model: dict, rows: np.ndarray) -> np.ndarray:
    return np.clip((rows - model["mean"]) / model["scale"], -6, 6)


def scores(model: dict | None, rows: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(rows), 0.5)
    return _sigmoid(standardised(model, rows) @ model["weights"])


def _drawn(total: int, most: int, seed: int):
    """Whether an id is among about ``most`` of ``total``, by its hash."""
    share = min(1.0, most / max(total, 1))
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)


def _histogram(first: dict):
    def counted(batches):
        total = np.zeros(BINS, np.int64)
        for batch in chunks(batches, "text"):
            total += np.bincount(bins_of(standardised(first, features(texts_of(batch))) @ first["weights"]), minlength=BINS)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(total[full])], ["bin", "n"])

    return counted


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fit on positives and unlabelled rows outside the held-out fold; the prior is taken over all of these."""
    read = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull() & ~_held_out())
    read = read.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0)
    known = labels.where("quality = 1").select("doc_id").where(F.col("doc_id").isNotNull() & ~_held_out()).distinct()
    chosen = F.broadcast(known.where(_drawn(known.count(), sample, 1)))  # about ``sample`` ids
    positive, apart_p = _fetched(read.join(chosen, "doc_id", "left_semi"))
    if not len(positive):
        return None
    drawn = _drawn(read.count(), sample, 2)
    unlabelled, apart_u = _fetched(read.where(drawn))
    first = contrast(positive, unlabelled, apart_p, apart_u)
    unseen = in_arrow(read.where(~drawn | F.col("apart")).select("text"), _histogram(first), "bin int, n bigint")
    counts = np.zeros(BINS, np.int64)
    for row in unseen.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row a bin
        counts[row["bin"]] = row["n"]
    seen = bins_of(standardised(first, positive[apart_p]) @ first["weights"])
    return fit(first, positive, unlabelled, class_prior(np.bincount(seen, minlength=BINS), counts))


def _held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of every row of ``docs``."""

    def scored(batches):
        for batch in chunks(batches, "text"):
            found = scores(model, features(texts_of(batch))).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_arrow(docs.select("doc_id", "text"), scored, f"doc_id {kind}, score double")


def good_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more; all columns, no shuffle."""
    model = train(docs, labels)

    def kept(batches):
        for batch in chunks(batches, "text"):
            yield batch.filter(pa.array(scores(model, features(texts_of(batch))) >= threshold))

    return in_arrow(docs, kept, docs.schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(_held_out(), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
