"""Language identification of whole texts, with spans of mixed languages.

Scripts narrow the candidates: a word written in a script is scored only for
languages whose training text uses that script enough. Each word's score under a
language is the log-likelihood of its padded letter trigrams (hashed to a fixed
table, counted over *all* training documents) with its length held in bounds, and
Viterbi's path over a text's words, with a penalty for each switch, labels every
word. The language with the most letters on the path is the text's; its share of
letters is the score. Runs of one label are the spans.

Words are runs of letters, lower-cased. A null text or one without a letter is ``und``
with score 0 and no spans. Without training text every text is ``und``. Ties go to the
language first in order of names. Repeated rows are answered each. Only the columns
doc_id, text and (for training) lang are read.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import chunks, mixed, raw, starts_of, table, texts_of

FOLDS, HELD_OUT = 4, 2
TABLE_BITS = 16
#: Log-likelihood ratio (in nats) that one switch of language costs.
SWITCH = 12.0
#: The most that one word may speak for one language against another.
WORD_BOUND = 6.0
#: A script belongs to a language that writes at least this share of its letters in it.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"
#: Bytes of text decoded side by side; Viterbi takes one array step per word of the longest text among them.
_CHUNK = 4 << 20

#: First and last code points of script ranges; letters outside belong to the last class.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)],
    "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)],
    "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x9FFF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "other": [],
}
_OTHER = len(SCRIPTS) - 1


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, its script, its lower case."""
    every = range(0x110000)
    letter = np.array([unicodedata.category(chr(i))[0] == "L" for i in every])
    script = np.full(len(every), _OTHER, np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            script[first : last + 1] = k
    lower = np.arange(len(every), dtype=np.uint32)
    for i in np.flatnonzero(letter):
        one = chr(i).lower()
        if len(one) == 1:
            lower[i] = ord(one)
    return letter, script, lower


def letters_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """Trigram codes of a chunk's letters and the words they belong to.

    grams and gram_word; for each word: text, script, letters, first and last code point place in its text.
    """
    letter, script, lower = _tables()
    data, offsets = raw(texts)
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    before = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    text_starts = before[offsets]
    is_letter = letter[points]
    first = is_letter & ~np.concatenate([[False], is_letter[:-1]])
    cut = text_starts[(text_starts < len(points))]
    first[cut] |= is_letter[cut]
    at = np.flatnonzero(is_letter)
    word = np.cumsum(first)[at] - 1
    begin = np.flatnonzero(first)
    sizes = np.bincount(word, minlength=len(begin))
    low = lower[points[at]].astype(np.uint64)
    same1 = np.concatenate([[False], word[1:] == word[:-1]])
    same2 = np.concatenate([[False, False], word[2:] == word[:-2]]) if len(word) > 1 else np.zeros(len(word), bool)
    one = np.where(same1, np.roll(low, 1), np.uint64(1))
    two = np.where(same2, np.roll(low, 2), np.uint64(1))
    inner = (two << np.uint64(42)) | (one << np.uint64(21)) | low
    ends = starts_of(sizes)[1:] - 1
    closing = (one[ends] << np.uint64(42)) | (low[ends] << np.uint64(21)) | np.uint64(2)
    grams = mixed(np.concatenate([inner, closing])) >> np.uint64(64 - TABLE_BITS)
    text = np.searchsorted(text_starts, begin, side="right") - 1
    kinds = script[points[at]]
    of_word = np.zeros(len(begin), np.int64)
    if len(at):
        of_word = np.where(np.maximum.reduceat(kinds, starts_of(sizes)[:-1]) == np.minimum.reduceat(kinds, starts_of(sizes)[:-1]), kinds[starts_of(sizes)[:-1]], _OTHER)
    return {
        "grams": grams.astype(np.int64), "gram_word": np.concatenate([word, np.arange(len(begin))]), "text": text,
        "script": of_word, "letters": sizes, "first": begin - text_starts[text], "last": begin + sizes - text_starts[text],
    }


def _counted(batches):
    """Trigram and script counts by language of one task."""
    grams, scripts = {}, {}
    for batch in chunks(batches, "text", _CHUNK):
        found = letters_of(texts_of(batch))
        langs = np.array(batch.column("lang").to_pylist(), object)
        of_word = langs[found["text"]]
        of_gram = of_word[found["gram_word"]]
        for lang in set(langs):
            grams[lang] = grams.get(lang, 0) + np.bincount(found["grams"][of_gram == lang], minlength=1 << TABLE_BITS)
            own = of_word == lang
            scripts[lang] = scripts.get(lang, 0) + np.bincount(found["script"][own], weights=found["letters"][own], minlength=len(SCRIPTS))
    for lang, counts in grams.items():
        full = np.flatnonzero(counts)
        cells = np.concatenate([full, (1 << TABLE_BITS) + np.flatnonzero(scripts[lang])])
        values = np.concatenate([counts[full], scripts[lang][scripts[lang] > 0].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells), pa.string()), pa.array(cells), pa.array(values)], ["lang", "cell", "n"])


def train(docs: DataFrame) -> dict | None:
    """Counts over all of ``docs`` with a language: log-likelihoods of hashed trigrams, and the scripts of each language.

    The model holds one fixed-size table per language.
    """
    read = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = read.mapInArrow(_counted, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(counts["lang"].unique())
    if not names:
        return None
    full = np.zeros((len(names), (1 << TABLE_BITS) + len(SCRIPTS)))
    for k, name in enumerate(names):
        own = counts[counts["lang"] == name]
        full[k, own["cell"].to_numpy()] = own["n"].to_numpy()
    grams, scripts = full[:, : 1 << TABLE_BITS], full[:, 1 << TABLE_BITS :]
    logs = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * (1 << TABLE_BITS)))
    return {"names": names, "logs": np.ascontiguousarray(logs.T.astype(np.float32)), "scripts": scripts / np.maximum(scripts.sum(1, keepdims=True), 1) >= SCRIPT_SHARE}


def word_scores(model: dict, found: dict) -> np.ndarray:
    """Each word's log-likelihood under each language relative to the best one, within bounds."""
    n, langs = len(found["letters"]), len(model["names"])
    each = model["logs"][found["grams"]]
    scores = np.stack([np.bincount(found["gram_word"], weights=each[:, k], minlength=n) for k in range(langs)], 1)
    allowed = model["scripts"].T[found["script"]]
    allowed |= ~allowed.any(1, keepdims=True)
    scores = np.where(allowed, scores, -np.inf)
    return np.maximum(scores - scores.max(1, keepdims=True), -WORD_BOUND)


def best_paths(scores: np.ndarray, counts: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Viterbi's labels of all words; texts are decoded side by side, the longest first."""
    starts, langs = starts_of(counts), scores.shape[1]
    order = np.argsort(-counts, kind="stable")
    longest = int(counts.max()) if len(counts) else 0
    back = np.zeros((len(scores), langs), np.uint8)
    best = np.zeros((len(counts), langs))
    last = np.zeros(len(counts), np.int64)
    lengths = counts[order]
    for t in range(longest):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        rows = starts[order[:live]] + t
        here = best[:live]
        top = here.argmax(1)
        stay, switch = here, here[np.arange(live), top] - penalty
        moved = switch[:, None] > stay
        back[rows] = np.where(moved, top[:, None], np.arange(langs))
        best[:live] = np.where(moved, switch[:, None], stay) + scores[rows]
    last[order] = best.argmax(1) if len(counts) else 0
    labels = np.zeros(len(scores), np.int64)
    state = last[order]
    for t in range(longest - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        rows = starts[order[:live]] + t
        labels[rows] = state[:live]
        state[:live] = back[rows, state[:live]]
    return labels


def _predicted(model: dict | None, with_spans: bool):
    def rows(batches):
        names = model["names"] if model else []
        for batch in chunks(batches, "text", _CHUNK):
            n = batch.num_rows
            langs, scores, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
            if model:
                found = letters_of(texts_of(batch))
                counts = np.bincount(found["text"], minlength=n)
                labels = best_paths(word_scores(model, found), counts)
                held = np.zeros((n, len(names)))
                np.add.at(held, (found["text"], labels), found["letters"])
                total = held.sum(1)
                scores = np.where(total > 0, held.max(1) / np.maximum(total, 1), 0.0)
                langs = [names[k] if t else UNKNOWN for k, t in zip(held.argmax(1), total)]
                if with_spans:
                    new = np.flatnonzero(np.concatenate([[True], (found["text"][1:] != found["text"][:-1]) | (labels[1:] != labels[:-1])])[: len(labels)])
                    ends = np.append(new[1:], len(labels))
                    for a, b in zip(new, ends):
                        spans[found["text"][a]].append({"start": int(found["first"][a]), "end": int(found["last"][b - 1]), "lang": names[labels[a]]})
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)]
            fields = ["doc_id", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))))
                fields.append("spans")
            yield pa.RecordBatch.from_arrays(columns, fields)

    return rows


def languages(docs: DataFrame, model: dict | None, with_spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and spans (start, end, lang; code points, end exclusive) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", spans array<struct<start:long,end:long,lang:string>>" if with_spans else ""
    return docs.select("doc_id", "text").mapInArrow(_predicted(model, with_spans), f"doc_id {kind}, lang_pred string, score double{more}")


def _held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = languages(docs, train(docs.where(~_held_out())), with_spans=False)
    return found.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
