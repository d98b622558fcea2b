"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read once into leaf blocks: stretches of text between block-level tags
and line breaks, each with its open ancestors. Scripts, styles, comments, drawings and
the head never become blocks; the text of formulas does. The head's end tag may be absent. Features of a block are its ancestors' tags and the words
of their classes and ids, and its text's form: length, links, sentence ends, place.

Labelled pages are those that mark their article themselves (``article`` or ``main``):
a block is main text if it lies in that and not in an element whose tag or class
names a menu, form, advert, notice, comment and the like. A sample of at most about
``SAMPLE`` of them, each once with its ancestors and once with only the text's form, is
fitted by exact likelihood (forward and backward sums); Viterbi decodes every page.
Without a labelled page the labelling rule's plain counterpart holds: everything
outside elements named so is main text.

Null html counts as empty and gives the empty text, as do pages without main text.
Tags that do not close, end without an opening or break off are read as browsers do
in the simple cases: paragraphs end at the next block, stray ends are skipped. Equal
rows get equal texts; nothing is cut or capped. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixledger.llm.common import chunks, table, texts_of

SAMPLE = 1_500
WIDTH = 2048
#: Elements without content, elements whose content is not markup, elements that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noframes".split())
HIDDEN = frozenset("script style title xmp noframes head noscript template svg annotation annotation-xml iframe object canvas".split())
#: What may stand in a head, whose end any other start tag or text implies; roots of markup in which a closing slash counts.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
FOREIGN = frozenset("svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements and words of classes or ids that are not the article's text.
ASIDE_TAGS = frozenset("nav aside footer form button select option textarea input dialog menu".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe signup login"
    " nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer comment comments reply replies share social related recommended popup modal widget form toolbar".split()
)

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A slash that ends an attribute's bare value closes nothing.
_BARE = re.compile(r"""=\s*[^\s"'>]*/$""")
_WORD = re.compile(r"[A-Za-z]+")
_SENTENCE = re.compile(r"[.!?…]\s|[.!?…]$")


class Element:
    """An open element; what its ancestors say is summed up once, so that depth costs nothing later."""

    __slots__ = ("tag", "names", "article", "aside", "inner")

    def __init__(self, tag: str, words: set[str], parent: Element | None):
        self.tag = tag
        own = {f"in={tag}", *(f"word={w}" for w in words)}
        self.names = parent.names if parent and own <= parent.names else frozenset(own | (parent.names if parent else set()))
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        named = tag in ASIDE_TAGS or not words.isdisjoint(ASIDE_WORDS) or (tag == "header" and not self.article)
        #: named so anywhere on the path, and at or below the article
        self.aside = named or bool(parent and parent.aside)
        self.inner = (named and self.article) or bool(parent and parent.inner)


ROOT = Element("", set(), None)


class Block:
    __slots__ = ("text", "linked", "within")

    def __init__(self, text: str, linked: int, within: Element):
        self.text, self.linked, self.within = text, linked, within


def leaf_blocks(page: str) -> list[Block]:
    """The page's blocks with text, in order."""
    out: list[Block] = []
    stack: list[Element] = [ROOT]
    counts: Counter[str] = Counter()
    parts: list[str] = []
    linked, hidden, in_link = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, linked, stack[-1]))
        parts.clear()
        linked = 0

    def close(name: str) -> None:
        nonlocal hidden, in_link
        while counts[name]:
            gone = stack.pop().tag
            counts[gone] -= 1
            hidden -= gone in HIDDEN
            in_link -= gone == "a"
            if gone == name:
                return

    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at and stack[-1].tag == "head" and not page[at:tag].isspace():
            close("head")
        if tag > at and not hidden:
            parts.append(page[at:tag])
            linked += (tag - at) * (in_link > 0)
        if tag == size:
            break
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), tag):
            end = page.find(">", tag)
            at = size if end < 0 else end + 1
            continue
        found = _TAG.match(page, tag)
        if not found:
            if page[tag + 1 : tag + 2].isalpha() or page.startswith("</", tag):  # a tag that breaks off
                end = page.find(">", tag)
                at = size if end < 0 else end + 1
            else:
                if not hidden:
                    parts.append("<")
                at = tag + 1
            continue
        at = found.end()
        name = found[2].lower()
        if name in BLOCK:
            flush()
        if found[1]:
            close(name)
            continue
        if counts["head"] and name not in HEAD and not counts["template"] and (name == "body" or not counts["noscript"]):
            close("head")
        if name in VOID:
            continue
        if found[3].endswith("/") and (name in FOREIGN or any(counts[x] for x in FOREIGN)) and not _BARE.search(found[3]):
            continue
        if name in BLOCK:
            if any(x.tag == "p" for x in stack[-4:]):
                close("p")
            if name == stack[-1].tag and name in ("li", "dt", "dd", "option", "tr", "td", "th"):
                close(name)
        words = {w.lower() for m in _NAMES.finditer(found[3]) for w in _WORD.findall(m[1] or m[2] or m[3] or "")} if found[3] else set()
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            stop = end.start() if end else size
            if name == "textarea" and not hidden:
                flush()
                stack.append(Element(name, words, stack[-1]))
                parts.append(page[at:stop])
                flush()
                stack.pop()
            after = page.find(">", stop)
            at = size if after < 0 else after + 1
            continue
        stack.append(Element(name, words, stack[-1]))
        counts[name] += 1
        hidden += name in HIDDEN
        in_link += name == "a"
    flush()
    return out


def marked_labels(blocks: list[Block]) -> list[int] | None:
    """1 for blocks of the marked article, or None where the page marks none."""
    if not any(b.within.article for b in blocks):
        return None
    return [int(b.within.article and not b.within.inner) for b in blocks]


def _number(name: str, cache: dict[str, int] = {}) -> int:  # noqa: B006
    found = cache.get(name)
    if found is None:
        if len(cache) > 100_000:
            cache.clear()
        found = cache[name] = xxhash.xxh3_64_intdigest(name) % WIDTH
    return found


def block_features(blocks: list[Block], with_path: bool = True) -> list[list[int]]:
    rows = []
    n = len(blocks)
    for k, block in enumerate(blocks):
        size = len(block.text)
        ends = len(_SENTENCE.findall(block.text))
        names = [
            "bias", f"size={min(size.bit_length(), 12)}", f"linked={min(10 * block.linked // max(size, 1), 10)}", f"ends={min(ends, 4)}",
            f"place={10 * k // n}", f"first={k == 0}", f"last={k == n - 1}", f"tag={block.within.tag}",
        ]
        if with_path:
            names += block.within.names
            names += [f"named={block.within.aside}", f"article={block.within.article}{block.within.inner}"]
        rows.append([_number(x) for x in names])
    return rows


def fit(pages: list[tuple[list[list[int]], list[int]]], steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> dict:
    """Node and transition weights of largest likelihood; pages of equal length are summed side by side."""
    lengths = np.array([len(y) for _, y in pages])
    groups = []
    for length in np.unique(lengths):
        own = [pages[i] for i in np.flatnonzero(lengths == length)]
        flat = [row for x, _ in own for row in x]
        owner = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
        groups.append((np.concatenate(flat).astype(np.int64), owner, np.array([y for _, y in own])))
    total = int(lengths.sum())
    weights = [np.zeros((WIDTH, 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for t in range(1, steps + 1):
        grads = [ridge * weights[0], ridge * weights[1]]
        for features, owner, labels in groups:
            n, length = labels.shape
            scores = np.stack([np.bincount(owner, weights=weights[0][features, k], minlength=n * length) for k in (0, 1)], 1).reshape(n, length, 2)
            ahead, behind = np.zeros_like(scores), np.zeros_like(scores)
            ahead[:, 0] = scores[:, 0]
            for k in range(1, length):
                ahead[:, k] = scores[:, k] + np.logaddexp.reduce(ahead[:, k - 1, :, None] + weights[1], axis=1)
            for k in range(length - 2, -1, -1):
                behind[:, k] = np.logaddexp.reduce(weights[1] + (scores[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            whole = np.logaddexp.reduce(ahead[:, -1], axis=1)[:, None, None]
            hot = np.eye(2)[labels]
            wrong = (np.exp(ahead + behind - whole) - hot).reshape(-1, 2)[owner]
            for k in (0, 1):
                grads[0][:, k] += np.bincount(features, weights=wrong[:, k], minlength=WIDTH) / total
            if length > 1:
                pair = ahead[:, :-1, :, None] + weights[1] + (scores + behind)[:, 1:, None, :] - whole[..., None]
                grads[1] = grads[1] + (np.exp(pair).sum((0, 1)) - np.einsum("nka,nkb->ab", hot[:, :-1], hot[:, 1:])) / total
        for k, g in enumerate(grads):
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.999 * second[k] + 0.001 * g * g
            weights[k] = weights[k] - rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return {"node": weights[0], "chain": weights[1]}


def decoded(model: dict, rows: list[list[int]]) -> list[int]:
    """Viterbi's labels of a page's blocks."""
    margin = model["node"][:, 1] - model["node"][:, 0]
    link = model["chain"]
    best, backs = (0.0, 0.0), []
    for k, row in enumerate(rows):
        own = float(margin[row].sum())
        if k:
            zero = (best[0] + link[0, 0], best[1] + link[1, 0])
            one = (best[0] + link[0, 1], best[1] + link[1, 1])
            backs.append((int(zero[1] > zero[0]), int(one[1] > one[0])))
            best = (max(zero), max(one) + own)
        else:
            best = (0.0, own)
    label = int(best[1] > best[0])
    out = [label]
    for back in reversed(backs):
        label = back[label]
        out.append(label)
    return out[::-1]


def main_text(model: dict | None, page: str) -> str:
    blocks = leaf_blocks(page)
    if not blocks:
        return ""
    if model is None:
        return "\n".join(b.text for b in blocks if not b.within.aside)
    return "\n".join(b.text for b, keep in zip(blocks, decoded(model, block_features(blocks))) if keep)


def train(pages: DataFrame, sample: int = SAMPLE) -> dict | None:
    """A model of a bounded sample of labelled pages; None without any."""
    held = pages.where(F.col("html").rlike("(?i)<(article|main)")).select("html")
    kinds = held.select(F.xxhash64("html").alias("h")).distinct()  # a page repeated in very many rows is one
    share = int(min(1.0, sample / max(kinds.count(), 1)) * 1_000_000)
    chosen = held.where(F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < share).distinct()

    def rows(batches):
        for batch in batches:
            features, labels = [], []
            for page in batch.column("html").to_pylist():
                blocks = leaf_blocks(page)
                marks = marked_labels(blocks)
                if marks:
                    features += [block_features(blocks), block_features(blocks, with_path=False)]
                    labels += [marks, marks]
            yield pa.RecordBatch.from_arrays(
                [pa.array(features, pa.list_(pa.list_(pa.int32()))), pa.array(labels, pa.list_(pa.int32()))], ["features", "labels"]
            )

    found = chosen.mapInArrow(rows, "features array<array<int>>, labels array<int>").collect()
    found = sorted((list(r["labels"]), [list(x) for x in r["features"]]) for r in found)  # the same order on every run
    return fit([(x, y) for y, x in found]) if found else None


def extracted(pages: DataFrame, model: dict | None) -> DataFrame:
    """page_id, url and text of every page."""

    def rows(batches):
        for batch in chunks(batches, "html"):
            texts = [main_text(model, page) for page in texts_of(batch, "html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(rows, f"page_id {kind}, url string, text string")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extracted(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
