import itertools
import random
import time

import numpy as np
import pytest

from pixledger.llm import html_text as h

PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Menu</a></ul></nav><div class='ad box'>Buy this now.</div>"
    "<article><h1>A &amp; title</h1><p>First <b>para\n graph</b>,&nbsp;whole.<p>Second one.<br>Third.<div class=\"comments\">A reader.</div><form>Name</form></article>"
    "<aside>Side</aside><footer>&copy; foot</footer><script>var t='<p>no</p>'</script>"
)


def test_blocks_and_labels():
    blocks = h.leaf_blocks(PAGE)
    assert [b.text for b in blocks] == ["Menu", "Buy this now.", "A & title", "First para graph, whole.", "Second one.", "Third.", "A reader.", "Name", "Side", "© foot"]
    assert h.marked_labels(blocks) == [0, 0, 1, 1, 1, 1, 0, 0, 0, 0]


def texts(page):
    return [b.text for b in h.leaf_blocks(page)]


def test_heads_without_an_end_tag():
    for start in ("<body>", "", "<body><div>", "<p>", "<br>"):
        assert texts(f"<html><head><title>t</title><meta charset='x'>{start}<article>Whole</article>") == ["Whole"], start
    assert texts("<head><title>t</title> Bare text") == ["Bare text"]
    assert texts("<head><noscript><img src=x>no</noscript><title>t</title><template><p>no</p></template></head><body>Yes") == ["Yes"]
    assert texts("<head><noscript><p>no<body><article>Yes</article>") == ["Yes"]


def test_drawings_and_formulas():
    assert texts("<div><svg width='1' />Seen <svg/>too <svg><g/><text>no</text></svg>here</div>") == ["Seen too here"]
    assert texts("<div><svg><title/><path/></svg>Seen</div>") == ["Seen"]
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mspace/><mn>2</mn><annotation>x=2</annotation></math> hold.</p></article>") == ["Let x=2 hold."]
    assert texts("<div><svg width=1/><text>no</text></svg>Seen</div>") == ["Seen"]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    model = {"node": rng.normal(size=(h.WIDTH, 2)), "chain": rng.normal(size=(2, 2))}
    rows = [[1, 5], [7], [2, 9, 11], [4], [6, 3]]
    value = lambda y: sum(model["node"][r, k].sum() for r, k in zip(rows, y)) + sum(model["chain"][a, b] for a, b in zip(y, y[1:]))
    assert tuple(h.decoded(model, rows)) == max(itertools.product((0, 1), repeat=5), key=value)


def test_broken_pages_are_read():
    rng = random.Random(1)
    parts = ["<", "</", "<p>", "<div class='x", '"', "'", ">", "a b", "&amp", "&lt;", "<!--", "-->", "<script>", "</script>", "<br/>", "é", "<li>", "</div>", "<textarea>"]
    for _ in range(5000):
        h.main_text(None, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))))
    start = time.time()
    for page in ('<a b="c' * 20_000, "<!-- " * 50_000, "<div class=a>x" * 50_000 + "</q>" * 50_000):
        h.main_text(None, page)
    assert time.time() - start < 20


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["word", "other", "thing", "made", "house"]) for _ in range(n)) + "."
    rows, truth = [], {}
    for i in range(120):
        paras = [text(rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{x}</p>" for x in paras)
        tag = ("<article>", "</article>") if i % 4 else ("<div>", "</div>")
        links = "".join(f"<li><a href='/{k}'>{text(1)}</a></li>" for k in range(6))
        rows.append((i, f"u{i}", f"<body><nav><ul>{links}</ul></nav><div class='ad'>{text(3)}</div>{tag[0]}{body}{tag[1]}<footer>&copy; {text(2)}</footer>"))
        truth[i] = "\n".join(paras)
    rows += [(500, None, None), (501, "u", ""), (502, "u", "no tags at all"), (0, "u0", rows[0][2])]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, n_chars int"), truth


def test_pages_with_and_without_marks(pages, spark):
    frame, truth = pages
    found = {r["page_id"]: r["text"] for r in h.extracted(frame, h.train(frame)).collect()}
    assert sum(found[i] == truth[i] for i in truth) >= 0.95 * len(truth)
    assert all(found[i] == truth[i] for i in truth if i % 4)
    assert found[500] == "" and found[501] == ""
    empty = spark.createDataFrame([], frame.schema)
    assert h.train(empty) is None and h.extracted(empty, None).collect() == []


def test_a_page_repeated_in_many_rows_is_drawn_once(spark, monkeypatch):
    page = lambda k: f"<html><body><nav>menu {k}</nav><article><p>text number {k} of the article</p></article></body></html>"
    pages = spark.createDataFrame([(page(k),) for k in range(30)] + [(page(0),)] * 400, "html string")
    seen = []
    monkeypatch.setattr(h, "fit", lambda rows: seen.append(len(rows)) or {})
    h.train(pages, 1000)
    assert seen == [60]  # each page with and without its path
