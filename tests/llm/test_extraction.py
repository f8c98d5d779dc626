import html
import os
import re
import time

import numpy as np
import pytest

from ledgerloom.llm import boosting, dom, extraction

FOLDER = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def test_trees_learn_an_interaction():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = boosting.fit(x[:3000], y[:3000], np.ones(3000), trees=40)
    assert ((trees.margin(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def everything(source):
    page = dom.read(source)
    return dom.text_of(page, [True] * len(page.tags))


@pytest.mark.parametrize(
    "source, text",
    [
        ("", ""),
        ("<p>a<p>b &amp; c<li>d", "a\nb & c\nd"),
        ("<p>a <b>bold</b>,\n  x<br>y</p>tail", "a bold, x y\ntail"),
        ('<script>var t="</p>";</script><p>x<style>p{}</style></p><title>t</title>', "x"),
        ("<p title='a>b'>x</p><!-- <p>no</p> --><p>y", "x\ny"),
        ("<div>a<div>b</div>c</div></div>d", "a\nb\nc\nd"),
        ("<p>cut <a href=\"x", "cut"),
        ("1 < 2 &lt;p&gt; &copy; &am", "1 < 2 <p> © &am"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\nb\nc"),
        ("<textarea><p>no</textarea><select><option>no</select><p>yes", "yes"),
    ],
)
def test_blocks_of_a_page(source, text):
    assert everything(source) == text


def test_decoding_never_keeps_what_is_inside_a_dropped_element():
    pick = np.random.default_rng(2)
    page = dom.read("<div><p>a<b>b</b></p><p>c</p></div><ul><li>d<a>e</a></li></ul>" * 3)
    n = len(page.tags)
    for _ in range(200):
        margins = pick.normal(0, 2, n)
        chosen = extraction.decode(page, margins.tolist())
        assert all(chosen[page.parents[k]] or not chosen[k] for k in range(1, n))
        score = lambda labels: sum(-np.logaddexp(0, -m if c else m) for m, c in zip(margins[1:], labels[1:]))
        for _ in range(20):  # no consistent labels are likelier
            other = [True] * n
            for k in range(1, n):
                other[k] = other[page.parents[k]] and pick.random() < 0.6
            assert score(chosen) >= score(other) - 1e-9


@pytest.fixture(scope="module")
def trees(vocabulary):
    lines = [" ".join(vocabulary[k : k + 9]).capitalize() + "." for k in range(0, 390, 6)]
    return extraction.learn(["".join(f"<p>{x}</p>" for x in lines)])


def test_main_text_of_pages_made_from_other_sentences(trees, prose):
    maker = extraction._Maker([prose(k, 11).capitalize() + "." for k in range(200)], 99)
    right = total = 0
    for _ in range(150):
        source, labels = maker.page()
        page = dom.read(source)
        margins = trees.margin(np.array(dom.features(page), np.float32)).tolist()
        chosen = extraction.decode(page, margins)
        right += sum(a == b for a, b in zip(chosen, labels))
        total += len(labels)
    assert right / total > 0.98


def test_rows(spark, trees):
    page = "<body><nav class=menu><a href=/>Home</a></nav><article><h1>Title here</h1><p>One sentence, then another one. And a third.</p></article><footer>(c) me</footer>"
    rows = [(1, page), (2, None), (3, ""), (1, page), (None, "<<<>>>"), (5, "<div>" * 3000 + "deep")]
    df = spark.createDataFrame([(i, h, "x") for i, h in rows], "page_id long, html string, text string")
    found = extraction.extract(df, trees).select("row.page_id", "row.text", "text").collect()
    texts = [(r[0], r[2]) for r in found if r[0] in (1, 2, 3)]
    wanted = "Title here\nOne sentence, then another one. And a third."
    assert sorted(texts) == [(1, wanted), (1, wanted), (2, ""), (3, "")] and found[0][1] == "x" and len(found) == 6
    assert extraction.extract(df.limit(0), trees).collect() == [] and extraction.sample(df.limit(0)) == []


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no table folder")
def test_given_pages(spark):
    from ledgerloom.llm.queries import QUERIES

    def wanted(source):
        article = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        return "\n".join(b for b in blocks if b)

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    rows = QUERIES["op5_html_extraction"](spark, FOLDER).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert np.mean([r["text"] == wanted(pages[r["page_id"]]) for r in rows]) > 0.99


@pytest.mark.parametrize(
    "source, text",
    [
        ("<html><head><title>t</title><body><article><p>a</p></article>", "a"),
        ("<head><meta charset=x><title>t</title><script>s</script><link rel=y><p>a<p>b", "a\nb"),
        ("<head><title>t</title>\n<noscript><p>n</p></noscript>\n<style>s</style><div>a</div>", "a"),
        ("<html><head><title>t</title>plain <b>text</b>", "plain text"),
        ("<head>\n<title>t</title>\n</head><body><p>a", "a"),
    ],
)
def test_heads_without_an_end_tag(source, text):
    assert everything(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ('<p title=5">first</p><p>second</p>', "first\nsecond"),
        ("<p title='a > b' class = \"c > d\" e>first</p>", "first"),
        ('<p "x">first</p><p data-x=">">second</p>', "first\nsecond"),
        ("<script src=x />var a=1;</script><p>text</p>", "text"),
        ("<p>one <a href=/x/>two</a> three</p>", "one two three"),
        # A slash closes elements of drawings; these stand between blocks.
        ("<p>one<svg/> two<svg><path d=z/></svg> three</p>", "one\ntwo\nthree"),
    ],
)
def test_attributes_and_slashes(source, text):
    assert everything(source) == text


def test_deep_and_long_pages():
    started = time.process_time()
    page = dom.read("<b>" * 20_000 + "text" + "</i>" * 20_000 + "<p>" * 20_000 + "</b>" * 20_000)
    assert len(page.tags) == 40_001 and time.process_time() - started < 3
    assert everything("<p>" + "word " * 300_000 + "</p>").count("word") == 300_000


def test_sample_has_different_pages_of_bounded_size(spark):
    pages = ["<p>same</p>"] * 300 + [f"<p>page {k}</p>" for k in range(20)] + ["<p>" + "x" * 500_000]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    found = extraction.sample(df)
    assert len(found) == len(set(found)) == 22 and max(map(len, found)) == extraction.SAMPLE_CHARS
