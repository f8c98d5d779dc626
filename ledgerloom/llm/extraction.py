"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

Every element of a page is scored by gradient-boosted trees from its kind, the
tokens of its attributes, its depth, the density of text, links and punctuation
in its subtree, and how it stands among its siblings. A label for the whole tree
follows by dynamic programming: the likeliest one in which nothing inside a
dropped element is kept. The text of the kept elements is the main text.

No page comes with labels, so the trees learn from pages laid out around
sentences of a bounded sample of the given pages: articles between menus,
headers, sidebars, notices, adverts, forms, comments and footers, with and without
telling attributes. The model has a fixed size and goes to the tasks with the code.
"""

from __future__ import annotations

import html
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import boosting, dom
from ledgerloom.llm.frames import as_row, ready, row_and

# Pages whose sentences the training pages are made of, and training pages.
SAMPLE_CHARS = 100_000
SAMPLE_PAGES = 200
TRAINING_PAGES = 700
SEED = 11
# Elements scored at once.
SCORED = 20_000

_CONTENT = "article content entry-content post-content post story article-body main-content entry page-content story-text news-body hentry".split()
_NEUTRAL = "row container wrapper col-md-8 inner clearfix box block grid x1 unit page-wrap section-2 layout cell".split()
# Kinds of page parts beside an article: elements, attribute values.
_MENU = ("nav", "div", "ul"), "menu main-nav navbar top-menu nav-links site-navigation breadcrumb breadcrumbs pagination skip-links toolbar".split()
_HEADER = ("header", "div"), "site-header header masthead top-bar page-header logo-area".split()
_FOOTER = ("footer", "div"), "site-footer footer bottom copyright legal page-footer colophon".split()
_SIDE = ("aside", "div", "section"), "sidebar widget related-posts recent popular-posts side-column trending recommended teaser-list right-sidebar".split()
_NOTICE = ("div", "section", "aside", "dialog"), "cookie-notice cookie-banner consent gdpr-banner notice notification alert site-notice popup-overlay disclaimer".split()
_ADVERT = ("div", "aside", "section", "ins"), "ad ads advert banner-ad sponsored ad-slot promo promotion adsense sponsor-box advertisement".split()
_SHARE = ("div", "ul", "p"), "share social-share share-buttons social-links tags follow-us".split()
_FORM = ("form", "form", "div"), "search-form newsletter subscribe login-form contact-form signup subscription".split()
_TALK = ("section", "div", "ol"), "comments comment-list user-comments discussion responses disqus replies comment-section".split()


class _Maker:
    """Random pages with the label of each element, in the order in which they open."""

    def __init__(self, sentences: list[str], seed: int):
        self.pick = random.Random(seed)
        self.sentences = sentences or ["Some words stand here.", "Others follow, and end."]
        self.out: list[str] = []
        self.labels: list[bool] = []

    def sentence(self) -> str:
        return self.pick.choice(self.sentences)

    def phrase(self, most: int = 5) -> str:
        return " ".join(self.sentence().split()[: self.pick.randint(1, most)])

    def open(self, tag: str, keep: bool, name: str = "", more: str = "") -> None:
        how = self.pick.choice(("class", "class", "class", "id", "role")) if name else ""
        self.out.append(f"<{tag}" + (f' {how}="{name}"' if name else "") + more + ">")
        self.labels.append(keep)

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def text(self, words: str) -> None:
        self.out.append(html.escape(words, quote=self.pick.random() < 0.5))

    def element(self, tag: str, keep: bool, words: str, name: str = "", more: str = "") -> None:
        self.open(tag, keep, name, more)
        self.text(words)
        self.close(tag)

    def link(self, keep: bool, words: str) -> None:
        self.element("a", keep, words, more=f' href="/{self.pick.randrange(999)}"')

    def prose(self, keep: bool, sentences: int) -> None:
        for _ in range(sentences):
            chance = self.pick.random()
            if chance < 0.08:
                self.link(keep, self.phrase())
            elif chance < 0.2:
                self.element(self.pick.choice(("b", "em", "i", "strong", "span", "code")), keep, self.phrase())
            elif chance < 0.25:
                self.open("br", keep)
            self.text(self.sentence() + " ")

    def links(self, keep: bool) -> None:
        pick = self.pick
        if pick.random() < 0.7:
            tag = pick.choice(("ul", "ul", "ol"))
            self.open(tag, keep)
            for _ in range(pick.randint(1, 9)):
                self.open("li", keep)
                self.link(keep, self.phrase(3))
                self.close("li")
            self.close(tag)
        else:
            for _ in range(pick.randint(1, 8)):
                self.link(keep, self.phrase(3))
                self.text(pick.choice((" ", " | ", " · ")))

    def apart(self, kind: tuple) -> None:
        """A part beside the article; an unnamed one only where its element tells."""
        tags, names = kind
        tag = self.pick.choice(tags)
        telling = tag in ("nav", "header", "footer", "aside", "form", "dialog")
        name = "" if telling and self.pick.random() < 0.5 else self.pick.choice(names)
        if name and self.pick.random() < 0.2:
            name += " " + self.pick.choice(_NEUTRAL)
        self.open(tag, False, name)
        getattr(self, "_" + {id(_MENU): "menu", id(_TALK): "talk", id(_FORM): "form"}.get(id(kind), "plain"))()
        self.close(tag)

    def _menu(self) -> None:
        self.links(False)

    def _plain(self) -> None:
        pick = self.pick
        for _ in range(pick.randint(1, 3)):
            chance = pick.random()
            if chance < 0.3:
                self.text(self.sentence())
            elif chance < 0.5:
                self.element(pick.choice(("p", "div", "span")), False, " ".join(self.sentence() for _ in range(pick.randint(1, 4))))
            elif chance < 0.6:
                self.element(pick.choice(("h2", "h3", "h4", "strong")), False, self.phrase())
            elif chance < 0.7:
                self.apart(_MENU)
            elif chance < 0.9:
                self.links(False)
            else:
                self.text(f"(c) {pick.randint(1990, 2030)} {self.phrase()} · {self.phrase()}")

    def _form(self) -> None:
        if self.pick.random() < 0.6:
            self.element(self.pick.choice(("label", "p", "h3", "legend")), False, self.sentence())
        for _ in range(self.pick.randint(1, 3)):
            self.open("input", False, more=' type="text"')
        self.element("button", False, self.phrase(2))

    def _talk(self) -> None:
        pick = self.pick
        if pick.random() < 0.6:
            self.element(pick.choice(("h2", "h3")), False, self.phrase())
        tag = pick.choice(("div", "li", "article"))
        for _ in range(pick.randint(1, 8)):
            self.open(tag, False, pick.choice(("comment", "reply", "comment-body", "", "response")))
            if pick.random() < 0.7:
                self.element(pick.choice(("span", "cite", "strong", "a")), False, self.phrase(2))
            self.open("p", False)
            self.prose(False, pick.randint(1, 8))
            self.close("p")
            self.close(tag)

    def article(self) -> None:
        pick = self.pick
        tag = pick.choice(("article", "article", "main", "div", "section", "td"))
        if tag == "td":
            self.open("table", True)
            self.open("tr", True)
        name = pick.choice(_CONTENT) if tag in ("div", "section", "td") and pick.random() < 0.85 else ""
        self.open(tag, True, name or pick.choice(("", *_NEUTRAL)))
        inner = pick.random() < 0.3
        if inner:
            self.open("div", True, pick.choice(_CONTENT + _NEUTRAL))
        if pick.random() < 0.85:
            self.element(pick.choice(("h1", "h1", "h2")), True, self.phrase(12))
        loose = pick.random() < 0.3  # an inline element left open, as in careless pages
        for _ in range(pick.choice((1, 2, 3, 4, 6, 9, 14))):
            chance = pick.random()
            if chance < 0.68:
                self.open("p", True)
                if loose and pick.random() < 0.3:
                    self.open("b", True)
                    self.text(self.sentence())
                    self.open("br", True)
                else:
                    self.prose(True, pick.choice((1, 1, 2, 3, 5, 8)))
                    self.close("p")
            elif chance < 0.75:
                self.element(pick.choice(("h2", "h3")), True, self.phrase(8))
            elif chance < 0.83:
                tag2 = pick.choice(("ul", "ol"))
                self.open(tag2, True)
                for _ in range(pick.randint(1, 6)):
                    self.open("li", True)
                    self.prose(True, 1)
                    self.close("li")
                self.close(tag2)
            elif chance < 0.88:
                tag2 = pick.choice(("blockquote", "pre", "div"))
                self.open(tag2, True)
                self.prose(True, pick.randint(1, 3))
                self.close(tag2)
            elif chance < 0.91:
                self.open("table", True)
                for _ in range(pick.randint(1, 4)):
                    self.open("tr", True)
                    for _ in range(3):
                        self.element("td", True, self.phrase(3))
                    self.close("tr")
                self.close("table")
            elif chance < 0.93:
                self.open("figure", True)
                self.open("img", True)
                self.element("figcaption", True, self.sentence())
                self.close("figure")
            else:
                self.apart(pick.choice((_ADVERT, _ADVERT, _SHARE, _SIDE, _NOTICE, _FORM)))
        if pick.random() < 0.1:
            self.apart(_TALK)
        if inner:
            self.close("div")
        self.close(tag)
        if tag == "td":
            self.close("tr")
            self.close("table")

    def page(self) -> tuple[str, list[bool]]:
        """A page and the labels of its elements, the page itself first."""
        pick = self.pick
        self.out, self.labels = ["<!DOCTYPE html>"], [True]
        self.open("html", True)
        self.open("head", False)
        self.element("title", False, self.phrase(9))
        self.close("head")
        self.open("body", True)
        wraps = [pick.choice(("div", "main", "section")) for _ in range(pick.choice((0, 0, 1, 2)))]
        for tag in wraps:
            self.open(tag, True, pick.choice(("", *_NEUTRAL, "content", "main")))
        before = [k for k in (_HEADER, _MENU, _NOTICE, _ADVERT, _FORM, _SIDE) if pick.random() < 0.4]
        after = [k for k in (_SHARE, _SIDE, _TALK, _FORM, _ADVERT, _NOTICE, _MENU, _FOOTER) if pick.random() < 0.4]
        pick.shuffle(before)
        for kind in before:
            self.apart(kind)
        self.article()
        for kind in after:
            self.apart(kind)
        for tag in reversed(wraps):
            self.close(tag)
        if pick.random() < 0.8:
            self.close("body")
            self.close("html")
        return "".join(self.out), self.labels


def learn(sources: list[str], pages: int = TRAINING_PAGES, seed: int = SEED) -> boosting.Trees:
    """Trees from ``pages`` made pages around sentences of ``sources``."""
    sentences: list[str] = []
    for source in sources:
        for piece in dom.read(source).pieces:
            words = html.unescape(piece[1]).split() if piece else []
            sentences += [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)][:40]
    maker = _Maker(sorted(set(sentences)), seed)
    rows, labels = [], []
    for _ in range(pages):
        source, own = maker.page()
        read = dom.read(source)
        if len(read.tags) == len(own):
            rows += dom.features(read)
            labels += own
    x, y = np.array(rows, np.float32), np.array(labels, float)
    weight = np.log1p(np.expm1(x[:, 2 * len(dom.GROUPS) + 14].astype(float))) + 1.0
    return boosting.fit(x, y, weight)


def decode(page: dom.Page, margins: list[float]) -> list[bool]:
    """The likeliest labels in which every element inside a dropped one is dropped; the page itself is kept."""
    n = len(page.tags)
    scores = np.array(margins)
    keep, drop = (-np.logaddexp(0, -scores)).tolist(), (-np.logaddexp(0, scores)).tolist()
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        keep[up] += max(keep[k], drop[k])
        drop[up] += drop[k]
    chosen = [True] * n
    for k in range(1, n):
        chosen[k] = chosen[page.parents[k]] and keep[k] >= drop[k]
    return chosen


def _texts(pages: list[dom.Page], rows: list[list[float]], trees: boosting.Trees) -> Iterator[str]:
    """Main texts of pages whose elements' features are ``rows``, one page after the other."""
    margins = trees.margin(np.array(rows, np.float32).reshape(-1, dom.FEATURES)).tolist()
    at = 0
    for page in pages:
        n = len(page.tags)
        yield dom.text_of(page, decode(page, margins[at : at + n]))
        at += n


def sample(pages: DataFrame, most: int = SAMPLE_PAGES) -> list[str]:
    """At most ``most`` different pages, cut at ``SAMPLE_CHARS``: those with the smallest hashes among about twice as many.

    Sentences are all they are for, so the rest of a long page isn't missed.
    """
    given = pages.filter("html is not null").select(F.xxhash64("html").alias("hash"), F.substring("html", 1, SAMPLE_CHARS).alias("html"))
    n = max(1, given.agg(F.approx_count_distinct("hash")).first()[0])
    place = F.pmod("hash", F.lit(1 << 30))
    near = given.filter(place < min(1 << 30, int(2 * most / n * (1 << 30)) + 1))
    one = near.groupBy("hash").agg(F.min("html").alias("html"))
    return [r["html"] for r in one.orderBy(place, "html").limit(most).collect()]


def extract(pages: DataFrame, trees: boosting.Trees) -> DataFrame:
    """``row`` (all columns of ``pages``) and ``text``, the main text of its ``html``.

    Character references are decoded; white space in a block becomes one blank and is
    trimmed; blocks follow in page order, one line each. Null or empty ``html`` gives
    an empty text, a page cut short what it has so far. Repeated rows get equal
    results, an empty table none; other columns pass through ``row`` and can have any
    name. A page is held whole by one task; nothing is shuffled.
    """
    ready(pages.sparkSession)
    rows = as_row(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[str] = []
            pages, rows = [], []
            for source in batch.column("row").field("html").to_pylist():
                pages.append(dom.read(source or ""))
                rows += dom.features(pages[-1])
                if len(rows) >= SCORED:
                    texts += _texts(pages, rows, trees)
                    pages, rows = [], []
            texts += _texts(pages, rows, trees)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return rows.mapInArrow(run, row_and(rows, "text string"))
