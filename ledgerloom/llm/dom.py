"""A small tolerant HTML reader: elements in page order with their texts, and statistics of each."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass, field

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Only here a slash before the end of a tag closes the element.
FOREIGN = ("svg", "math")
# Elements whose content is no text of the page.
SILENT = frozenset(
    "script style template noscript iframe object svg math canvas textarea select option button title head audio video".split()
)
# What a head can hold; any other element, or text, ends a head that has no end tag.
_HEAD = frozenset("html head title meta link script style base basefont bgsound noframes noscript template".split())
_RAW = frozenset("script style textarea title iframe noscript template".split())
_CLOSING = {tag: re.compile(rf"</{tag}[\s/>]|\Z", re.IGNORECASE) for tag in _RAW}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
_ITEMS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table tbody thead tfoot", "td": "tr", "th": "tr", "option": "select"}
_SIBLINGS = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}

# Attribute tokens that name parts of a page.
GOOD = frozenset("article articlebody blog body content entry hentry main maincontent news page post prose story text".split())
BAD = frozenset(
    "ad ads advert advertisement adsense banner bar bottom breadcrumb breadcrumbs byline consent contact cookie cookies copyright "
    "disclaimer dropdown follow footer gdpr header hero legal links login logo masthead menu modal nav navbar navigation navi newsletter "
    "notice notification overlay pager pagination popular popup promo promoted promotion recent recommended related rss search "
    "share sharing shop side sidebar sidenav signin signup skip social sponsor sponsored subscribe subscription tags teaser tool toolbar "
    "top trending warning widget widgets alert aside complementary contentinfo".split()
)
TALK = frozenset("comment comments commentlist discussion disqus feedback replies reply respond response responses thread".split())
GROUPS = (
    ("nav", "menu"),
    ("header", "hgroup"),
    ("footer", "address"),
    ("aside",),
    ("form", "fieldset", "legend", "label", "dialog"),
    ("article",),
    ("main",),
    ("section",),
    ("div", "center"),
    ("p",),
    ("h1",),
    ("h2", "h3", "h4", "h5", "h6"),
    ("ul", "ol", "dl"),
    ("li", "dt", "dd"),
    ("a",),
    ("table", "tbody", "thead", "tr", "td", "th", "caption"),
    ("blockquote", "pre", "figure", "figcaption"),
)
_GROUP = {tag: k for k, tags in enumerate(GROUPS) for tag in tags}
_APART = frozenset(range(5))  # groups of elements that stand beside an article


@dataclass
class Page:
    """Elements by number; element 0 is the page itself. ``pieces`` are texts in page order, None between blocks."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    parents: list[int] = field(default_factory=lambda: [-1])
    attributes: list[str] = field(default_factory=lambda: [""])
    pieces: list[tuple[int, str] | None] = field(default_factory=list)


def read(source: str) -> Page:
    page, stack, silent, at = Page(), [0], 0, 0
    tags, parents, attributes, pieces = page.tags, page.parents, page.attributes, page.pieces
    opened: Counter[str] = Counter()  # open elements by tag: most tags that could close one find none

    def close(upto: int) -> None:
        nonlocal silent
        while len(stack) > upto:
            tag = tags[stack.pop()]
            opened[tag] -= 1
            silent -= tag in SILENT
            if tag not in INLINE:
                pieces.append(None)

    def nearest(names: tuple[str, ...], stop: frozenset[str]) -> int | None:
        if not any(opened[name] for name in names):
            return None
        for k in range(len(stack) - 1, 0, -1):
            tag = tags[stack[k]]
            if tag in names:
                return k
            if tag in stop:
                return None
        return None

    while at < len(source):
        found = _TAG.search(source, at)
        upto = found.start() if found else len(source)
        if silent and upto > at and tags[stack[-1]] == "head" and not source[at:upto].isspace():
            close(len(stack) - 1)
        if upto > at and not silent:
            pieces.append((stack[-1], source[at:upto]))
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            k = nearest((tag,), frozenset())
            if k:
                close(k)
            continue
        if silent and tag not in _HEAD:
            k = nearest(("head",), frozenset())
            if k:
                close(k)
        if tag not in INLINE:
            pieces.append(None)
            if tag in _ITEMS:
                k = nearest(_SIBLINGS.get(tag, (tag,)), frozenset(_ITEMS[tag].split()))
            else:
                k = nearest(("p",), frozenset(("table", "td", "li", "div", "section", "article", "blockquote", "form")))
            if k:
                close(k)
        elif tag == "br":
            pieces.append((stack[-1], " "))
        tags.append(tag)
        parents.append(stack[-1])
        attributes.append(found[3])
        if tag in VOID or found[3].endswith("/") and (tag in FOREIGN or any(opened[name] for name in FOREIGN)):
            continue
        if tag in _RAW:
            at = _CLOSING[tag].search(source, at).start()
        stack.append(len(tags) - 1)
        opened[tag] += 1
        silent += tag in SILENT
    return page


def tokens(attributes: str) -> list[str]:
    found = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
    return _TOKEN.findall(_CAMEL.sub(" ", found).lower()) if found else []


FEATURES = 2 * len(GROUPS) + 27


def features(page: Page) -> list[list[float]]:
    """Statistics of each element: its kind, attribute tokens, depth, subtree density, siblings and ancestors."""
    n = len(page.tags)
    chars, words, stops, own = [0] * n, [0] * n, [0] * n, [0] * n
    begin, seen = [-1] * n, 0
    for piece in page.pieces:
        if piece:
            k, text = piece
            parts = text.split()
            size = sum(map(len, parts)) + max(0, len(parts) - 1)
            if size:
                if begin[k] < 0:
                    begin[k] = seen
                own[k] += size
                chars[k] += size
                words[k] += len(parts)
                stops[k] += sum(text.count(c) for c in ".,;!?")
                seen += size
    linked = [chars[k] if page.tags[k] == "a" else 0 for k in range(n)]
    inner, paragraphs, links = [1] * n, [t == "p" for t in page.tags], [t == "a" for t in page.tags]
    paragraphs, links = list(map(int, paragraphs)), list(map(int, links))
    for k in range(n - 1, 0, -1):
        up = page.parents[k]
        chars[up] += chars[k]
        words[up] += words[k]
        stops[up] += stops[k]
        linked[up] += chars[k] if page.tags[k] == "a" else linked[k]
        inner[up] += inner[k]
        paragraphs[up] += paragraphs[k]
        links[up] += links[k]
        if begin[k] >= 0 and (begin[up] < 0 or begin[k] < begin[up]):
            begin[up] = begin[k]
    children, same = [0] * n, [{} for _ in range(n)]
    place = [0] * n
    for k in range(1, n):
        up = page.parents[k]
        place[k] = children[up]
        children[up] += 1
        same[up][page.tags[k]] = same[up].get(page.tags[k], 0) + 1
    depth, good_above, bad_above, talk_above, apart_above, article_above = ([0] * n for _ in range(6))
    rows = []
    total = max(1, chars[0])
    log = math.log1p
    for k in range(n):
        up = page.parents[k]
        group = _GROUP.get(page.tags[k], -1)
        names = tokens(page.attributes[k])
        good = sum(t in GOOD for t in names)
        bad = sum(t in BAD for t in names)
        talk = sum(t in TALK for t in names)
        row = [0.0] * FEATURES
        if group >= 0:
            row[group] = 1.0
        if up >= 0:
            depth[k] = depth[up] + 1
            good_above[k], bad_above[k], talk_above[k] = good_above[up], bad_above[up], talk_above[up]
            apart_above[k], article_above[k] = apart_above[up], article_above[up]
            above = _GROUP.get(page.tags[up], -1)
            if above >= 0:
                row[len(GROUPS) + above] = 1.0
        c = chars[k]
        at = 2 * len(GROUPS)
        row[at : at + 27] = (
            good,
            bad,
            talk,
            good_above[k],
            bad_above[k],
            talk_above[k],
            apart_above[k],
            article_above[k],
            depth[k],
            children[k],
            place[k],
            place[k] / children[up] if up >= 0 else 0.0,
            same[up][page.tags[k]] / children[up] if up >= 0 else 1.0,
            log(own[k]),
            log(c),
            c / inner[k],
            linked[k] / c if c else 0.0,
            100 * stops[k] / c if c else 0.0,
            c / words[k] if words[k] else 0.0,
            words[k] / inner[k],
            c / total,
            c / max(1, chars[up]) if up >= 0 else 1.0,
            max(begin[k], 0) / total,
            log(paragraphs[k]),
            log(links[k]),
            float(not names),
            log(inner[k]),
        )
        good_above[k] += good
        bad_above[k] += bad
        talk_above[k] += talk
        apart_above[k] += group in _APART
        article_above[k] += group in (5, 6)
        rows.append(row)
    return rows


def text_of(page: Page, chosen: list[bool]) -> str:
    """Texts of the chosen elements: white space is one blank inside a block, blocks are lines."""
    blocks, block = [], []
    for piece in [*page.pieces, None]:
        if piece is None:
            if block:
                joined = " ".join(html.unescape("".join(block)).split())
                if joined:
                    blocks.append(joined)
                block = []
        elif chosen[piece[0]]:
            block.append(piece[1])
    return "\n".join(blocks)
