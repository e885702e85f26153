"""Main text of web pages from streaming parser events.

The standard-library parser feeds a block builder: a block is the text between two block boundaries,
with white space folded.  Each block is a line with a text-to-tag ratio; the ratios are smoothed with a
Gaussian along the page and clustered by a threshold, their standard deviation, which selects the content
regions.  Blocks inside structural boilerplate (navigation, page headers, footers, asides, forms, hidden
elements, what is no text) never count.  A class, id or role that names boilerplate only lowers the ratio of
the blocks inside it, by ``WEAK`` or ``STRONG`` for each such element; they are kept if the ratio that is
left still reaches the threshold and ``KEPT_SHARE`` of what unmarked selected lines have on average.

Where the selected text lies mostly in marked-up articles, the region is those articles that hold a
selected line, or a line that is neither a heading nor mostly links.  Elsewhere, also where an article is
but a teaser (its lines then count only by their own ratio), the region spans from the first to the last selected line and grows over the adjoining blocks
of its containers that are not mostly links and the headings that lead into it, without blocks of links in
containers that hold no selected line.  Short blocks of a region are kept whatever their ratio.

Null or empty html gives an empty text; broken markup is read to its end, a ``<![`` as a comment up to
the next ``>``, and start tags end open elements whose end tag is optional, as browsers do.  A very long
page is read whole, in memory in proportion to it.  Lines of equal ratio are treated alike.  Null ids,
repeated rows and extra columns, whatever their names, pass unharmed; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

SIGMA = 1.0
RADIUS = 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("nav footer aside form script style noscript template button select textarea svg iframe head title menu dialog object canvas audio video datalist option".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
CONTAINER = frozenset("article main section div body html table tbody thead tfoot tr ul ol dl blockquote figure details header hgroup fieldset center".split()) | SKIP
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TABLE_PARTS = frozenset("tbody thead tfoot".split())
_ENDS_P = (BLOCK | frozenset({"search"})) - frozenset("body br caption frameset head html legend optgroup option tbody tfoot thead title tr".split())
_LISTED = CONTAINER - {"div"} | {"td", "th"}
#: Open elements that a start tag ends though their end tag is missing, and the elements beyond which it ends none.
IMPLIED = [
    (_ENDS_P, frozenset({"p"}), frozenset("table td th button object template html".split())),
    (frozenset({"li"}), frozenset({"li"}), _LISTED),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), _LISTED),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), _TABLE_PARTS | {"tr", "table", "template"}),
    (frozenset({"tr"}), frozenset({"tr"}), _TABLE_PARTS | {"table", "template"}),
    (_TABLE_PARTS, _TABLE_PARTS, frozenset({"table", "template"})),
]
#: Parts of a class, id or role that name boilerplate, and those that may as well name a subject of the text.
STRONG_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promos promotion nav navbar navigation navi menu menus menubar submenu breadcrumb breadcrumbs crumbs sidebar footer masthead topbar banner banners cookie cookies consent gdpr notice notices popup popups modal newsletter subscribe subscription signup login comment comments commentlist commentform commentbox disqus pagination pager paywall contentinfo complementary lightbox toolbar".split()
)
WEAK_MARKS = frozenset("social share sharing related recommended recommendations respond response responses reply replies discussion alert overlay toast rail aside widget widgets search skip dialog copyright disclaimer legal".split())
#: Parts that stand beside the former in compound names.
FILLERS = frozenset(
    "site main page global top bottom left right box block container wrapper wrap list item items area section bar panel link links form inner outer content post posts article articles story stories js l c m wp id primary secondary latest recent popular more header head title body unit slot space text row col column group buttons button icon icons user reader entry mobile desktop sticky fixed full side center".split()
)
#: Parts that make a "header" the head of the article itself.
OWN = frozenset(("article", "post", "entry", "content", "story", "main", "body", "text"))
#: What a mark leaves of a ratio, and the share of the average selected line that must be left.
STRONG, WEAK, KEPT_SHARE = 0.1, 0.8, 0.35
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
#: Numeric references beyond the digits that int() takes; no code point needs as many.
_LONG_REFERENCE = re.compile(r"&#[0-9]{1000,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _shortened(reference: re.Match[str]) -> str:
    return "&#" + (reference[0][2:].lstrip("0") or "0")[:8]


@lru_cache(maxsize=4096)
def mark(names: str) -> float:
    """What the names of a class, id or role leave of a ratio: 1, or less if one of them names boilerplate.

    A name counts if its last part is a strong mark, or if it is made of marks and fillers alone.
    """
    left = 1.0
    for name in names.split():
        parts = [p.lower() for p in _PARTS.split(name) if p]
        marks = STRONG_MARKS.intersection(parts)
        if "header" in parts and not OWN.intersection(parts) or "side" in parts and "bar" in parts:
            left = min(left, STRONG)
        elif marks and (parts[-1] in marks or all(p in marks or p in WEAK_MARKS or p in FILLERS for p in parts)):
            left = min(left, STRONG)
        elif WEAK_MARKS.intersection(parts) and all(p in WEAK_MARKS or p in FILLERS for p in parts):
            left = min(left, WEAK)
    return left


def judged(tag: str, attrs: list[tuple[str, str | None]]) -> float:
    """What an element leaves of the ratios inside it: 0 if it is hidden, less than 1 if it is marked."""
    left = 1.0
    for name, value in attrs:
        if name == "hidden":
            return 0.0
        if not value:
            continue
        if name == "class" or name == "role" or name == "id" and tag not in HEADINGS:  # the id of a heading is its anchor
            left = min(left, mark(value))
        elif name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return 0.0
    return left


class Line(NamedTuple):
    """A block: its text, the tags before it, what marks leave of its ratio, the number of its outermost article or 0."""

    text: str
    tags: int
    left: float
    article: int
    heading: bool
    container: int
    links: bool


class Blocks(HTMLParser):
    """Collects a line for every block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[Line] = []
        self.open: list[tuple[str, float]] = []  # container tags and what was left of ratios before they began
        self.left = 1.0
        self.articles = self.article = 0
        self.held: list[str] = []
        self.tags = 0
        self.heading = False
        self.container = self.anchors = self.linked = 0
        self.inner: list[int] = [0]

    def end_block(self) -> None:
        if self.held:
            text = _SPACE.sub(" ", "".join(self.held)).strip()
            self.held.clear()
            if text:
                self.found.append(Line(text, self.tags, self.left, self.article if self.articles else 0, self.heading, self.inner[-1], 2 * self.linked > len(text)))
                self.tags = 0
            self.linked = 0

    def close_from(self, k: int) -> None:
        """Close the open elements from the ``k``-th on."""
        self.end_block()
        self.left = self.open[k][1]
        self.articles -= sum(name in ("article", "main") for name, _ in self.open[k:])
        del self.open[k:], self.inner[k + 1 :]

    def close_implied(self, tag: str) -> None:
        """Close what the start of ``tag`` ends."""
        for starts, ended, beyond in IMPLIED:
            if tag in starts:
                for k in range(len(self.open) - 1, -1, -1):
                    if self.open[k][0] in ended:
                        self.close_from(k)
                        break
                    if self.open[k][0] in beyond:
                        break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open:
            self.close_implied(tag)
        if tag in BLOCK:
            self.end_block()
        elif tag in ("td", "th"):
            self.held.append(" ")
        self.tags += 1
        if tag in HEADINGS:
            self.heading = True
        self.anchors += tag == "a"
        if tag in VOID:
            return
        left = judged(tag, attrs) if attrs and tag not in ("html", "body") else 1.0
        if tag in CONTAINER or left < 1:
            if tag in SKIP or tag == "header" and not self.articles:
                left = 0.0
            if left < 1:
                self.end_block()
            if tag in ("article", "main"):
                self.article += not self.articles
                self.articles += 1
            self.open.append((tag, self.left))
            self.left *= left
            self.container += 1
            self.inner.append(self.container)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in CONTAINER:
            if tag in BLOCK:
                self.end_block()
            if self.open:
                self.close_implied(tag)
            self.tags += 1
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_block()
        self.tags += 1
        if tag in HEADINGS:
            self.heading = False
        if tag == "a" and self.anchors:
            self.anchors -= 1
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.close_from(k)
                break

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """End of a ``<![``: a comment up to the next ``>``, or CDATA within drawings and formulas."""
        cdata = self.rawdata.startswith("<![CDATA[", i) and any(name in ("svg", "math") for name, _ in self.open)
        close = "]]>" if cdata else ">"
        end = self.rawdata.find(close, i + 3)
        return end + len(close) if end >= 0 else len(self.rawdata)

    def handle_data(self, data: str) -> None:
        self.held.append(data)
        if self.anchors:
            self.linked += len(data)


def smoothed(ratios: np.ndarray) -> np.ndarray:
    """Ratios smoothed with a Gaussian over neighbouring lines."""
    x = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(x**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[RADIUS : RADIUS + len(ratios)]
    return np.convolve(ratios, kernel, "full")[RADIUS : RADIUS + len(ratios)] / weight


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = Blocks()
    parser.feed(_LONG_REFERENCE.sub(_shortened, html))
    parser.close()
    parser.end_block()
    lines = parser.found
    content = [k for k, x in enumerate(lines) if x.left]
    if not content:
        return ""
    left = np.array([x.left for x in lines])
    own = np.array([x.left * len(x.text) / max(x.tags, 1) for x in lines])
    score = smoothed(own) * left
    level = min(score.std(), score[content].max())
    plain = [k for k in content if lines[k].left == 1 and score[k] >= level]
    least = max(level, KEPT_SHARE * score[plain].mean()) if plain else level
    dropped = np.array([x.left < 1 and score[k] < least or not x.left for k, x in enumerate(lines)])
    chosen = [k for k in content if score[k] >= level and not dropped[k]]
    mass = [0, 0]
    for k in chosen:
        mass[lines[k].article > 0] += len(lines[k].text)
    inside = [k for k in content if lines[k].article and not dropped[k]]
    if inside and mass[1] >= mass[0]:
        articles = {lines[k].article for k in chosen} - {0} | {lines[k].article for k in inside if not lines[k].heading and not lines[k].links}
        return "\n".join(lines[k].text for k in inside if lines[k].article in articles or not articles)
    # an article that is but a teaser has no part in the region, unless its lines are long ones
    dropped |= np.array([x.article > 0 for x in lines]) & (own < level)
    chosen = [k for k in chosen if not dropped[k]] or chosen
    homes = {lines[k].container for k in chosen}
    begin, end = chosen[0], chosen[-1]
    # short paragraphs of the same containers belong to the region, also beyond dropped blocks, and so do
    # the headings that lead into it
    gap, k = False, begin - 1
    while k >= 0 and (dropped[k] or lines[k].heading and not gap or not lines[k].links and lines[k].container in homes):
        gap = gap or bool(dropped[k])
        begin = begin if dropped[k] else k
        k -= 1
    k = end + 1
    while k < len(lines) and (dropped[k] or not lines[k].links and lines[k].container in homes):
        end = end if dropped[k] or lines[k].heading else k  # a heading without text after it does not count
        k += 1
    region = (k for k in range(begin, end + 1) if not dropped[k] and (lines[k].container in homes or not lines[k].links))
    return "\n".join(lines[k].text for k in region)


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, column = [], batch.column(2)
            for row in column:
                texts.append(extract(row.as_py()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return mapped(slim, run, f"page_id {kind}, url string, text string").withColumn("n_chars", F.char_length("text").cast("long"))
