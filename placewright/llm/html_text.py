"""Main-text extraction from HTML (operator 8).

The standard library's parser streams events; they form lines (blocks of text
between block-level tags), each with its characters, tags and linked characters.
The text-to-tag ratio of the lines,

    (characters - 2 * linked characters) / (1 + tags),

is smoothed by a Gaussian and split by a threshold into a dense and a sparse
cluster.  The content region is the deepest container (div, section, table cell,
...) that holds ``SHARE`` of the dense lines' characters, counted in full: its
lines from the first to the last dense one, and those before and after that
stand in the region itself and not in a container of their own without a dense
line.  Lines that are mostly links go.

Names are features of a line, not the choice of the region: a line inside an
element that is no article (navigation, forms, remarks, adverts, and elements
whose class, id or role says so) has the ratio 0 and is never content; a line
inside ``article`` or ``main`` counts double, and the region never ends inside
such an element.

All steps are linear in the page: open elements are kept with their places by
name, so that no event walks through the stack.

Defined cases: null or empty html gives empty text; unclosed elements, cut-off
tags and unknown entities are accepted (a tag cut off by the end of the page is
markup, not text); declarations other than comments, marked sections (``<![``)
and abrupt comments (``<!-->``) are markup up to the next ``>``, a comment
without an end reaches to the end of the page; null page_id or url and repeated
rows are kept; other columns are ignored; nothing is cut off or capped.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table

SIGMA = 1.0
SHARE = 0.8
# Element names and the words of class, id and role that mark what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head title nav header footer aside form script style noscript template button select option textarea svg math iframe object canvas audio video dialog menu".split())
OPAQUE = frozenset("script style noscript template head title".split())
ARTICLE = frozenset("article main".split())
LANDMARK = ("nav", "header", "footer", "aside", "form")
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption address summary tr thead tbody tfoot ul ol dl figure table center legend".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus discussion footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets alert complementary contentinfo dialog".split()
)
COMMENT_WORDS = frozenset("comment comments disqus discussion replies reply respond".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_WORD = re.compile(r"[a-z]+")
_TAIL = re.compile(r"<(?:[A-Za-z/!?]|\Z)")
_COMMENT_END = re.compile(r"--!?>")


class _Lines(HTMLParser):
    """Lines of a page, and the tree of the containers they stand in.

    A line is [text, tags, linked characters, container, weight of its names].
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names: list[str] = []
        self.state: list[tuple[bool, bool, bool, int, float]] = []  # dropped, opaque, of remarks, container, weight
        self.open: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # places of open elements that are not inline
        self.fences: list[int] = []  # those of them that are not p
        self.up = [-1]  # parent of every container
        self.article = [False]
        self.lines: list[list] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            dropped, _, _, box, weight = self.state[-1] if self.state else (False, False, False, 0, 1.0)
            self.lines.append([text, self.tags, self.linked, box, 0.0 if dropped else weight])
            self.tags = self.linked = 0
        self.parts = []

    def push(self, tag: str, state: tuple[bool, bool, bool, int, float]) -> None:
        at = len(self.names)
        self.names.append(tag)
        self.state.append(state)
        self.open.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
            if tag != "p":
                self.fences.append(at)

    def cut(self, at: int) -> None:
        """Close all elements from place ``at`` on."""
        while len(self.names) > at:
            self.open[self.names.pop()].pop()
            self.state.pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        while self.fences and self.fences[-1] >= at:
            self.fences.pop()

    def implied_ends(self, tag: str) -> None:
        """Close the elements that the start of ``tag`` ends without an end tag."""
        if tag in ARTICLE:
            at = min((self.open[n][0] for n in LANDMARK if self.open.get(n)), default=-1)
            if at >= 0:
                self.cut(at)
        for shut in CLOSES.get(tag, ()) if tag in CLOSES else (() if tag in INLINE else ("p",)):
            places = self.open.get(shut)
            if places and (not self.fences or self.fences[-1] <= places[-1]):
                self.cut(places[-1])
                if tag == "tr":
                    self.implied_ends(tag)
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag in VOID:
            return
        self.implied_ends(tag)
        dropped, opaque, remarks, box, weight = self.state[-1] if self.state else (False, False, False, 0, 1.0)
        own = {k: v or "" for k, v in attrs}
        whole = tag in ("html", "body")
        named = set(_WORD.findall(" ".join(own.get(k, "") for k in ("class", "id", "role")).lower()))
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        remarks = remarks or bool(named & COMMENT_WORDS and not whole)
        opaque = opaque or tag in OPAQUE
        if tag in ARTICLE:
            dropped = hidden or remarks or opaque
            weight = 2.0
        else:
            dropped = dropped or tag in DROPPED or hidden or (not whole and bool(named & BAD_WORDS))
        if tag not in INLINE and tag not in LEAF and not whole:
            self.up.append(box)
            self.article.append(tag in ARTICLE)
            box = len(self.up) - 1
        self.push(tag, (dropped, opaque, remarks, box, weight))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        places = self.open.get(tag)
        if places and not (tag in INLINE and self.blocks and self.blocks[-1] > places[-1]):
            self.cut(places[-1])

    def handle_data(self, data: str) -> None:
        if self.state and self.state[-1][1]:
            return
        self.parts.append(data)
        if self.open.get("a"):
            self.linked += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        """Any ``<!...`` that is no comment is markup up to the next ``>``."""
        end = self.rawdata.find(">", i)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        raw = self.rawdata
        for abrupt in ("<!-->", "<!--->"):
            if raw.startswith(abrupt, i):
                return i + len(abrupt)
        end = _COMMENT_END.search(raw, i + 4)
        return end.end() if end else len(raw)


def _smooth(values: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in enumerate(kernel, i - reach):
            if 0 <= d < len(values):
                total += k * values[d]
                weight += k
        out.append(total / weight)
    return out


def _threshold(values: list[float]) -> float:
    """Boundary of two clusters (one-dimensional two-means from the extremes)."""
    low, high = min(values), max(values)
    cut = (low + high) / 2
    for _ in range(20):
        a, b = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not a or not b:
            break
        new = (sum(a) / len(a) + sum(b) / len(b)) / 2
        if new == cut:
            break
        cut = new
    return cut


def _dense(lines: list[list]) -> list[bool]:
    """Which lines belong to the dense cluster."""
    ratio = [w * max(0.0, len(t) - 2.0 * linked) / (1 + tags) for t, tags, linked, _, w in lines]
    smooth = _smooth(ratio, SIGMA)
    cut = _threshold(smooth)
    dense = [v >= cut and r > 0 for v, r in zip(smooth, ratio)]
    # all that counts may lie below the boundary where one line is far denser than its neighbours
    for rest in ([r > 0 for r in ratio], [x[4] > 1 for x in lines]):
        dense = dense if any(dense) else rest
    return dense


def _region(page: _Lines, dense: list[bool]) -> tuple[int, list[bool]]:
    """The container that holds the dense cluster, and which containers have a dense line."""
    size = [0.0] * len(page.up)
    for (text, _, _, box, weight), d in zip(page.lines, dense):
        if d:
            size[box] += weight * len(text)
    total = sum(size)
    for box in range(len(size) - 1, 0, -1):  # parents come before their children
        size[page.up[box]] += size[box]
    best = 0
    for box in range(1, len(size)):
        if page.up[box] == best and size[box] >= SHARE * total:
            best = box
    # the region is never a part of an article
    box, above = best, best
    while box > 0:
        if page.article[box]:
            above = box
        box = page.up[box]
    return above, [s > 0 for s in size]


def _chosen(page: _Lines) -> list[str]:
    lines = page.lines
    if not any(x[4] for x in lines):
        return []
    dense = _dense(lines)
    if not any(dense):
        return []  # links alone
    region, held = _region(page, dense)
    inside = [False] * len(page.up)  # in the region
    bare = [False] * len(page.up)  # there, and in no container of its own without a dense line
    for box in range(len(page.up)):
        up = page.up[box]
        inside[box] = box == region or (up >= 0 and inside[up])
        bare[box] = inside[box] and (box == region or (bare[up] and (held[box] or page.article[region])))
    at = [i for i, d in enumerate(dense) if d and inside[lines[i][3]]]
    first, last = at[0], at[-1]
    return [
        text
        for i, (text, _, linked, box, weight) in enumerate(lines)
        if weight and inside[box] and (first <= i <= last or bare[box]) and (dense[i] or weight > 1 or 2 * linked <= len(text))
    ]


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    last = html.rfind(">") + 1
    torn = _TAIL.search(html, last)
    page = _Lines()
    page.feed(html[: torn.start()] if torn else html)
    page.close()
    page.flush()
    return " ".join(_chosen(page))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
