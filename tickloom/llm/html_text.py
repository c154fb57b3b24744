"""Main text of web pages by text-to-tag ratios over streamed parser events.

The standard library's parser is fed the page in slices. Its events build lines: runs of text between tags that break
a line. Each line has its ratio of characters to tags. The ratios are smoothed with a Gaussian and, as logarithms,
split into two clusters by a threshold (Weninger, Hsu and Han, "CETR: content extraction via tag ratios", 2010). The
lines of the upper cluster decide what is content; tags and classes are evidence that changes a line's value, and
borders that a region may have:

* a heading is judged by the line it introduces;
* an element that is marked as no content, by its tag, role or class, has its lines' ratios multiplied by DOUBT. Only
  comparison counts, so a mark around the whole page changes nothing;
* the region is the deepest element that holds SHARE of the upper cluster's characters and is made of them for the
  most part. It grows to the article or main element around it, and to any element, as long as what that adds is made
  of the upper cluster for the most part too;
* all lines in the region are kept, but for marked elements inside it, and lists of links, that hold less of the upper
  cluster than not. So short paragraphs of an article stay.

Only text that no reader sees as text (scripts, styles, form controls, hidden elements, ...) is left out beforehand.

Defined cases: a null or empty page, and one without text, give an empty text; unclosed and stray tags are tolerated; a
page that is plain text is one line; a long page is parsed in slices, its whole text is kept, and time and memory grow
in proportion to it; equal rows give equal results; further columns of the input are kept as they are, whatever their
names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, carried, sized_batches, trimming

SLICE = 1 << 16
#: Lines over which ratios are smoothed; the share of the upper cluster's characters that a region holds; what a mark multiplies a ratio by.
SIGMA, SHARE, DOUBT = 1.0, 0.6, 0.005

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not break a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Elements whose text no reader sees as text of the page.
NEVER = frozenset("script style noscript template head title form button select option textarea input label iframe object svg canvas dialog audio video map".split())
#: Elements and roles that say they are no main content; header is judged by where it stands and what it holds.
ASIDE = frozenset("nav aside footer menu header".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = frozenset(("article", "main"))
#: Elements that hold lines of their own but no further structure.
LEAVES = HEADINGS | frozenset("p li blockquote pre td th tr dd dt figcaption caption".split())
#: Words that mark a class or id anywhere in it, and words that mark it as its last word ("post-tags", not "tags-article").
ANYWHERE = frozenset("advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus gdpr newsletter popup modal promo promoted promotion related share sharing sidebar social sponsor sponsored subscribe subscription".split())
LAST = frozenset("ad ads adbox banner footer header login masthead menu nav navbar navigation notice notices pager pagination recommended replies reply respond signup tags toolbar topbar widget".split())
#: First words of classes that tell what a page has, not what an element is, and last words that overrule marks.
STATES, OVERRULE = frozenset("has with no without is not hide show".split()), frozenset("article main story entry".split())
#: Tags whose start ends an open element of the same group.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def marks(value: str) -> set[str]:
    """Words by which a class or id says that its element is no main content."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _PARTS.split(name) if w]
        if words and words[0] not in STATES and words[-1] not in OVERRULE:
            found |= ANYWHERE.intersection(words) | LAST.intersection(words[-1:])
    return found


class _Element:
    """A node of the page; held and upper are characters of all its lines and of those in the upper cluster."""

    __slots__ = ("tag", "parent", "shown", "marked", "header", "depth", "doubt", "heading", "held", "upper", "linked", "kept")

    def __init__(self, tag, parent, shown, marked, header):
        self.tag, self.parent, self.shown, self.marked, self.header = tag, parent, shown, marked, header
        self.depth = parent.depth + 1 if parent else 0
        self.doubt, self.heading, self.kept = 1.0, False, False
        self.held = self.upper = self.linked = 0


class Line:
    __slots__ = ("text", "tags", "at", "linked")

    def __init__(self, text, tags, at, linked):
        self.text, self.tags, self.at, self.linked = text, tags, at, linked


class Lines(HTMLParser):
    """Collects the page's lines and its elements, parents first."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, True, False, False)
        self.elements = [self.at]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = 0

    def flush(self):
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append(Line(text, self.tags, self.at, min(self.linked, len(text))))
                self.tags = 0
            self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in INLINE:
            if tag == "br":
                self.parts.append(" ")
            if tag in VOID or not attrs:
                return  # attributes alone could hide an inline element
        self.close_before(tag)
        element = self.element(tag, attrs)
        if tag not in INLINE or element.shown != self.at.shown:
            self.flush()
        if tag not in VOID:
            self.at = element
            self.elements.append(element)

    def close_before(self, tag):
        closes = CLOSES.get(tag) or (("p",) if tag not in INLINE else ())
        at = self.at
        while at.parent and (at.tag in INLINE or at.tag in closes):
            if at.tag in closes:
                self.flush()
                self.at = at.parent
                return
            at = at.parent

    def element(self, tag, attrs):
        shown, found = self.at.shown and tag not in NEVER, {tag} if tag in ASIDE else set()
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
                shown = False
            elif name == "role" and value in ROLES:
                found.add(value)
            elif name in ("class", "id") and tag not in ("html", "body", "main", "article"):
                found |= marks(value)
        return _Element(tag, self.at, shown, bool(found - {"header"}), "header" in found)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        at = self.at
        while at.parent and at.tag != tag:
            if at.tag in CONTENT or at.tag in NEVER and tag in INLINE:
                break
            at = at.parent
        if at.parent and at.tag == tag:
            if tag not in INLINE or at.parent.shown != self.at.shown:
                self.flush()
            self.at = at.parent
        elif tag not in INLINE:
            self.flush()

    def handle_data(self, data):
        if self.at.shown:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parsed(html: str) -> Lines:
    parser = Lines()
    try:
        for lo in range(0, len(html), SLICE):
            parser.feed(html[lo : lo + SLICE])
        parser.close()
    except AssertionError:  # the parser gives up on some malformed declarations: they are then text
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser.flush()
    return parser


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]
    return np.convolve(ratios, kernel)[reach : reach + len(ratios)] / weight


def upper_cluster(values: np.ndarray) -> np.ndarray:
    """Which values lie above the threshold between two clusters (means that settle)."""
    low, high = values.min(), values.max()
    for _ in range(50):
        cut = (low + high) / 2
        above = values >= cut
        means = values[~above].mean() if not above.all() else low, values[above].mean()
        if means == (low, high):
            break
        low, high = means
    return values >= (low + high) / 2


def _line_element(at: _Element) -> _Element:
    """The element that breaks the line which `at` stands in."""
    while at.parent and at.tag in INLINE:
        at = at.parent
    return at


def line_values(page: Lines) -> np.ndarray:
    """The logarithm of each line's smoothed ratio, after doubts."""
    tags = [_line_element(x.at).tag for x in page.lines]
    for x, tag in zip(page.lines, tags, strict=True):
        if tag in HEADINGS:
            at = x.at
            while at and not at.heading:
                at.heading, at = True, at.parent
    for e in page.elements[1:]:
        within = e.parent
        doubtful = e.marked or e.header and not e.heading and _holder(within).tag not in CONTENT
        e.doubt = within.doubt * (DOUBT if doubtful else 1.0)
    ratios = np.array([len(x.text) / max(1, x.tags) for x in page.lines])
    doubts = np.array([x.at.doubt for x in page.lines])
    cuts = np.flatnonzero(np.diff(doubts)) + 1  # what is marked and what is not do not smooth each other
    ratios = np.concatenate([smoothed(part) for part in np.split(ratios, cuts)])
    for i in range(len(ratios) - 2, -1, -1):
        if tags[i] in HEADINGS:
            ratios[i] = max(ratios[i], ratios[i + 1])
    return np.log1p(ratios * doubts)


def content_lines(page: Lines, chosen: np.ndarray) -> list[str]:
    """The lines of the region that the chosen ones point out."""
    for x, good in zip(page.lines, chosen, strict=True):
        x.at.held += len(x.text)
        x.at.upper += len(x.text) if good else 0
        x.at.linked += x.linked
    for e in reversed(page.elements[1:]):  # children come after their parents
        e.parent.held += e.held
        e.parent.upper += e.upper
        e.parent.linked += e.linked
    root = page.elements[0]
    if not root.upper:
        return []
    sound = [e for e in page.elements if 2 * e.upper >= e.held and e.upper]
    region = max((e for e in sound if e.upper >= SHARE * root.upper), key=lambda e: e.depth, default=None)
    if region is None:  # what is chosen lies scattered: the sound element with most of it
        region = max(sound, key=lambda e: (e.upper, -e.depth), default=None)
        if region is None:
            return [x.text for x, good in zip(page.lines, chosen, strict=True) if good]
    while region.parent and (region.tag in INLINE or region.tag in LEAVES):
        region = region.parent
    holder = _holder(region)
    if holder.tag in CONTENT and 2 * holder.upper >= holder.held:
        region = holder
    at = region
    while at.parent:  # to the highest element whose additions are sound
        at = at.parent
        added, good = at.held - region.held, at.upper - region.upper
        if added and 2 * good >= added:
            region = at
    for e in page.elements:
        if e is region:
            e.kept = True
        elif e.parent and e.parent.kept:
            listed = 2 * e.linked > e.held and e.tag not in LEAVES and e.tag not in INLINE and e.tag not in CONTENT
            e.kept = 2 * e.upper >= e.held or not (listed or e.doubt < e.parent.doubt)
    return [x.text for x in page.lines if x.at.kept]


def main_text(html: str | None) -> str:
    """Content lines of a page, joined by line ends."""
    page = parsed(html or "")
    return "\n".join(content_lines(page, upper_cluster(line_values(page)))) if page.lines else ""


def _holder(at: _Element) -> _Element:
    """The nearest article or main element around, or the root."""
    while at.parent and at.tag not in CONTENT:
        at = at.parent
    return at


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """row (a struct of the columns of pages but the html) and text for every row."""
    rows = bound_batches(pages.select(F.col(f"`{html}`").alias("html"), carried(pages, html).alias("row")))

    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized_batches(batches, "html"):
            texts = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.record_batch([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("text", T.StringType())]))


def page_report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    out = extract(pages.select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))
