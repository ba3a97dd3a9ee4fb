"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A page is read once as a stream of parser events. Block tags cut it into lines; a line has its text, the tags since the
line before and the element it stands in. Elements that are boilerplate by their kind or role are skipped; those whose class
or id names boilerplate are dropped after the parse, unless they turn out to hold the page's article or most of its text. The
ratios of the lines are smoothed, and lines above a threshold are content; the region that holds them is the article, or
else the smallest element around them, and gives its other lines too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from veridoc.llm.common import slices, to_python

#: Standard deviation of the smoothing, in lines, and the share of the smoothed mean above which a line is content.
SIGMA = 1.0
THRESHOLD = 0.5
#: An article element is taken as the region if it has this share of the content's characters.
ARTICLE_SHARE = 0.4
#: A line that is a link to this share is no text of the article unless it stands between its lines.
LINK_SHARE = 0.6
#: An element with more than this share of the page's text outside links is no boilerplate, whatever its name.
NAMED_SHARE = 0.5

# Names of HTML: fixed values.
BLOCKS = frozenset("""address article aside blockquote body br button canvas caption center col colgroup dd details dialog dir div dl dt
fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main map menu nav noscript
ol option optgroup output p pre search section select summary table tbody td template textarea tfoot th thead title tr ul video""".split())
ENDS_P = BLOCKS - frozenset("br button canvas iframe map noscript option output select template textarea video".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = frozenset("""aside audio button canvas datalist dialog footer form head iframe menu nav noscript object script search select
style svg template textarea title video""".split())
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
# Words of class and id values that name boilerplate: whole words, and beginnings of words.
SKIPPED_WORDS = frozenset("""ad ads adv adbox adslot adunit alert alerts aside banner bottombar comments consent crumbs dialog disclaimer
discussion disqus donate feedback foot footer gdpr header hidden legal login masthead menu modal nav navi navbar overlay pager pagination
paywall popup promo promos rail recirc related reply replies respond search share sharing side sidenav signup skip social sponsor teaser
teasers toolbar topbar tracking widget widgets""".split())
SKIPPED_STARTS = ("advert", "breadcrumb", "comment", "cookie", "copyright", "newsletter", "navigation", "notice", "notification", "outbrain",
                  "popover", "promot", "recommend", "sidebar", "sponsored", "subscri", "taboola")
# A class that says what an element has beside it, such as "with-sidebar", does not name the element.
_BESIDE = frozenset("has have no with without".split())
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    if tag in SKIPPED or tag == "header" and not inside_article:
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "role" and (value or "").lower() in SKIPPED_ROLES or name == "style" and _HIDDEN.search(value or ""):
            return True
    return False


def _named(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> bool:
    """A word of the class or id names boilerplate."""
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        for each in (value or "").split() if name in ("class", "id") else ():
            words = [w.lower() for w in _WORDS.findall(each)]
            for word in words if not _BESIDE.intersection(words[:1]) else ():
                if word in SKIPPED_WORDS and not (word == "header" and inside_article) or word.startswith(SKIPPED_STARTS):
                    return True
    return False


class _Element:
    __slots__ = ("tag", "parent", "depth", "skipped", "named", "article")

    def __init__(self, tag: str, parent: _Element | None, skipped: bool, named: bool = False):
        self.tag, self.parent, self.skipped, self.named = tag, parent, skipped, named
        self.depth = parent.depth + 1 if parent else 0
        self.article = tag in ("article", "main") or bool(parent and parent.article)


class _Lines(HTMLParser):
    """Collects lines as (parts, tags, element); a part is (text, element, whether it is in a link)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.at = _Element("", None, False)
        self.parts: list[tuple[str, _Element, bool]] = []
        self.tags = self.links = 0
        self.lines: list[tuple[list[tuple[str, _Element, bool]], int, _Element]] = []

    def _cut(self) -> None:
        if self.parts:
            self.lines.append((self.parts, self.tags, self.at))
            self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "a":
            self.links += 1
        inline = tag not in BLOCKS
        if not inline:
            self._cut()
            self._imply(tag)
        if tag in VOID:
            return
        boilerplate = not self.at.skipped and _boilerplate(tag, attrs, self.at.article)
        named = not self.at.skipped and not boilerplate and _named(tag, attrs, self.at.article)
        if inline and not boilerplate and not named and tag not in SKIPPED:
            return
        self.at = _Element(tag, self.at, self.at.skipped or boilerplate, named)

    def _imply(self, tag: str) -> None:
        """Ends that HTML leaves out, and those of boilerplate that can't hold an article but was left open before one."""
        if tag in ("article", "main"):
            e = self.at
            while e.parent:
                if e.tag in ("nav", "header", "form", "head", "button", "select") or tag == "main" and e.skipped:
                    self.at = e.parent
                e = e.parent
        ends = ("p",) if tag in ENDS_P else ()
        ends += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
                 "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        while self.at.tag in ends:
            self.at = self.at.parent

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if tag in BLOCKS:
            self._cut()
        e = self.at
        while e.parent and e.tag != tag:
            e = e.parent
        if e.parent:
            self.at = e.parent

    def handle_data(self, data: str) -> None:
        if not self.at.skipped:
            self.parts.append((data, self.at, self.links > 0))


def _dropped(lines: list[tuple[list[tuple[str, _Element, bool]], int, _Element]]) -> set[_Element]:
    """Elements that go by their name: none that holds a large share of the text, or the only articles of the page."""
    total, sizes, holders, outside = 0, {}, set(), False
    for parts, _, _ in lines:
        for data, e, link in parts:
            size = sum(map(len, data.split()))
            if not size:
                continue
            total += 0 if link else size
            article = named = False
            while e is not None:
                if e.named:
                    named = True
                    sizes[e] = sizes.get(e, 0) + (0 if link else size)
                    if article:
                        holders.add(e)
                article = article or e.tag in ("article", "main")
                e = e.parent
            outside = outside or article and not named
    return {e for e, size in sizes.items() if size <= NAMED_SHARE * total and (outside or e not in holders)}


def _kept(e: _Element | None, dropped: set[_Element]) -> bool:
    while e is not None:
        if e in dropped:
            return False
        e = e.parent
    return True


def _texts(lines: list[tuple[list[tuple[str, _Element, bool]], int, _Element]], dropped: set[_Element]) -> list[tuple[str, int, int, _Element]]:
    """(text, tags, link characters, element) of the lines with text; tags of lines without any count for the next one."""
    out, before = [], 0
    for parts, tags, at in lines:
        before += tags
        kept = [x for x in parts if not dropped or _kept(x[1], dropped)]
        text = " ".join("".join(data for data, _, _ in kept).split())
        if text:
            out.append((text, before, sum(len(data) for data, _, link in kept if link), at))
            before = 0
    return out


def lines_of(html: str) -> list[tuple[str, int, int, _Element]]:
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._cut()
    return _texts(parser.lines, _dropped(parser.lines)) or _texts(parser.lines, set())


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights that are there are scaled up."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach:reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach:reach + len(ratios)]


def content_lines(lines: list[tuple[str, int, int, _Element]]) -> np.ndarray:
    """Which lines are content by their smoothed text-to-tag ratio; at least one is."""
    ratios = np.array([(len(text) - linked) / max(1, tags) for text, tags, linked, _ in lines])
    even = smooth(ratios)
    # A neighbour lifts a line of links over the threshold, but does not make it text.
    links = np.array([linked >= LINK_SHARE * len(text) for text, _, linked, _ in lines])
    found = (even >= max(THRESHOLD * even.mean(), 1e-9)) & ~links
    if not found.any():
        found[int(ratios.argmax())] = True
    return found


def _inside(e: _Element, region: _Element) -> bool:
    while e is not None and e.depth > region.depth:
        e = e.parent
    return e is region


def main_text(html: str | None) -> str:
    """The text of the content region: lines in page order, joined by one space; empty if there is none."""
    lines = lines_of(html or "")
    if not lines:
        return ""
    found = content_lines(lines)
    size, articles = 0, {}
    for (text, _, _, e), content in zip(lines, found):
        if content:
            size += len(text)
            outer = None
            while e is not None:
                outer = e if e.tag in ("article", "main") else outer
                e = e.parent
            if outer is not None:
                articles[outer] = articles.get(outer, 0) + len(text)
    regions = [e for e, n in articles.items() if n >= ARTICLE_SHARE * size]
    if regions:
        return " ".join(text for text, _, _, e in lines if any(_inside(e, r) for r in regions))
    region = None
    for (_, _, _, e), content in zip(lines, found):
        if content:
            if region is None:
                region = e
            while not _inside(e, region):
                region = region.parent
    # Around content lines, short lines of the same elements belong to the text; lists of links do not.
    homes = {e for (_, _, _, e), content in zip(lines, found) if content}
    homes |= {e.parent for e in homes if e.tag in ("p", "li", "td", "span", "pre", "blockquote", "h1", "h2", "h3")}
    out = []
    for (text, _, linked, e), content in zip(lines, found):
        near = e in homes or e.parent in homes
        plain = linked < LINK_SHARE * len(text) or e.tag in ("p", "h1", "h2", "h3", "h4", "blockquote")
        if _inside(e, region) and (content or near and plain):
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, html: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All columns of `pages` but `html`, `text` and `n_chars`, and the main text with its length in code points.

    Whole pages are read. Null, empty and text-free pages give an empty text and 0; pages without any tag give their text;
    repeated rows are pages of their own; an empty table gives an empty one.
    """
    kept = [c for c in pages.columns if c not in (html, text, n_chars)]
    source = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(kept)], pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [*kept, text, n_chars])

    fields = source.schema.fields[:len(kept)]
    return to_python(source).mapInArrow(run, T.StructType([*fields, T.StructField(text, T.StringType()), T.StructField(n_chars, T.LongType())]))
