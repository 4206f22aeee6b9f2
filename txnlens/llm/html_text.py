"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams a page's events into lines: a line is the
text between two block-level tags or line breaks, with the number of tags and the
share of link text in it. A line's ratio is its characters per tag. The ratios are
smoothed with a Gaussian over neighbouring lines, and the standard deviation of the
smoothed ratios parts content lines from the rest. The content lines select a
region: the article or main element (or, where a page has none, the innermost
container) that holds them; all lines of the region that are not boilerplate by
their element are the text, so short paragraphs between long ones stay. A class or id
makes an element boilerplate only if it does not hold the page's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMOOTHING_RADIUS = 2
SMOOTHING_SIGMA = 1.0
#: Share of the content lines' characters that a container must hold where no article is marked.
CONTAINER_SHARE = 0.85

SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long, n_content_lines long"

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr img picture".split())
_CONTAINERS = frozenset("body div section main article td table center".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never part of the text, wherever they stand.
_DROPPED = frozenset("head title script style noscript template nav footer aside form button select option textarea fieldset menu "
                     "dialog iframe object svg canvas audio video map".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that mark boilerplate.
_DROPPED_NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar banner ad ads adv advert "
                           "adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
                           "alert popup modal overlay newsletter subscribe signup login share sharing social related recommended "
                           "recommendations comment comments disqus replies reply respond response responses widget toolbar pagination pager skip hidden".split())
#: Of those, the ones that also disqualify an article or main element.
_DROPPED_ARTICLES = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply response teaser".split())
#: Elements that a new one of the same kind closes.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
                 "th": {"td", "th"}, "option": {"option"}}
#: Elements that end the search for one that a new element closes.
_BOUNDS = _CONTAINERS | {"ul", "ol", "dl"}
_NAME = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"[A-Z]?[a-z]{4,}")
#: Boilerplate words that also count where they are written together with a word for a part of a page or its readers.
_STEM = "ads?|advert|breadcrumbs?|comments?|consent|cookies?|disqus|footer|nav|navigation|newsletter|related|replies|repl(?:y|ies)|responses?|share|sharing|sidebar|social|sponsor|sponsored|toolbar|widgets?"
_BEFORE = "blog|bottom|fb|global|left|main|page|post|reader|readers|right|site|sub|top|user|users|wp"
_AFTER = "area|articles|bar|banner|block|body|box|buttons|container|feed|form|icons|item|items|links|list|menu|notice|panel|posts|section|slot|stories|thread|unit|wrap|wrapper"
_TOGETHER = re.compile(f"(?:{_BEFORE})(?P<stem>{_STEM})(?:{_AFTER})?|(?P<first>{_STEM})(?:{_AFTER})")


def _names(attrs: dict[str, str]) -> set[str]:
    """Words of class and id, also those of camel case and boilerplate words written together with others."""
    text = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    words = set(_NAME.findall(text.lower()))
    out = words | {w.lower() for w in _CAMEL.findall(text)} & _DROPPED_NAMES
    for word in words:
        if m := _TOGETHER.fullmatch(word):
            out.add(m["stem"] or m["first"])
    return out


class PageLines(HTMLParser):
    """Lines of a page: text, tags, characters of link text, whether boilerplate, and the enclosing region, container, named element and article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: open elements: (tag, boilerplate, region, container, innermost element with a boilerplate name, innermost article)
        self.open: list[tuple[str, bool, int, int, int, int]] = []
        self.parent: list[int] = [-1]  # of containers
        self.lines: list[tuple[str, int, int, bool, int, int, int, int]] = []
        #: of each region, the named element around it; of each named element, the next one, the article and the region around it
        self.regions: list[int] = [0]
        self.named: list[tuple[int, int, int]] = [(0, 0, 0)]
        #: of each article, the one around it
        self.articles: list[int] = [0]
        #: places in ``open`` of the elements of a tag, of those that are not inline, and of those that end a search
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.bounds: list[int] = []
        self.pieces: list[str] = []
        self.tags = self.link_chars = 0
        self.unclosed: set[str] = set()  # ends that the rest of the page does not have

    def read(self, html: str) -> None:
        """All events of a page. What follows the last bracket has no tags, so it is not searched for them."""
        at = html.rfind(">") + 1
        self.feed(html[:at])
        self.close()
        if self.cdata_elem is None:
            self.handle_data(unescape(html[at:]))
        self.end_line()

    def parse_comment(self, i: int, report: int = 1) -> int:
        if "-->" in self.unclosed:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.unclosed.add("-->")
        return end

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """Sections of character data up to their end; others are comments up to the next bracket."""
        if self.rawdata.startswith("<![CDATA[", i) and "]]>" not in self.unclosed:
            end = self.rawdata.find("]]>", i)
            if end >= 0:
                return end + 3
            self.unclosed.add("]]>")
        return self.parse_bogus_comment(i, 0)

    def state(self) -> tuple[bool, int, int, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0, 0, 0)

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            self.lines.append((text, self.tags, self.link_chars, *self.state()))
            self.tags = 0
        self.pieces, self.link_chars = [], 0

    def boilerplate(self, tag: str, attrs: dict[str, str], region: int) -> bool:
        """By tag, role or style, which is final."""
        if tag in _DROPPED or attrs.get("role", "").lower() in _DROPPED_ROLES or "hidden" in attrs:
            return True
        if attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return True
        return tag == "header" and not region

    def boilerplate_name(self, tag: str, attrs: dict[str, str], region: int) -> bool:
        """By a word of class or id, which holds unless the element has the page's text (``lifted``)."""
        if tag in ("html", "body", "header") or tag in _INLINE:
            return False
        names = _names(attrs)
        if tag in ("article", "main"):
            return bool(names & _DROPPED_ARTICLES)
        if "header" in names:
            return not region or tag not in ("div", *_HEADINGS)
        return bool(names & _DROPPED_NAMES)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in _INLINE:
            self.end_line()
        self.tags += 1
        if tag in _VOID:
            return
        if closes := _SELF_CLOSING.get(tag):
            last = max(self.last(c) for c in closes)
            if last >= 0 and last >= (self.bounds[-1] if self.bounds else -1):
                self.close_from(last)
        dropped, region, container, named, article = self.state()
        values = {k: v or "" for k, v in attrs}
        dropped = dropped or self.boilerplate(tag, values, region)
        if not dropped and self.boilerplate_name(tag, values, region):
            self.named.append((named, article, region))
            named = len(self.named) - 1
        elif not dropped and (tag in ("article", "main") or values.get("role") in ("main", "article")):
            self.articles.append(article)
            article = len(self.articles) - 1
            if not region:
                self.regions.append(named)
                region = len(self.regions) - 1
        if tag in _CONTAINERS:
            self.parent.append(container)
            container = len(self.parent) - 1
        here = len(self.open)
        self.places.setdefault(tag, []).append(here)
        if tag not in _INLINE:
            self.blocks.append(here)
        if tag in _BOUNDS:
            self.bounds.append(here)
        self.open.append((tag, dropped, region, container, named, article))

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, -1 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def close_from(self, i: int) -> None:
        for tag, *_ in self.open[i:]:
            self.places[tag].pop()
        for places in (self.blocks, self.bounds):
            while places and places[-1] >= i:
                places.pop()
        del self.open[i:]

    def handle_endtag(self, tag: str) -> None:
        if tag not in _INLINE:
            self.end_line()
        self.tags += 1
        last = self.last(tag)
        # a stray inline end tag closes no block
        if last >= 0 and not (tag in _INLINE and self.blocks and self.blocks[-1] > last):
            self.close_from(last)

    def handle_data(self, data: str) -> None:
        self.pieces.append(data)
        if self.places.get("a"):
            self.link_chars += len(data)


def smoothed(ratios: np.ndarray, radius: int = SMOOTHING_RADIUS, sigma: float = SMOOTHING_SIGMA) -> np.ndarray:
    """Gaussian-weighted means over neighbouring lines; lines beyond the ends count for nothing."""
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel, "full")[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel, "full")[radius:radius + len(ratios)] / weight


def content_lines(lines: list[tuple]) -> np.ndarray:
    """Flags of the lines whose smoothed text-to-tag ratio reaches the page's threshold."""
    s = smoothed(np.array([len(t) / max(1, tags) for t, tags, *_ in lines], dtype=np.float64))
    return s >= min(s.std(), s.max())


def lifted(page: PageLines, content: np.ndarray) -> set[int]:
    """Elements with a boilerplate name that are none, as they hold the page's text.

    Those are the ones around the article with the most content text, if that is most of
    the page's or no other article stands outside of such elements, and each that holds
    most content text of the region around it, or else the page, while no article beside
    it has any.
    """
    seeds = [(len(line[0]), *line[4:]) for line, c in zip(page.lines, content, strict=True) if c and not line[3] and line[2] <= 0.5 * len(line[0])]
    whole = sum(size for size, *_ in seeds)
    of_region: dict[int, int] = {}
    in_articles: dict[int, int] = {}  # seeds of a region that stand in an article; 0: of the page
    by_article = [0] * len(page.articles)
    n_named = len(page.named)
    held, placed, same = [0] * n_named, [0] * n_named, [0] * n_named  # size, seeds in an article, and in the article around the element
    for size, region, _, named, article in seeds:
        of_region[region] = of_region.get(region, 0) + size
        held[named] += size
        if article:
            for r in {0, region}:
                in_articles[r] = in_articles.get(r, 0) + 1
            by_article[article] += 1
            placed[named] += 1
            same[named] += article == page.named[named][1]
    # elements and articles are numbered in the order they open, so those inside come after those around them
    for n in range(n_named - 1, 0, -1):
        outer, article, _ = page.named[n]
        held[outer] += held[n]
        placed[outer] += placed[n]
        if article == page.named[outer][1]:
            same[outer] += same[n]
    for a in range(1, len(by_article)):
        by_article[a] += by_article[page.articles[a]]  # with those of the articles around it
    of_region.pop(0, None)
    out: set[int] = set()
    if of_region:
        best = max(of_region, key=of_region.__getitem__)
        if 2 * of_region[best] > whole or all(page.regions[r] for r in of_region):
            n = page.regions[best]
            while n:
                out.add(n)
                n = page.named[n][0]
    for n in range(1, n_named):
        _, article, region = page.named[n]
        # seeds in an article beside the element: neither inside it nor in an article around it
        beside = in_articles.get(region, 0) - placed[n] - by_article[article] + same[n]
        if held[n] and 2 * held[n] > of_region.get(region, whole) and not beside:
            out.add(n)
    return out


def select(page: PageLines) -> tuple[list[str], int]:
    """(blocks of the main text in page order, content lines of the page)."""
    lines, parent = page.lines, page.parent
    if not lines:
        return [], 0
    content = content_lines(lines)
    kept = lifted(page, content) if len(page.named) > 1 else set()
    drops = [False]  # of named elements, with those around them
    for n, (outer, *_) in enumerate(page.named[1:], 1):
        drops.append(drops[outer] or n not in kept)
    usable = [not line[3] and not drops[line[6]] for line in lines]
    size = [len(line[0]) for line in lines]
    inside = [i for i in range(len(lines)) if usable[i] and lines[i][4]]
    if inside:
        chosen = {lines[i][4] for i in inside if content[i]}
        if not chosen:
            total: dict[int, int] = {}
            for i in inside:
                total[lines[i][4]] = total.get(lines[i][4], 0) + size[i]
            chosen = {max(total, key=total.__getitem__)}
        return [lines[i][0] for i in inside if lines[i][4] in chosen], int(content.sum())
    # no marked article: the innermost container with nearly all content text
    linked = [line[2] > 0.5 * n for line, n in zip(lines, size, strict=True)]
    seeds = [i for i in range(len(lines)) if usable[i] and content[i] and not linked[i]]
    held = [0] * len(parent)
    for i in seeds:
        held[lines[i][5]] += size[i]
    # containers are numbered in the order they open, so those inside come later and the largest number is the innermost
    for c in range(len(parent) - 1, 0, -1):
        held[parent[c]] += held[c]
    whole = sum(size[i] for i in seeds)
    best = max((c for c, n in enumerate(held) if n and n >= CONTAINER_SHARE * whole), default=0)
    within = [c == best for c in range(len(parent))]
    for c in range(best + 1, len(parent)):
        within[c] = within[parent[c]]
    return [line[0] for i, line in enumerate(lines) if usable[i] and within[line[5]] and (content[i] or not linked[i])], int(content.sum())


def page_text(html: str | None) -> tuple[str, int, int]:
    """(main text, lines, content lines) of one page; null and empty pages have none."""
    page = PageLines()
    page.read(html or "")
    blocks, content = select(page)
    return " ".join(blocks), len(page.lines), content


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of every row of ``pages`` (page_id, url, html).

    Returns page_id, url, text (empty if there is none), n_chars (code points) and
    the numbers of lines and content lines. A null html is an empty page; null ids
    and urls are passed on; repeated rows give equal rows; an empty table gives an
    empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = [page_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([t[0] for t in told], pa.string()),
                     pa.array([len(t[0]) for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()),
                     pa.array([t[2] for t in told], pa.int64())],
                    names=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).mapInArrow(run, SCHEMA)
