"""Main text of web pages: streamed parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams events into lines, one for each block of text, each with the
characters outside links, the tags around them and its container. The ratio of a line is its characters
outside links by tag; elements marked as something else than an article (forms, adverts, notices, comments of readers, by
name, class, id or role) give their lines a ratio of zero, unless nearly nothing else is on the page. Ratios are
smoothed over neighbouring lines and clustered in two on a log scale; the upper cluster is content. The
content region is the deepest container that holds nearly all ratio mass of content, widened to the article around
it and to siblings that are content too; its other unmarked lines are kept, so that short paragraphs and
headings inside an article stay. Only a few elements are out whatever their ratio: menus, footers, sidebars,
page headers, controls, and what is hidden.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text nobody reads as text.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video datalist".split())
#: Elements that are never part of an article.
FURNITURE = frozenset("nav footer aside button select option textarea menu dialog label".split())
#: Elements that hold no article, unless they hold nearly the whole page.
MARKED = frozenset("form fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CELLS = frozenset(("td", "th"))
REGIONS = frozenset("article main section div body html td".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Start tags that end an open paragraph.
_ENDS_P = BLOCKS - frozenset(("html", "body"))
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}
#: Words of class, id and role that mark an element wherever they stand in a name.
_STRONG = frozenset(
    """advert advertisement advertising adsense adbox sponsored breadcrumb breadcrumbs navbar navigation menubar sidebar complementary masthead topbar cookie cookies
    consent gdpr newsletter comment comments commentlist disqus replies pagination contentinfo skiplink copyright disclaimer""".split()
)
#: Words that mark an element if they end a name, or begin one that doesn't end in a word of _BODY.
_WEAK = frozenset(
    """ad ads adv sponsor promo promotion banner nav menu footer foot header notice notices alert alertbar popup modal overlay subscribe subscription signup login
    share sharing social reply respond related recommended recommendations trending widget widgets toolbar pager search searchbox tags taglist skip legal form dialog""".split()
)
_BODY = frozenset("body content text free story article main entry post page".split())
_PARTS = re.compile(r"[^a-z0-9]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*$")
_HUMPS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


def is_furniture(tag: str, attrs: dict) -> bool:
    """Whether an element is out whatever its text: by its name, or hidden."""
    if tag in FURNITURE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


def is_marked(tag: str, attrs: dict) -> bool:
    """Whether name, class, id or role say that an element is no article."""
    if tag in MARKED:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for key in ("class", "id", "role"):
        for name in (attrs.get(key) or "").split():
            parts = [x for x in _PARTS.split(_HUMPS.sub("-", name).lower()) if x]
            if parts and (not _STRONG.isdisjoint(parts) or parts[-1] in _WEAK or (parts[0] in _WEAK and parts[-1] not in _BODY)):
                return True
    return False


class Line:
    __slots__ = ("text", "linked", "tags", "region", "dull", "marks", "titled")

    def __init__(self, text, linked, tags, region, dull, marks, titled):
        self.text, self.linked, self.tags, self.region, self.dull, self.marks, self.titled = text, linked, tags, region, dull, marks, titled


class Lines(HTMLParser):
    """Parser events to lines. Open elements are a stack of any depth; end tags without a start are passed over.

    Regions are numbered in page order, with the number of the one around each; so are marked elements.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]  # tag, dull, silent, region, innermost mark
        self.counts: dict[str, int] = {}
        self.around, self.kinds = [0], [""]
        self.marked_in = [0]
        self._parts: list[str] = []
        self._linked = self._tags = 0

    def _has(self, tag: str) -> int:
        return self.counts.get(tag, 0)

    def _flush(self):
        text = " ".join("".join(self._parts).split()) if self._parts else ""
        if text:
            _, dull, _, region, mark = self.open[-1]
            self.lines.append(Line(text, self._linked, self._tags, region, dull, mark, bool(self._has("article") or self._has("main") or self._has("h1"))))
            self._tags = 0
        self._parts, self._linked = [], 0

    def _pop(self, to: int):
        while len(self.open) > to:
            tag = self.open[-1][0]
            if tag in BLOCKS:
                self._flush()
            self.counts[tag] -= 1
            self.open.pop()

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._parts.append(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in _ENDS_P and self._has("p"):
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name == "p":
                    self._pop(i)
                    break
                if name not in INLINE:
                    break
        if tag in _CLOSES and any(map(self._has, _CLOSES[tag])):
            for i in range(len(self.open) - 1, 0, -1):
                name = self.open[i][0]
                if name in _CLOSES[tag]:
                    self._pop(i)
                    break
                if name in _STOPS[tag]:
                    break
        if tag in BLOCKS:
            self._flush()
        elif tag in CELLS:
            self._parts.append(" ")
        _, dull, silent, region, mark = self.open[-1]
        attrs = dict(attrs)
        dull = dull or is_furniture(tag, attrs) or (tag == "header" and not (self._has("article") or self._has("main")))
        if not dull and is_marked(tag, attrs):
            self.marked_in.append(mark)
            mark = len(self.marked_in) - 1
        if tag in REGIONS:
            self.around.append(region)
            self.kinds.append(tag)
            region = len(self.around) - 1
        self.counts[tag] = self._has(tag) + 1
        self.open.append((tag, dull, silent or tag in SILENT, region, mark))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._tags += 1
        if tag in CELLS:
            self._parts.append(" ")
        if not self._has(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i][0]
            if name == tag:
                self._pop(i)
                return
            if tag in INLINE and name not in INLINE:
                return  # an inline end doesn't close blocks

    def handle_data(self, data):
        if self.open[-1][2]:
            return
        self._parts.append(data)
        if self._has("a"):
            self._linked += len(data)

    def finish(self) -> list[Line]:
        self.rawdata = _CUT_TAG.sub("", self.rawdata)  # a tag that the page's end cuts off is no text
        self.close()
        self._flush()
        return self.lines


def unmarked(lines: list[Line], marked_in: list[int], share: float = 0.1) -> list[bool]:
    """For each line, whether no mark stands against it.

    While the lines without a mark hold under ``share`` of the characters outside links, and none of them lies in an article,
    a main element or a first heading, the mark around the most characters is lifted: a form may hold a whole page.
    """
    lifted = {0}
    size = [max(0, len(x.text) - x.linked) if not x.dull else 0 for x in lines]

    def blocking(mark: int) -> int:
        while mark in lifted and mark:
            mark = marked_in[mark]
        return 0 if mark in lifted else mark

    while True:
        free = [not blocking(x.marks) for x in lines]
        held: dict[int, int] = {}
        for x, n, ok in zip(lines, size, free):
            if not ok and n:
                top = m = blocking(x.marks)
                while m:  # the outermost mark that is left around the line
                    top, m = m, blocking(marked_in[m])
                held[top] = held.get(top, 0) + n
        open_ = sum(n for n, ok in zip(size, free) if ok)
        if not held or open_ >= share * sum(size) or any(ok and x.titled and not x.dull for x, ok in zip(lines, free)):
            return free
        lifted.add(max(held, key=lambda m: (held[m], -m)))


def ratios(lines: list[Line], free: list[bool]) -> np.ndarray:
    """Characters outside links by tag; zero for furniture and marked elements."""
    return np.array([0.0 if x.dull or not ok else max(0, len(x.text) - x.linked) / max(1, x.tags) for x, ok in zip(lines, free)])


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with weights that sum to one at the ends too."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    return np.convolve(ratios, kernel)[reach : reach + n] / np.convolve(np.ones(n), kernel)[reach : reach + n]


def threshold(values: np.ndarray, most: float = 40.0) -> float:
    """The ratio that parts two clusters of values (two means on a log scale), ``most`` at most: that much text by tag is content."""
    x = np.log1p(values)
    low, high = float(x.min()), float(x.max())
    for _ in range(32):
        middle = (low + high) / 2
        upper = x > middle
        if not upper.any() or upper.all():
            break
        new = float(x[~upper].mean()), float(x[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return min(most, float(np.expm1((low + high) / 2)))


def select(lines: list[Line], around: list[int], kinds: list[str], marked_in: list[int], sigma: float = 1.0, nearly: float = 0.9, alike: float = 0.8) -> list[Line]:
    """The lines of the content region, in page order."""
    able = [i for i, x in enumerate(lines) if not x.dull]
    if not able:
        return []
    free = unmarked(lines, marked_in)
    ratio = ratios(lines, free)
    smooth = smoothed(ratio, sigma)
    least = threshold(smooth)
    content = [not x.dull and r > 0 and s >= least for x, r, s in zip(lines, ratio, smooth)]
    if not any(content):
        content = [not x.dull and r > 0 for x, r in zip(lines, ratio)]
    if not any(content):
        return [lines[i] for i in able if free[i]]

    # Sums by region, from inner to outer: a region's number is larger than that of the one around it.
    n = len(around)
    mass, rest, text = np.zeros(n), np.zeros(n), np.zeros(n)
    for x, r, c in zip(lines, ratio, content):
        if c:
            mass[x.region] += r
            text[x.region] += len(x.text)
        elif not x.dull:
            rest[x.region] += len(x.text)
    own = text > 0
    for k in range(n - 1, 0, -1):
        for sums in (mass, rest, text):
            sums[around[k]] += sums[k]
    best = max((k for k in range(n) if mass[k] >= nearly * mass[0]), default=0)
    k = best
    while k:  # the outermost article around it, or a region that adds little but content
        k = around[k]
        added, other = text[k] - text[best], rest[k] - rest[best]
        if kinds[k] in ("article", "main") or (kinds[best] not in ("article", "main") and added and added >= alike * (added + other)):
            best = k
    inside = np.zeros(n, bool)
    inside[best] = True
    for k in range(best + 1, n):
        inside[k] = inside[around[k]]
    # A container of links alone is a menu that nobody has marked.
    links, held = np.zeros(n), np.zeros(n)
    for x in lines:
        if not x.dull:
            links[x.region] += x.linked
            held[x.region] += len(x.text)
    menu = ~own & (links >= 0.9 * held) & (np.arange(n) != best)
    return [x for x, c, ok in zip(lines, content, free) if not x.dull and inside[x.region] and (c or (ok and not menu[x.region]))]


def main_text(html) -> str:
    """The main text of a page: blocks in page order, a line each; null and empty pages give an empty text."""
    if not isinstance(html, str) or not html:
        return ""
    parser = Lines()
    parser.feed(html)
    return "\n".join(x.text for x in select(parser.finish(), parser.around, parser.kinds, parser.marked_in))


def _extract(batches):
    for pdf in batches:
        out = pdf.drop(columns=["html"]).copy()
        out["text"] = [main_text(h).encode("utf-8", "replace").decode() for h in pdf["html"]]
        out["n_chars"] = np.array([len(t) for t in out["text"]], np.int64)
        yield out[["page_id", "url", "text", "n_chars"]].astype({"page_id": "Int64"})


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``: a narrow map, page by page.

    Pages of any size go through whole. White space inside a block becomes one space, a line break
    included. Null and empty pages give an empty text. Repeated rows are extracted alike, other columns of the
    table are left out. An empty table gives an empty result.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return slim.mapInPandas(_extract, "page_id long, url string, text string, n_chars long")


