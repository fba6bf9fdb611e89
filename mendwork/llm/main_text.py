"""Main text of HTML pages by text-to-tag ratios.

The standard library's streaming parser sends events; block elements end a
line. Each line has a ratio of its characters outside links to its tags. The
ratios are smoothed with a Gaussian and clustered in two by a threshold
between the clusters' means (Weninger et al. 2010; Otsu's criterion finds the
threshold). The lines above it mark where the content is; the content region
is the smallest element around most of their text, and all its lines that are
not boilerplate are returned, so a short heading or paragraph inside an
article stays. What lies outside the region or in boilerplate goes. A tag, class, id or role that names boilerplate counts only if
the element does not hold most of the text above the threshold: page wrappers
("page with-sidebar", one form around all) do not empty a page.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.html import feed
from .common import with_columns

# HTML element classes
_BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset("script style noscript template iframe object svg canvas audio video head title select textarea button".split())
#: of these the ones whose text counts after all if no end tag ever comes
_OPENABLE = frozenset("button select video audio canvas object svg noscript".split())
_BOILERPLATE = frozenset("nav header footer aside form menu dialog search".split())
_CONTENT = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog form menu menubar alert".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar side aside widget widgets related recommended cookie cookies consent notice notices alert popup modal newsletter subscribe subscription signup login share "
    "sharing social comment comments commentlist disqus replies reply respond pagination pager tags legal copyright disclaimer toolbar outbrain taboola hidden".split()
)
_HEADERS = frozenset("header masthead".split())
#: what may stand in head; any other tag, or text, ends it, as </head> may be left out
_HEAD = frozenset("html head title base link meta style script noscript template object".split())
#: an opening tag closes an open one of these, as far up as the stop element
_CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr",)), "th": ("td th", ("tr",)), "option": ("option", ("select",))}
_SPACE = re.compile(r"\s+")
_TOKEN = re.compile(r"[a-z]+")


class _Lines(HTMLParser):
    """Collects lines (text, characters outside links, tags, element) and the tree of elements.

    Every event takes constant time: open elements are known by the places of
    their tag in the stack, and lines by their innermost element.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}  # of each open tag in the stack
        self.blocks: list[int] = []  # places of open block elements
        self.parent = [-1]  # by element; 0 is the page
        self.named: set[int] = set()  # elements that a tag, class, id or role calls boilerplate
        self.hidden: set[int] = set()
        self.content: dict[int, str] = {}
        self.pieces: list[tuple[list[tuple[int, str, bool]], int, int]] = []  # of each line: parts, tags before its end, element
        self.parts: list[tuple[int, str, bool]] = []  # the silent element around, text, whether outside links
        self.silent: list[int] = []  # open silent elements
        self.shut: set[int] = set()  # silent elements that have ended
        self.tags = self.inside = 0

    def _flush(self) -> None:
        if self.parts:
            self.pieces.append((self.parts, self.tags, self.stack[-1][1] if self.stack else 0))
            self.parts, self.tags = [], 0

    def lines(self) -> list[tuple[str, int, int, int]]:
        """(text, characters outside links, tags, element) of all lines; what ended silent elements hold is in none."""
        out, tags = [], 0
        for parts, own, node in self.pieces:
            tags += own
            seen = [(data, free) for silent, data, free in parts if silent not in self.shut]
            text = _SPACE.sub(" ", "".join(data for data, _ in seen)).strip()
            if text:
                out.append((text, sum(len(data.strip()) for data, free in seen if free), tags, node))
                tags = 0
        return out

    def _names(self, attrs: list) -> bool:
        for key, value in attrs:
            if key in ("class", "id") and value:
                # a word of a class or id names boilerplate: "ad", "site-footer", "comment_list"; an article has headers of its own
                if any(w in _NAMES and not (self.inside and w in _HEADERS) for w in _TOKEN.findall(value.lower())):
                    return True
            elif key == "role" and value and value.lower() in _ROLES:
                return True
        return False

    @staticmethod
    def _unseen(attrs: list) -> bool:
        return any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)

    def _end_head(self) -> None:
        if self.places.get("head") and self.stack[-1][0] in ("html", "head"):
            self._flush()
            self._close("head")

    def handle_starttag(self, tag, attrs):
        if tag not in _HEAD:
            if tag == "body" and self.places.get("head"):
                self._flush()
                self._close("head")
            self._end_head()
        self.tags += 1
        if tag == "br" or tag == "wbr":
            self.parts.append((0, " " if tag == "br" else "", False))
            return
        if tag in _BLOCKS:
            self._flush()
            self._close("p", ("table", "button"))
            if tag in _CLOSES:
                for t in _CLOSES[tag][0].split():
                    self._close(t, _CLOSES[tag][1])
        if tag in _VOID:
            return
        node = len(self.parent)
        self.parent.append(self.stack[-1][1] if self.stack else 0)
        whole = tag in ("html", "body", "article", "main")
        if tag in _BOILERPLATE and not (tag == "header" and self.inside) or not whole and self._names(attrs):
            self.named.add(node)
        if not whole and self._unseen(attrs):
            self.hidden.add(node)
        if tag in _CONTENT:
            self.content[node] = tag
            self.inside += 1
        if tag in _SILENT:
            self.silent.append(node)
            if tag not in _OPENABLE:
                self.shut.add(node)
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in _BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _close(self, tag: str, stops: tuple[str, ...] = (), inline: bool = False, ended: bool = False) -> None:
        """Close the innermost open ``tag`` with all it holds, unless a stop element lies between; ``ended`` by its end tag."""
        at = self.places.get(tag)
        if not at or any((self.places.get(t) or [-1])[-1] > at[-1] for t in stops) or inline and self.blocks and self.blocks[-1] > at[-1]:
            return
        to = at[-1]
        if ended and tag in _SILENT:
            self.shut.add(self.stack[to][1])
        while len(self.stack) > to:
            t, _ = self.stack.pop()
            self.places[t].pop()
            if t in _BLOCKS:
                self.blocks.pop()
            self.inside -= t in _CONTENT
            if t in _SILENT:
                self.silent.pop()

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in _BLOCKS:
            self._flush()
            self._close(tag, ended=True)
        else:  # an inline end tag doesn't reach out of its block, but one of a silent element does
            self._close(tag, inline=tag not in _SILENT, ended=True)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        hidden = next((n for n in self.silent if n in self.shut), 0)
        if not hidden:
            self.parts.append((self.silent[0] if self.silent else 0, data, not self.places.get("a")))


def _smoothed(x: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "full")[reach : reach + len(x)]
    return np.convolve(x, kernel, "full")[reach : reach + len(x)] / weight


def _threshold(x: np.ndarray) -> float:
    """The cut with the least variance within two clusters; one value: below it."""
    v = np.sort(x)
    if len(v) < 2 or v[0] == v[-1]:
        return -1.0
    n = np.arange(1, len(v))
    low = v.cumsum()[:-1]
    between = n * (len(v) - n) * (low / n - (v.sum() - low) / (len(v) - n)) ** 2
    at = int(between.argmax())
    return float((v[at] + v[at + 1]) / 2)


def _below(parent: list[int], of_node: np.ndarray) -> np.ndarray:
    """Sums over each element and all it holds; elements come before what they hold."""
    out = of_node.tolist()
    for node in range(len(parent) - 1, 0, -1):
        if out[node]:
            out[parent[node]] += out[node]
    return np.array(out)


def _within(parent: list[int], marked: set[int] | dict[int, str]) -> np.ndarray:
    """Whether an element is marked or lies in a marked one."""
    out = [False] * len(parent)
    if marked:
        for node in range(1, len(parent)):
            out[node] = out[parent[node]] or node in marked
    return np.array(out)


def _boilerplate(parser: _Lines, node: np.ndarray, free: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Elements in boilerplate, but for those named so that hold the page's text.

    These hold over half of the text above the threshold and over half of all
    text outside links, and no article or main outside them has lines above
    the threshold. If nothing would be left, all lines stay.
    """
    n = len(parser.parent)
    marked = high & _within(parser.parent, parser.content)[node]
    # text outside links, that above the threshold, and lines of it in an article or main
    sums = [_below(parser.parent, np.bincount(node, x, n)) for x in (free, free * high, marked)]
    named = {k for k in parser.named if any(2 * x[k] <= x[0] for x in sums[:2]) or sums[2][k] < sums[2][0]}
    found = _within(parser.parent, named)
    return found if not found[node].all() else np.zeros(n, dtype=bool)


def content_lines(html: str | None) -> list[str]:
    """Lines of the main text, in page order; null, empty or textless pages have none.

    Time and memory follow the page's length, whatever its depth; elements
    that are never closed are no different.
    """
    if not html:
        return []
    parser = _Lines()
    feed(parser, html)
    parser._flush()
    parent = parser.parent
    unseen = _within(parent, parser.hidden)
    lines = [line for line in parser.lines() if not unseen[line[3]]]
    if not lines:
        return []
    free, tags, node = (np.array([line[k] for line in lines]) for k in (1, 2, 3))
    ratio = np.log1p(_smoothed(free / np.maximum(1, tags)))
    usable = np.flatnonzero(~_boilerplate(parser, node, free, ratio > _threshold(ratio))[node])
    high = ratio > _threshold(ratio[usable])
    core = usable[high[usable] & (free[usable] > 0)]
    core = core if len(core) else usable
    n = len(parent)
    holds = _below(parent, np.bincount(node[core], minlength=n))
    size = _below(parent, np.bincount(node[core], free[core], n))
    some = _below(parent, np.bincount(node[usable], minlength=n))
    total = size[0]
    depth = [-1] * n
    for k in range(1, n):
        depth[k] = depth[parent[k]] + 1
    # the outermost article or main with most of the content, and its fellows; else the smallest element around most of it
    marked = [k for k in parser.content if some[k] and 2 * size[k] > total]
    around = [k for k in range(1, n) if holds[k] and 10 * size[k] >= 9 * total]
    if marked:
        best = max(marked, key=lambda k: (parser.content[k] == "article", -depth[k]))
        # a page of several articles: all whose text is mostly outside links
        chars = _below(parent, np.bincount(node[usable], [len(lines[i][0]) for i in usable], n))
        loose = _below(parent, np.bincount(node[usable], free[usable], n))
        regions = {best} | ({k for k, tag in parser.content.items() if tag == "article" and loose[k] and 2 * loose[k] >= chars[k]} if parser.content[best] == "article" else set())
    elif around:
        region = max(around, key=lambda k: depth[k])
        # a region that is a single block, as a paragraph, takes in its neighbours
        regions = {parent[region] if some[region] == 1 and depth[region] else region}
        regions |= {k for k, tag in parser.content.items() if tag == "article" and holds[k]}
    else:
        return [lines[i][0] for i in usable if not tags[i] or high[i]]
    region = _within(parent, regions)
    return [lines[i][0] for i in usable if region[node[i]]]


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Append ``main_text``: content lines joined by a line feed, empty if none."""

    def make():
        return lambda batch: {"main_text": pa.array(["\n".join(content_lines(h)) for h in batch.column(html).to_pylist()], pa.string())}

    return with_columns(pages, make, T.StructType([T.StructField("main_text", T.StringType())]))
