"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams events; block elements cut the page into lines, each with its number of
text characters and tags. The ratio of text to tags of each line is smoothed with a Gaussian over its
neighbours; lines above a threshold between the page's low and high cluster are content. A content line
selects its region: the innermost `article` or `main` around it, else its own container: from its first to its
last content line, and where they hold most of the container's text all of its lines but those that are links. Tables
and containers of headings alone belong to the container around them; a container that holds no content line goes
with the one around it, unless that is the page's body, where that is mostly content. All lines of the selected regions are the text.

Elements and roles that are boilerplate by their meaning (nav, footer, aside, script, ..) and hidden elements are left
out as they open; nothing else is, and no name drops an inline element or a heading. A name of a class or id that
consists of furniture words alone (`sidebar`, `cookie-notice`, `ad-slot-3`, but not `social-history`), or a form,
makes a container suspect; a furniture word among others only weighs: the ratio of the lines inside is halved.
Headers of the text (`entry-header`) are none. A suspect is judged once the page has ended, by the content lines in it. Suspects go as long as the content outside them is at least
LEAST_OUTSIDE of that in the largest; if not, the largest is a wrapper of the content and stays, and the
suspects inside it are judged in turn. So no name can empty a page: one whose content is all in a suspect keeps
it, if that is SOME_PROSE characters or more (a cookie notice alone is no article).

Inside a block, white space becomes one space and the ends are trimmed; blocks are joined by a line end.
Defined results: null and empty pages, and pages without text, give the empty text; equal ratios are one
cluster, all content; repeated rows are extracted alike; the time is linear in the page's length, however long
or deeply nested it is; unclosed elements end with their parent or the page; a tag cut off by the page's end
is dropped, a character reference that is cut off is read as HTML reads it. An empty table gives an empty
table; a column that has the name of the result is kept as <name>_input.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import set_aside

#: Elements that cut lines.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is never main text.
_NEVER = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input label map menu nav noscript object option script select "
    "style svg template textarea title video".split()
)
#: Elements without an end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next of these, or any block for p, ends.
_ENDED_BY = {"p": _BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
_ROLES = frozenset("alert banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words in names of classes and ids that make a container suspect, and those that say how it is laid out.
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion promotions banner banners cookie cookies "
    "consent gdpr notice notices alert alerts popup popups modal newsletter subscribe signup sidebar sidebars widget widgets menu menus nav navbar navigation "
    "breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus respond replies reply share sharing social related recommended login "
    "search pagination pager".split()
)
#: Words beside those that say no more than place, kind or size.
_PLAIN = frozenset(
    "main site top bottom left right upper lower box block area list item items wrap wrapper container inner outer bar nav content section page global primary secondary post posts entry "
    "widget link links text form button buttons icon icons slot unit placeholder google dfp story stories article articles news video videos product products more you may also like "
    "the a of for and to by in on this your our panel group column col row small large big wide fixed sticky floating dropdown toggle mobile desktop tablet header footer body title "
    "policy law info thread section sections count number media skip home user id class js sm md lg xl".split()
)
#: Words of the text itself; its header is none of the page's.
_OF_TEXT = frozenset("entry page article post section content story title".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LAYOUT = frozenset("has have no not with without is free open opened closed enabled disabled allowed results image".split())
_ON_ROOTS = re.compile("comment|repl(?:y|ies)|advert|sponsor|promo|related")
_CASE = re.compile("(?<=[a-z])(?=[A-Z])")
_WORDS = re.compile("[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CUT_OFF = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
_ROOTS = frozenset(("html", "body", "article", "main"))
_BOXES = frozenset(("article", "main", "section", "div", "body"))

#: Content outside of suspects, as a share of the largest one's, that is enough to drop them; characters of content that make a suspect a wrapper.
LEAST_OUTSIDE, SOME_PROSE = 0.05, 300


def suspect_name(value: str, root: bool) -> int:
    """2: a name in a class or id stands for boilerplate, and not for a layout that has or lacks it; 1: it has such a word among others; 0."""
    found = 0
    for part in _CASE.sub("-", value).lower().split():
        own = _WORDS.findall(part)
        if _NAMES.isdisjoint(own) or not _LAYOUT.isdisjoint(own) or root and not _ON_ROOTS.search(part):
            continue
        furniture = _NAMES.intersection(own)
        if furniture <= {"header", "masthead", "widget", "widgets"} and not _OF_TEXT.isdisjoint(own):
            continue
        found = max(found, 2 if all(w in _NAMES or w in _PLAIN for w in own) else 1)
    return found


class _Lines(HTMLParser):
    """Cuts a page into lines: text, tags, numbers of the region, the container and the innermost suspect, is it mostly a link, is it a heading, weight of its ratio."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool, bool, float]] = []
        self.blocks: list[tuple[str, int, int, int, Counter, float]] = [("", 0, 0, 0, Counter(), 1.0)]  # element, region, container, suspect, inline elements open, weight
        self.above = {0: 0}  # of each container, the container around it; that of the body is 0
        self.open = Counter()  # block elements by name
        self.around = [0]  # of each suspect, the suspect around it
        self.skip = ""  # the element left out, if any, its depth and the block elements opened inside
        self.depth, self.inside = 0, Counter()
        self.text: list[str] = []
        self.tags = self.count = self.linked = 0
        self.in_link = False

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, *self.blocks[-1][1:4], 2 * self.linked > len(text), self.blocks[-1][0] in _HEADINGS, self.blocks[-1][5]))
        self.text, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            self.depth += tag == self.skip
            if tag in _BLOCKS and tag != self.skip:
                self.inside[tag] += 1
            return
        block = tag in _BLOCKS
        if block:
            self.flush()
            while self.blocks[-1][0] in _ENDED_BY and tag in _ENDED_BY[self.blocks[-1][0]]:
                self.leave()
        if tag in _NEVER or tag == "header" and not self.blocks[-1][1] or any(n == "role" and (v or "").lower() in _ROLES for n, v in attrs) or not block and self.hidden(attrs):
            if tag not in _VOID:
                self.skip, self.depth, self.inside = tag, 1, Counter()
            return
        named = 0
        if block and tag not in _HEADINGS and tag not in ("html", "body"):
            named = 2 if tag == "form" or self.hidden(attrs) else max((suspect_name(v, tag in _ROOTS) for n, v in attrs if v and n in ("class", "id")), default=0)
        self.tags += 1
        if tag in _VOID:
            if tag == "br":
                self.text.append(" ")
            elif tag == "hr":
                self.flush()
            return
        self.in_link = tag == "a" or self.in_link and not block
        if not block:
            self.blocks[-1][4][tag] += 1
            return
        _, region, container, around, _, weight = self.blocks[-1]
        self.count += 1
        if tag in ("article", "main"):
            region = self.count
        if tag in _BOXES:
            self.above[self.count] = 0 if tag == "body" else container
            container = self.count if tag != "body" else 0
        if named == 2:
            self.around.append(around)
            around = len(self.around) - 1
        self.open[tag] += 1
        self.blocks.append((tag, region, container, around, Counter(), weight / 2 if named == 1 else weight))

    @staticmethod
    def hidden(attrs: list[tuple[str, str | None]]) -> bool:
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value == "form" or value and name == "style" and _HIDDEN.search(value):
                return True
        return False

    def end(self) -> None:
        """Ends the page."""
        super().close()
        self.flush()

    def leave(self) -> str:
        """Ends the innermost block and the inline elements in it."""
        tag = self.blocks.pop()[0]
        self.open[tag] -= 1
        return tag

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = ""
                return
            if self.inside[tag] > 0:
                self.inside[tag] -= 1
                return
            if self.open[tag] <= 0:
                return
            self.skip = ""  # its parent ends
        self.tags += 1
        if tag in _BLOCKS:
            self.flush()
            self.in_link = False
            if self.open[tag] > 0:
                while self.leave() != tag:
                    pass
        else:
            self.in_link = self.in_link and tag != "a"
            inline = self.blocks[-1][4]  # an inline end doesn't close blocks
            if inline[tag] > 0:
                inline[tag] -= 1

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)
            self.linked += len(data.strip()) if self.in_link else 0


def dropped_suspects(lines: list[tuple], around: list[int], chosen: list[int]) -> set[int]:
    """The numbers of the suspects that go, those inside others included."""
    clean = [0] * len(around)  # content characters, without those of suspects inside
    for k in chosen:
        clean[lines[k][4]] += len(lines[k][0])
    whole = clean[:]
    inside = defaultdict(list)
    for k in range(len(around) - 1, 0, -1):  # a suspect has a higher number than those around it
        whole[around[k]] += whole[k]
        inside[around[k]].append(k)
    outside = clean[0]
    waiting = [(-whole[k], k) for k in inside[0]]
    heapq.heapify(waiting)
    while waiting and -waiting[0][0] >= SOME_PROSE and outside < LEAST_OUTSIDE * -waiting[0][0]:
        _, k = heapq.heappop(waiting)
        outside += clean[k]
        for n in inside[k]:
            heapq.heappush(waiting, (-whole[n], n))
    gone: set[int] = set()
    rest = [k for _, k in waiting]
    while rest:
        k = rest.pop()
        gone.add(k)
        rest += inside[k]
    return gone


def content(ratio: np.ndarray, sigma: float = 1.0, share: float = 0.5) -> np.ndarray:
    """Which lines are content: smoothed ratio above a share of the way between the low and the high cluster."""
    if len(ratio) < 2:
        return np.ones(len(ratio), bool)
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratio)), kernel)[reach:-reach]
    smooth = np.log1p(np.convolve(ratio, kernel)[reach:-reach] / weight)
    low, high = smooth.min(), smooth.max()
    for _ in range(20):  # two clusters in one dimension
        cut = low + (high - low) * share
        if not (smooth <= cut).any() or not (smooth > cut).any():
            break
        new = smooth[smooth <= cut].mean(), smooth[smooth > cut].mean()
        if new == (low, high):
            break
        low, high = new
    return smooth >= min(low + (high - low) * share, smooth.max())


def _ratios(lines: list[tuple]) -> np.ndarray:
    return np.array([len(line[0]) * line[7] / max(1, line[1]) for line in lines])


def _lines(html: str) -> tuple[list[tuple], dict[int, int]]:
    """The page's lines outside of dropped suspects, and the container around each container."""
    parser = _Lines()
    parser.feed(_CUT_OFF.sub("", html))
    parser.end()
    lines = parser.lines
    if lines and len(parser.around) > 1:
        chosen = [k for k in np.flatnonzero(content(_ratios(lines))).tolist() if not lines[k][5]]
        gone = dropped_suspects(lines, parser.around, chosen)
        lines = [line for line in lines if line[4] not in gone]
    return lines, parser.above


def _containers(lines: list[tuple], above: dict[int, int]) -> list[int]:
    """The container of each line; one of headings alone is the container around it."""
    alone: dict[int, bool] = {}
    for line in lines:
        alone[line[3]] = alone.get(line[3], True) and line[6]
    found = []
    for line in lines:
        box = line[3]
        while box and alone.get(box, False):
            box = above[box]
        found.append(box)
    return found


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    lines, above = _lines(html)
    if not lines:
        return ""
    chosen = np.flatnonzero(content(_ratios(lines))).tolist()
    regions = {lines[k][2] for k in chosen} - {0}
    if regions:
        return "\n".join(line[0] for line in lines if line[2] in regions)
    boxes = _containers(lines, above)
    spans: dict[int, tuple[int, int]] = {}
    held: dict[int, int] = {}
    for k in chosen:
        box = boxes[k]
        spans[box] = (min(k, spans.get(box, (k, k))[0]), k)
        held[box] = held.get(box, 0) + len(lines[k][0])
    whole: dict[int, int] = {}
    for line, box in zip(lines, boxes):
        whole[box] = whole.get(box, 0) + len(line[0])
    mostly = {box for box in spans if 2 * held[box] > whole[box]}
    inner: dict[int, int] = {}  # content, and all text, of the containers right inside
    total: dict[int, int] = {}
    for box, size in whole.items():
        up = above[box] if box else 0
        if up:
            inner[up], total[up] = inner.get(up, 0) + held.get(box, 0), total.get(up, 0) + size
    kept = []
    for k, (line, box) in enumerate(zip(lines, boxes)):
        if box in spans:
            if spans[box][0] <= k <= spans[box][1] or box in mostly and not line[5]:
                kept.append(line[0])
            continue
        around = (box, above[box]) if box else ()  # it stands with what lies in its own container, or beside that
        if not line[5] and any(up and 2 * (held.get(up, 0) + inner.get(up, 0)) > whole.get(up, 0) + total.get(up, 0) for up in around):
            kept.append(line[0])
    return "\n".join(kept)


def extract(html: Column | str) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    def html_main_text(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(page.as_py()) for page in pages], pa.string())

    return html_main_text(html)


def extract_pages(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the main text of html_col in column out; a column of that name becomes out_input."""
    pages, (html,) = set_aside(pages, out, html_col)
    return pages.withColumn(out, extract(F.col(html).cast("string")))
