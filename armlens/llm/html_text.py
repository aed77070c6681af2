"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events; text between block boundaries is a
line. Every line has a ratio of characters outside of links to tags, less if a class or id speaks against its
block. The ratios are smoothed with a Gaussian, and neighbouring lines over a threshold form clusters of
content. The clusters select the text: article elements that hold one, else the
main element, else the lines from the first to the last of the heavy clusters below what the heaviest has in common.
Inside, blocks whose class or id names a menu, notice, advert or comment go, unless the
heaviest cluster lies in them, and so does what follows a heading over reader comments.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

# HTML elements by their role in the page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "aside button canvas datalist dialog embed fieldset footer form head iframe input map menu nav noscript "
    "object option script search select style svg template textarea title audio video".split())
# Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising alert author-box banner breadcrumb breadcrumbs comment comments "
    "complementary contentinfo consent cookie cookies copyright disqus footer form gdpr hidden login masthead menu "
    "modal nav navbar navigation newsletter notice pagination popup print promo promotion related recommended "
    "respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
# Words that say nothing beside a word of the former list.
NEUTRAL = frozenset(
    "area bar block body box container content group holder inner item items link links list main outer panel row section text title "
    "unit wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that an inline end tag does not reach out of.
CONTAINERS = frozenset("article div main section table td th".split())
# A heading over reader comments.
COMMENTS = re.compile(
    r"(?:\d+\s+|(?:reader|user|latest|recent|all)\s+)*(?:comments?|replies|leave an? (?:reply|comment)|post a comment|"
    r"join the conversation|what do you think)\W*(?:\d+\W*)?", re.I)
# A new one of these closes an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}

SMOOTHING = 1.0
THRESHOLD = 0.9
# What is left of a ratio if class or id speak against the block.
EVIDENCE = 0.25
# Characters that a cluster has at least to outweigh them, and the share of the heaviest cluster that another has.
OUTWEIGHING, SHARE = 140, 0.2
# Lines with a larger share of their characters in links are no content unless an article element says so.
LINKED = 0.6


@dataclass
class Element:
    """An open or closed element; elements are numbered in the order they open, so a subtree is a range of numbers."""

    tag: str
    above: int
    last: int = 0  # number of the last element inside
    dropped: bool = False
    depth: int = 0
    mark: int = 0  # the innermost element around (or this one) that class or id speak against
    next_mark: int = 0  # of a marked element: the next one further out
    article: int = 0  # the outermost and the second article element around
    inner: int = 0
    main: int = 0


@dataclass
class Line:
    """A run of text between block boundaries."""

    text: str
    tags: int
    linked: int  # characters inside links
    element: int
    dropped: bool


def _hidden(attributes: list[tuple[str, str | None]]) -> bool:
    return any(
        name == "hidden" or name == "aria-hidden" and value == "true"
        or name == "style" and value and re.search(r"display\s*:\s*none", value, re.I) for name, value in attributes)


def _marked(attributes: list[tuple[str, str | None]]) -> bool:
    """Whether a whole word of class, id or role names what is not the article.

    ``cookie-notice`` and ``comment-list`` do, ``has-sidebar`` and ``print-friendly`` say more and do not.
    """
    for name, value in attributes:
        if name in ("class", "id", "role") and value:
            for word in value.lower().split():
                parts = set(filter(None, re.split(r"[-_]+", word)))
                if word in MARKS or not MARKS.isdisjoint(parts) and parts <= MARKS | NEUTRAL:
                    return True
    return False


class _Lines(HTMLParser):
    """Cuts a page into lines while its events stream by; each event takes constant time on average."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        # Number 0 is the page.
        self.elements = [Element("", 0)]
        self.stack = [0]
        # How often each element is open inside the containers that are open.
        self.open: list[Counter[str]] = [Counter()]
        self.everywhere: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.pieces).split())
        self.pieces.clear()
        if text:
            at = self.stack[-1]
            self.lines.append(Line(text, self.tags, self.linked, at, self.elements[at].dropped))
            self.tags = self.linked = 0

    def push(self, tag: str, attributes: list[tuple[str, str | None]]) -> None:
        above, number = self.stack[-1], len(self.elements)
        outer = self.elements[above]
        new = Element(tag, above, number, outer.dropped, outer.depth + 1, outer.mark, 0, outer.article, outer.inner, outer.main)
        within = outer.article or outer.main
        if tag in DROPPED or tag == "header" and not within or _hidden(attributes):
            new.dropped = True
        if tag not in ("html", "body") and _marked(attributes):
            new.mark, new.next_mark = number, outer.mark
        if tag == "article":
            new.inner = outer.inner or (number if outer.article else 0)
            new.article = outer.article or number
        if tag == "main":
            new.main = outer.main or number
        if new.dropped and not outer.dropped:
            self.end_line()  # also text before an inline element that is dropped is a line of its own
        self.elements.append(new)
        self.stack.append(number)
        self.open[-1][tag] += 1
        self.everywhere[tag] += 1
        if tag in CONTAINERS:
            self.open.append(Counter())

    def pop(self) -> None:
        number = self.stack.pop()
        element = self.elements[number]
        element.last = len(self.elements) - 1
        if element.tag in CONTAINERS:
            self.open.pop()
        self.open[-1][element.tag] -= 1
        self.everywhere[element.tag] -= 1

    def end(self, tag: str) -> None:
        """The end of the innermost such element, if it is open and can be reached."""
        if not self.everywhere[tag] or tag not in BLOCKS and not self.open[-1][tag]:
            return
        if tag in BLOCKS:
            self.end_line()
        while True:
            top = self.elements[self.stack[-1]]
            if top.dropped and not self.elements[top.above].dropped:
                self.end_line()
            self.pop()
            if top.tag == tag:
                return

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
            if self.open[-1]["p"]:
                self.end("p")
            for other in CLOSES.get(tag, ()):
                if self.elements[self.stack[-1]].tag == other:
                    self.pop()
        elif tag == "br":
            self.pieces.append(" ")
        if tag not in VOID:
            self.push(tag, attrs)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        self.end(tag)

    def handle_data(self, data):
        self.pieces.append(data)
        if self.everywhere["a"]:
            self.linked += len(data)

    def close(self) -> None:
        super().close()
        self.end_line()
        while len(self.stack) > 1:
            self.pop()
        self.elements[0].last = len(self.elements) - 1


def smoothed(ratios: np.ndarray, sigma: float = SMOOTHING) -> np.ndarray:
    """Ratios after a Gaussian over neighbouring lines; beyond the page the kernel is cut and scaled."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[radius:radius + len(ratios)]
    return np.convolve(ratios, kernel)[radius:radius + len(ratios)] / weight


def _clusters(ratios: np.ndarray, usable: np.ndarray, marked: np.ndarray) -> list[range]:
    """Ranges of neighbouring lines, all marked or all not, whose smoothed ratios are over the threshold."""
    smooth = smoothed(ratios)
    over = usable & (smooth >= THRESHOLD * smooth.std())
    kind = np.where(over, np.where(marked, 2, 1), 0)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], kind, [0])))).tolist()
    if edges:
        return [range(a, b) for a, b in zip(edges, edges[1:]) if over[a]]
    best = int(np.argmax(ratios))
    return [range(best, best + 1)]


class _Page:
    """The lines and elements of a page, and which of them the clusters select."""

    def __init__(self, lines: list[Line], elements: list[Element]):
        self.lines, self.elements = lines, elements
        of = [elements[line.element] for line in lines]
        plain = np.array([0 if line.dropped else max(0, len(line.text) - line.linked) for line in lines], dtype=float)
        against = np.array([EVIDENCE if e.mark else 1.0 for e in of])
        tags = np.array([max(1, line.tags) for line in lines])
        self.of, self.weight = of, plain * against
        usable = plain > 0
        if not usable.any():
            # Nothing but links: their text is all there is to weigh.
            self.weight = np.array([0 if line.dropped else len(line.text) for line in lines], dtype=float) * against
            usable = self.weight > 0
        self.clusters = _clusters(self.weight / tags, usable, against < 1) if usable.any() else []

    def heaviest(self) -> range:
        return max(self.clusters, key=lambda c: (self.weight[c.start:c.stop].sum(), -c.start))

    def outweighed(self) -> set[int]:
        """Marked elements that hold most of the heaviest cluster, which is large enough to say more than their names."""
        cluster = self.heaviest()
        plain = {i: len(self.lines[i].text) for i in cluster}
        held: Counter[int] = Counter()
        for i, characters in plain.items():
            mark = self.of[i].mark
            while mark:
                held[mark] += characters
                mark = self.elements[mark].next_mark
        whole = sum(plain.values())
        return {mark for mark, characters in held.items() if whole >= OUTWEIGHING and 2 * characters > whole}

    def regions(self) -> tuple[list[int], range | None]:
        """The elements that hold the text, and without an article or main element the range of lines."""
        inside = [i for cluster in self.clusters for i in cluster if not self.lines[i].dropped]
        for kind in ("article", "main"):
            found = dict.fromkeys(getattr(self.of[i], kind) for i in inside)
            found.pop(0, None)
            # Those that nothing around speaks against, if there are any.
            if clean := [n for n in found if not self.elements[self.elements[n].above].mark]:
                return clean, None
            if found:
                weight = Counter()
                for i in inside:
                    weight[getattr(self.of[i], kind)] += len(self.lines[i].text)
                return [max(found, key=lambda n: (weight[n], -n))], None
        heaviest = self.heaviest()
        low, high = (f(self.lines[i].element for i in heaviest) for f in (min, max))
        root = low
        while root and (self.elements[root].last < high or self.elements[root].tag not in BLOCKS
                        or self.elements[root].tag in HEADINGS | {"p", "li", "blockquote"}):
            root = self.elements[root].above
        # A cluster of one block is seen with the blocks beside it.
        if len(heaviest) == 1 and root:
            root = self.elements[root].above
        most = self.weight[heaviest.start:heaviest.stop].sum()
        heavy = [c for c in self.clusters if self.weight[c.start:c.stop].sum() >= SHARE * most
                 and root <= self.lines[c.start].element <= self.elements[root].last]
        first, last = min(c.start for c in heavy), max(c.stop for c in heavy)
        while first and self.of[first - 1].tag in HEADINGS and root <= self.lines[first - 1].element:
            first -= 1
        return [root], range(first, last)

    def text(self) -> str:
        if not self.clusters:
            return ""
        rescued, (roots, span) = self.outweighed(), self.regions()
        if span is not None and not rescued and all(self.of[i].mark for i in self.heaviest()):
            return ""
        kept = []
        for root in roots:
            top = self.elements[root]
            members = [i for i, line in enumerate(self.lines) if root <= line.element <= top.last and not line.dropped
                       and (span is None or i in span and line.linked <= LINKED * len(line.text))]
            # An article inside an article is a reader's comment, unless the outer one has nothing of its own.
            own = {i for cluster in self.clusters for i in cluster if not self.of[i].inner}
            nested = any(i in own for i in members)
            until = -1  # the last element of a section of comments
            for i in members:
                line, element = self.lines[i], self.of[i]
                if line.element <= until or nested and element.inner:
                    continue
                mark = element.mark
                while mark in rescued:
                    mark = self.elements[mark].next_mark
                if mark and self.elements[mark].depth > top.depth:
                    continue
                if element.tag in HEADINGS and COMMENTS.fullmatch(line.text):
                    until = self._section(line.element, root)
                    continue
                kept.append(i)
        return "\n".join(self.lines[i].text for i in sorted(kept))

    def _section(self, heading: int, root: int) -> int:
        """The last element of what a heading stands over: the innermost block around it that goes on after it."""
        at = self.elements[heading].above
        while at > root and self.elements[at].last <= self.elements[heading].last:
            at = self.elements[at].above
        return self.elements[at].last


def main_text(html: str) -> str:
    """The selected lines of the page in their order, joined by newlines; empty if the page has none."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    return _Page(parser.lines, parser.elements).text() if parser.lines else ""


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, ``text`` and ``n_chars`` (code points) for every row of ``pages``.

    The whole html is read; null or text-free html gives an empty text. Repeated
    rows give repeated rows, nulls in ``keep`` stay null, other columns are not
    read, and an empty table gives no rows.
    """
    fields = {f.name: f for f in pages.schema}

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column("_html")]
            kept = [batch.column(f"_{i}") for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*(f"_{i}" for i in range(len(keep))), "text", "n_chars"])

    columns = [F.col(name).alias(f"_{i}") for i, name in enumerate(keep)]
    schema = ", ".join([*(f"_{i} {fields[name].dataType.simpleString()}" for i, name in enumerate(keep)),
                        "text string", "n_chars long"])
    found = pages.select(*columns, whole_text(html_column).alias("_html")).mapInArrow(of_batches, schema)
    return found.select(*[F.col(f"_{i}").alias(name) for i, name in enumerate(keep)], "text", "n_chars")
