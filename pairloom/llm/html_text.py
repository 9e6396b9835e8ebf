"""Layout-aware rendering of HTML: all visible text, with the spacing of blocks, lists and aligned table cells.

A single pass over the markup builds the open-element stack with implied end tags (p, li, dt, dd, option, tr, td, th, table parts) and
visibility (head parts, script, style, template, noscript, what stands in for media, unseen parts of svg and math; the hidden attribute;
display:none, and visibility, which inner elements may set again), and writes text as it goes.  Blocks are separated by a line break,
paragraphs and headings by a blank line; list items get a bullet or their number, indented by depth; pre keeps its white space; table rows
are lines whose cells are padded to the width of their columns, spanning cells included.  The places of the open elements are kept by name,
so closing and implied end tags search nothing, and elements are opened at any depth.

Defined results: null and empty pages give the empty text; unknown and unclosed tags are tolerated, as is markup cut off anywhere;
repeated rows repeat their results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import table

# Element classes of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist input".split())
_UNSEEN = {"svg": frozenset("defs desc metadata symbol clippath mask".split()), "math": frozenset(["annotation", "annotation-xml"])}
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr fieldset".split())
_BLOCKS = _PARAGRAPHS | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header "
                                  "hgroup html legend li main menu nav option optgroup section select summary tr caption".split())
_LISTS = frozenset("ul ol menu dir".split())
#: End tags that close nothing outside the table they stand in.
_INSIDE = frozenset("td th tr li p div span b i a".split())
#: An opening tag ends the open elements named here, up to the nearest of the stoppers.
_IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
            "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "thead": ({"caption", "colgroup", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
            "tbody": ({"caption", "colgroup", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
            "tfoot": ({"caption", "colgroup", "tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"})}
_ENDS_P = _PARAGRAPHS | frozenset("address article aside details div figcaption footer form header main menu nav section summary center".split())
_P_STOPS = frozenset({"td", "th", "table", "li", "button", "caption", "object"})
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MAY_HIDE = re.compile("hidden|style", re.I)
#: The most columns and rows that a cell spans.
_COLUMNS, _ROWS = 1000, 65534
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Canvas:
    """Lines of text in the making: white space collapses, and breaks asked for several times count once, the widest."""

    def __init__(self):
        self.pieces, self.gap, self.space, self.written, self.indent = [], 0, False, False, 0

    def text(self, text: str) -> None:
        """Running text, in which white space is one space at most."""
        parts = _SPACE.split(text)
        for i, part in enumerate(parts):
            self.space = self.space or i > 0
            if part:
                self._put(part)

    def _put(self, part: str) -> None:
        if self.written and self.gap:
            self.pieces.append("\n" * self.gap + "  " * self.indent)
        elif self.written and self.space:
            self.pieces.append(" ")
        self.pieces.append(part)
        self.gap, self.space, self.written = 0, False, True

    def verbatim(self, text: str) -> None:
        """Preformatted lines, or a bullet."""
        for i, line in enumerate(text.split("\n")):
            if i:
                self.gap = self.gap + 1 if self.written else 0
            if line.strip():
                self._put(line)

    def mark(self, text: str) -> None:
        self._put(text)
        self.space = True

    def apart(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def line(self) -> None:
        """A forced line break."""
        self.gap, self.space = min(self.gap + 1, 2), False

    def result(self) -> str:
        return "".join(self.pieces)


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by name in lower case; the first of a name counts."""
    found = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw or ""):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


def looks(raw: str) -> tuple[bool, bool | None]:
    """Whether an element's attributes take it out of the page, and the visibility they set, if they do."""
    if not raw or not _MAY_HIDE.search(raw):
        return False, None
    attributes = attributes_of(raw)
    style = {}
    for declaration in attributes.get("style", "").lower().split(";"):
        key, colon, value = declaration.partition(":")
        if colon:
            style[key.strip()] = value.replace("!important", "").strip()
    shown = style.get("display")
    gone = shown == "none" if shown else "hidden" in attributes
    seen = style.get("visibility")
    return gone, {"hidden": False, "collapse": False, "visible": True}.get(seen)


def span_of(raw: str, name: str, most: int) -> int:
    value = attributes_of(raw).get(name, "").strip() if raw and "span" in raw.lower() else ""
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() else 1


def laid_out(rows: list[list[tuple[str, int, int]]]) -> str:
    """A table of cells (text, columns, rows) with aligned columns; a cell's own lines stay in its columns."""
    placed, taken = [], []  # taken: for each column the first row that it is free in again
    for r, row in enumerate(rows):
        line, at = [], 0
        for text, across, down in row:
            while at < len(taken) and taken[at] > r:
                at += 1
            line.append((at, across, text.split("\n")))
            taken += [0] * (at + across - len(taken))
            taken[at:at + across] = [r + down] * across
            at += across
        placed.append(line)
    width = [0] * len(taken)
    for wide in (False, True):
        for line in placed:
            for at, across, lines in line:
                need = max(map(len, lines))
                if not wide and across == 1:
                    width[at] = max(width[at], need)
                elif wide and across > 1:
                    last = at + across - 1
                    width[last] = max(width[last], need - sum(width[at:last]) - 2 * (across - 1))
    start = [0, *itertools.accumulate(w + 2 for w in width)]
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            drawn = ""
            for at, _, lines in line:
                drawn = drawn.ljust(start[at]) + (lines[k] if k < len(lines) else "")
            out.append(drawn.rstrip())
    return "\n".join(line for line in out if line)


class Page:
    """The stack of open elements, and the canvas that text goes to; a table cell has a canvas of its own."""

    def __init__(self):
        self.stack: list[tuple] = []  # name, gone, visibility before, entered, attributes of a cell
        self.open_at: dict[str, list[int]] = {}  # places in the stack by name
        self.blocks: list[int] = []  # places of blocks and table parts
        self.lists: list[list] = []  # ordered, next number; of the lists that were entered
        self.canvas, self.gone, self.visible, self.pre = Canvas(), 0, True, 0
        self.tables: list[tuple[Canvas, list[list[tuple]]]] = []

    def feed(self, markup: str) -> str:
        at, end = 0, len(markup)
        while at < end:
            tag = markup.find("<", at)
            tag = end if tag < 0 else tag
            if tag > at:
                self.characters(markup[at:tag])
            if tag == end:
                break
            found = _TOKEN.match(markup, tag)
            if not found:
                self.characters("<")
                at = tag + 1
                continue
            at = found.end()
            name = (found.group(2) or "").lower()
            if found.group(1):
                self.close(name)
            elif name:
                raw = found.group(3)
                self.open(name, raw)
                if raw.endswith("/") and (self.open_at.get("svg") or self.open_at.get("math")):
                    self.close(name)
                elif name in _RAW:
                    stop = re.compile(rf"</{re.escape(name)}\b", re.I).search(markup, at)
                    stop = stop.start() if stop else end
                    if name in ("textarea", "xmp"):
                        self.characters(markup[at:stop])
                    at = stop
        while self.stack:
            self.pop()
        return self.canvas.result()

    def characters(self, raw: str) -> None:
        if not self.gone and self.visible:
            text = html.unescape(raw) if "&" in raw else raw
            (self.canvas.verbatim if self.pre else self.canvas.text)(text)

    def last(self, names) -> int:
        """The place of the last opened element of these names, or -1."""
        return max((self.open_at[n][-1] for n in names if self.open_at.get(n)), default=-1)

    def down_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()

    def until(self, names, stops) -> None:
        """Closes the open elements of these names above the last stopper, with all that is open in them."""
        while (place := self.last(names)) > self.last(stops):
            self.down_to(place)

    def implied(self, name: str) -> None:
        if name in _ENDS_P:
            self.until({"p"}, _P_STOPS)
        if name in _IMPLIED:
            self.until(*_IMPLIED[name])
        if name == "a" and self.open_at.get("a") and self.open_at["a"][-1] > (self.blocks[-1] if self.blocks else -1):
            self.down_to(self.open_at["a"][-1])

    def open(self, name: str, raw: str) -> None:
        self.implied(name)
        gone, seen = looks(raw)
        gone = gone or name in _HIDDEN or any(name in unseen and self.open_at.get(root) for root, unseen in _UNSEEN.items())
        if name in _VOID:
            if not self.gone and not gone:
                if name == "br":
                    self.canvas.line()
                elif name == "hr":
                    self.canvas.apart(2)
            return
        before = self.visible
        self.gone += gone
        self.visible = before if seen is None else seen
        entered = not self.gone
        spans = None
        if entered:
            if name in ("td", "th"):
                spans = (span_of(raw, "colspan", _COLUMNS), span_of(raw, "rowspan", _ROWS))
            self.enter(name, raw)
        if name in _BLOCKS or name in ("table", "td", "th", "tr"):
            self.blocks.append(len(self.stack))
        self.open_at.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, gone, before, entered, spans))

    def enter(self, name: str, raw: str) -> None:
        if name == "table":
            self.canvas.apart(2)
            self.tables.append((self.canvas, []))
        elif name == "tr" and self.tables:
            self.tables[-1][1].append([])
        elif name in ("td", "th") and self.tables:
            if not self.tables[-1][1]:
                self.tables[-1][1].append([])
            self.canvas = Canvas()
        elif name == "caption" and self.tables:
            self.canvas = Canvas()
        elif name in _BLOCKS:
            nested = name in _LISTS and self.lists
            self.canvas.apart(2 if name in _PARAGRAPHS and not nested else 1)
            if name == "li":
                self.canvas.indent = max(0, len(self.lists) - 1)
                if self.visible:
                    self.canvas.mark(f"{self.lists[-1][1]}." if self.lists and self.lists[-1][0] else "-")
                if self.lists:
                    self.lists[-1][1] += 1
        if name in _LISTS:
            start = attributes_of(raw).get("start", "").strip() if name == "ol" else ""
            self.lists.append([name == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif name == "pre":
            self.pre += 1
        elif name == "q" and self.visible:
            self.canvas.text("\"")

    def close(self, name: str) -> None:
        place = self.last([name])
        if name == "p" and place < 0:
            if not self.gone:
                self.canvas.apart(2)
        elif name == "br":
            self.open("br", "")
        elif place >= 0 and (name not in _INSIDE or place > self.last(["table"])):
            self.down_to(place)

    def pop(self) -> None:
        name, gone, before, entered, spans = self.stack.pop()
        self.open_at[name].pop()
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.gone -= gone
        if entered:
            self.leave(name, spans)
        self.visible = before

    def leave(self, name: str, spans: tuple | None) -> None:
        if name == "pre":
            self.pre -= 1
        elif name == "q" and self.visible:
            self.canvas.text("\"")
        elif name in _LISTS:
            self.lists.pop()
        if name in ("td", "th") and self.tables:
            # Elements left open inside belong to the cell; its canvas goes back to the table's.
            self.tables[-1][1][-1].append((self.canvas.result(), *spans))
            self.canvas = self.tables[-1][0]
        elif name == "caption" and self.tables:
            title, self.canvas = self.canvas.result(), self.tables[-1][0]
            if title:
                self.canvas.verbatim(title)
                self.canvas.apart(1)
        elif name == "table" and self.tables:
            self.canvas, rows = self.tables.pop()
            drawn = laid_out(rows)
            if drawn:
                self.canvas.verbatim(drawn)
            self.canvas.apart(2)
        elif name in _BLOCKS:
            nested = name in _LISTS and self.lists
            self.canvas.apart(2 if name in _PARAGRAPHS and not nested else 1)
            if name == "li" or name in _LISTS:
                self.canvas.indent = max(0, len(self.lists) - 1)


def rendered(markup) -> str:
    return Page().feed(markup) if isinstance(markup, str) and markup else ""


def rendered_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every row of (page_id, url, html); no shuffle."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": [rendered(m) for m in batch["html"]]})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInPandas(run, "page_id long, url string, text string")


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return rendered_pages(table(spark, folder, "pages"))
