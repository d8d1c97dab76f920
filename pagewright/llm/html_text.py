"""Visible text of HTML pages, laid out as lines: a tree with implied tags, visibility rules, and a renderer.

The tree builder closes what HTML lets authors leave open (p before a block, li, dt, dd, option, colgroup, table rows and cells, head before
the body), and ignores end tags without a start. Elements nest to any depth: neither builder nor renderer recurses. Not visible are the head, scripts,
styles, templates, fallback content of embedded media, comments, elements with the hidden attribute, display:none or content-visibility:hidden in their
style, text where visibility is hidden or collapse (it is inherited, and an element inside may be visible again), closed details but for the summary, and closed dialogs. Everything else is kept.
White space is space, tab, line feed, form feed and carriage return; other control characters are text.

The renderer collapses white space outside pre and textarea, starts blocks on lines of their own, sets paragraphs, headings, lists and tables off by
an empty line, marks list items with "- " or their number and indents nested lists, and aligns table cells: each begins where its column does. A column
is as wide as its widest cell, but no more than WIDEST; what follows a wider cell goes on the next line, at its own column. colspan and rowspan are heeded. A cell
begins at most FARTHEST behind what stands before it on its line, of which at most MOST_HELD are for columns that rows above reach down into (they can pile up, one for each row), in tables of any size: where
its columns are as wide, a row is laid out the same however many others follow. So a page's text grows with the page.

A tag ends at its first ">" outside of a quoted value. From the first tag on that would then never end, quotes aren't heeded any more. So each
byte is looked at a bounded number of times, whatever the page.

Defined results: a null or empty page has an empty text. Broken markup gives the text that can be found; nothing raises. Repeated rows are
rendered one by one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import let_workers_import

#: The most that a cell's width counts for its column, and the most that a line is indented. Padding is bounded by it: without it, a page of n bytes
#: could take n * n.
WIDEST = 80
#: Columns that colspan and rows that rowspan may reach at most, as HTML has them.
_MOST_ACROSS, _MOST_DOWN = 1000, 65534
#: Columns that are kept free below cells that reach down; beyond them cells close up.
_MOST_COLUMNS = 100_000
#: The most blanks before a cell (six of the widest columns without text), and of these for columns that cells of rows above reach down into, whatever the table's size:
#: such columns can pile up, one for each row.
FARTHEST, MOST_HELD = 500, 100
#: Characters of text after which a batch is passed on.
_MOST_OUT = 8_000_000

_NAME = r"<(/?)([a-zA-Z][^\s/>]*+)"
# Only a value behind "=" is quoted.
_TAG = re.compile(_NAME + r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])))*+)>""")
_LOOSE_TAG = re.compile(_NAME + r"([^>]*+)>")
_OTHER = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VISIBILITY = re.compile("visibility", re.I)
_DECLARATION = re.compile(r"(?:^|;)\s*([-\w]+)\s*:\s*([-\w]+)[^;!]*(!\s*important)?")
_SPACES = " \t\n\f\r"
#: What Python's strings take for white space, and HTML doesn't.
_NO_SPACES = re.compile(r"[\x0b\x1c-\x1f]")
_ASCII_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

_words = lambda text: frozenset(text.split())
_VOID = _words("area base br col embed hr img input link meta param source track wbr")
_RAW = _words("script style xmp iframe noembed noframes noscript textarea title")
_UNSEEN = _words("head script style template noscript iframe noembed noframes title object audio video canvas datalist base link meta param source track col colgroup")
_HEAD = _words("base link meta title style script noscript template head html")
_HEADINGS = _words("h1 h2 h3 h4 h5 h6")
_SPACED = _words("p blockquote ul ol dl pre table figure") | _HEADINGS
_BLOCKS = _SPACED | _words("html body address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup legend li main menu nav section summary search optgroup option select textarea caption hr tr td th tbody thead tfoot xmp listing")
_CLOSES_P = (_BLOCKS | _words("hr")) - _words("html body td th tr tbody thead tfoot caption option optgroup select textarea legend")
_SECTIONS = _words("thead tbody tfoot")
#: Every other tag, and text, ends a colgroup.
_IN_COLGROUP = _words("col template html")
_CELLS = _words("td th")
_SCOPE = _words("table td th caption template object button html")


class Node:
    __slots__ = ("tag", "attributes", "children", "unseen")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.unseen = tag, attributes, [], False

    def get(self) -> dict[str, str]:
        found: dict[str, str] = {}
        for m in _ATTRIBUTE.finditer(self.attributes):
            found.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
        return found


class Stack:
    """The open elements, with the places of each tag's: what is asked of them doesn't depend on their number."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places = [root], {root.tag: [0]}

    def push(self, node: Node) -> None:
        nodes = self.nodes
        nodes[-1].children.append(node)
        if (own := self.places.get(node.tag)) is None:
            own = self.places[node.tag] = []
        own.append(len(nodes))
        nodes.append(node)

    def pop(self) -> None:
        self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of tags; -1 if there is none."""
        at, places = -1, self.places
        for tag in tags:
            if (own := places.get(tag)) and own[-1] > at:
                at = own[-1]
        return at

    def opened(self, tags, stops=frozenset()) -> bool:
        """Whether an element of tags is open, with none of stops inside it."""
        at = self.last(tags)
        return at >= 0 and at >= self.last(stops)

    def close(self, tags, stops=_SCOPE) -> None:
        """Closes up to the innermost open element of tags; not beyond an element of stops, nor the root."""
        at = self.last(tags)
        if at > 0 and at >= self.last(stops):
            while len(self.nodes) > at:
                self.pop()


def parse(page: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    stack = Stack(root)
    nodes, opened, pop_to = stack.nodes, stack.opened, stack.close
    at, n, tag_form = 0, len(page), _TAG

    def push(tag: str, attributes: str = "") -> None:
        stack.push(Node(tag, attributes))

    def text(value: str) -> None:
        if nodes[-1].tag in ("head", "colgroup") and value.strip(_SPACES):
            stack.pop()
        nodes[-1].children.append(html.unescape(value) if "&" in value else value)

    last = page.rfind(">")  # no tag ends behind it
    while at < n:
        begin = page.find("<", at)
        m = None
        while begin >= 0:
            sign = page[begin + 1 : begin + 2]
            if sign in ("!", "?") or sign == "/" and page[begin + 2 : begin + 3] not in _ASCII_LETTERS:
                m = _OTHER.match(page, begin)
            elif begin < last:
                m = tag_form.match(page, begin)
                if m is None and tag_form is _TAG and _LOOSE_TAG.match(page, begin):
                    tag_form = _LOOSE_TAG
                    m = tag_form.match(page, begin)
            if m:
                break
            begin = page.find("<", begin + 1)
        if m is None:
            text(page[at:])
            break
        if begin > at:
            text(page[at:begin])
        at = m.end()
        if m.re is _OTHER:
            continue
        name = m.group(2)
        tag, attributes = name.lower(), m.group(3)
        if nodes[-1].tag == "colgroup" and tag not in _IN_COLGROUP:
            stack.pop()
        if m.group(1):
            if tag == "p" and not opened({"p"}, _SCOPE):
                push("p")
                stack.pop()
            elif tag == "br":
                nodes[-1].children.append(Node("br"))
            elif tag in _HEADINGS:
                pop_to(_HEADINGS)
            elif tag == "table":
                pop_to({"table"}, frozenset())
            elif tag in _CELLS or tag == "tr" or tag in _SECTIONS:
                pop_to({tag}, frozenset({"table"}))
            elif tag == "li":
                pop_to({"li"}, _SCOPE | {"ul", "ol"})
            elif tag not in ("html", "body"):
                pop_to({tag})
            continue
        if tag == "html":
            root.attributes += " " + attributes
            continue
        if stack.places.get("head") and tag not in _HEAD and opened({"head"}, {"body"}):
            pop_to({"head"})
        if tag == "body":
            if opened({"body"}):
                continue
        elif tag in _CLOSES_P:
            pop_to({"p"})
        if tag in _HEADINGS and nodes[-1].tag in _HEADINGS:
            stack.pop()
        elif tag == "li":
            pop_to({"li"}, _SCOPE | {"ul", "ol", "menu"})
        elif tag in ("dt", "dd"):
            pop_to({"dt", "dd"}, _SCOPE | {"dl"})
        elif tag in ("option", "optgroup"):
            pop_to({"option"}, _SCOPE | {"select", "optgroup"})
            if tag == "optgroup":
                pop_to({"optgroup"}, _SCOPE | {"select"})
        elif tag in _CELLS or tag == "tr" or tag in _SECTIONS or tag == "caption":
            if not opened({"table"}):
                tag = "div" if tag not in _CELLS else "span"  # as a browser drops a cell's tag outside of a table; a row keeps its line
            else:
                table = frozenset({"table"})
                if tag in _CELLS:
                    pop_to(_CELLS, table | {"tr"})
                    if not opened({"tr"}, table):
                        push("tr")
                elif tag == "tr":
                    pop_to({"tr"}, table)
                else:
                    pop_to(_SECTIONS | {"caption"}, table)
        node = Node(tag, attributes)
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path", "circle", "rect", "g", "use"):
            nodes[-1].children.append(node)
        elif tag not in _RAW:
            stack.push(node)
        else:
            nodes[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            value = page[at : end.start() if end else n]
            at = end.end() if end else n
            if tag == "textarea" or tag == "title":
                value = html.unescape(value)
            node.children.append(value)
    return root


def style(own: dict[str, str]) -> dict[str, str]:
    """Declarations of a style attribute by name: the last one counts, or the last important one."""
    found: dict[str, tuple[bool, str]] = {}
    for m in _DECLARATION.finditer(own.get("style", "").lower()):
        important = bool(m.group(3))
        if important or not found.get(m.group(1), (False, ""))[0]:
            found[m.group(1)] = important, m.group(2)
    return {k: v for k, (_, v) in found.items()}


def without_invisible(root: Node) -> None:
    """Takes away the text of elements whose visibility, their own or inherited, isn't visible."""
    todo = [(root, True)]
    while todo:
        node, seen = todo.pop()
        if "visibility" in node.attributes.lower():
            own = style(node.get()).get("visibility", "inherit")
            seen = seen if own in ("inherit", "unset") else own not in ("hidden", "collapse")
        if not seen:
            node.unseen = True
            node.children = [c for c in node.children if isinstance(c, Node)]
        todo += [(c, seen) for c in node.children if isinstance(c, Node)]


def hidden(node: Node) -> bool:
    tag = node.tag
    if tag in _UNSEEN:
        return True
    if not node.attributes:
        return tag == "dialog"
    low = node.attributes.lower()
    if tag == "dialog" and "open" not in node.get():
        return True
    if "hidden" in low or "display" in low:
        own = node.get()
        look = style(own)
        return "hidden" in own and own["hidden"].lower() != "until-found" or look.get("display") == "none" or look.get("content-visibility") == "hidden" or tag == "input" and own.get("type", "").lower() == "hidden"
    return False


class Writer:
    """Lines of text; blanks and breaks are held until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.breaks, self.space, self.marker, self.indent = 0, False, "", 0

    def block(self, breaks: int) -> None:
        self.breaks, self.space = max(self.breaks, breaks), False

    def _flush(self) -> None:
        if self.breaks:
            if self.line or self.lines:
                self.lines.append("".join(self.line).rstrip(_SPACES))
                self.lines += [""] * (self.breaks - 1)
                self.line = []
            self.breaks, self.space = 0, False
        if not self.line:
            self.line.append(" " * (min(self.indent, WIDEST) - len(self.marker)) + self.marker)
            self.marker, self.space = "", False
        elif self.space:
            self.line.append(" ")
            self.space = False

    def text(self, value: str) -> None:
        words = value.split(None) if value.isascii() and not _NO_SPACES.search(value) else re.split(r"[ \t\n\f\r]+", value.strip(_SPACES))
        if not words or words == [""]:
            self.space = self.space or bool(value)
            return
        if value[0] in _SPACES:
            self.space = True
        self._flush()
        self.line.append(" ".join(words).replace("\xa0", " "))
        self.space = value[-1] in _SPACES

    def raw(self, value: str) -> None:
        for i, line in enumerate(value.split("\n")):
            if i:
                self.newline()
            if line.strip(_SPACES):
                self._flush()
                self.line.append(line.rstrip("\r"))

    def newline(self) -> None:
        """A forced break: breaks add up."""
        if self.line or self.lines or self.marker:
            self._flush() if not self.line and self.marker else None
            self.breaks += 1
        self.space = False

    def rows(self, lines: list[str]) -> None:
        for i, line in enumerate(lines):
            if i:
                self.breaks = max(self.breaks, 1)
            if line:
                self._flush()
                self.line.append(line)
            elif i:
                self.breaks += 1

    def done(self) -> list[str]:
        if self.line:
            self.lines.append("".join(self.line).rstrip(_SPACES))
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return int(m.group(1)) if m else default


def _run(steps):
    """Runs a generator that yields further generators and gets their results back, without recursion."""
    stack, value = [steps], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def render(node: Node, out: Writer, pre: bool = False, lists: int = 0):
    for child in node.children:
        if isinstance(child, str):
            (out.raw if pre else out.text)(child)
            continue
        tag = child.tag
        if tag == "br":
            out.newline()
        elif hidden(child):
            continue
        elif tag == "table":
            captions, rows = _cells(child)
            out.block(2)
            if not captions and len(rows) == 1 and len(rows[0][1]) == 1:  # a frame around one cell has nothing to align
                yield render(rows[0][1][0], out, pre, lists)
            else:
                out.rows((yield _table(captions, rows)))
            out.block(2)
        elif tag in ("ul", "ol", "menu", "dir"):
            out.block(1 if lists else 2)
            yield _list(child, out, pre, lists)
            out.block(1 if lists else 2)
        elif tag == "details" and "open" not in child.get():
            out.block(1)
            for summary in [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]:
                yield render(summary, out, pre, lists)
            out.block(1)
        else:
            breaks = 2 if tag in _SPACED else 1 if tag in _BLOCKS else 0
            if breaks:
                out.block(breaks)
            out.indent += 4 if tag == "dd" else 0
            yield render(child, out, pre or tag in ("pre", "textarea", "xmp", "listing"), lists)
            out.indent -= 4 if tag == "dd" else 0
            if breaks:
                out.block(breaks)


def _list(node: Node, out: Writer, pre: bool, lists: int):
    number = _number(node.get().get("start"), 1) if node.tag == "ol" and node.attributes else 1
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li" and not hidden(child):
            if node.tag == "ol":
                number = _number(child.get().get("value"), number) if child.attributes else number
                marker = f"{number}. "
                number += 1
            else:
                marker = "- "
            if child.unseen:
                marker = " " * len(marker)
            out.block(1)
            out.indent += max(2, len(marker))
            out.marker = marker
            own = len(marker) if len(marker) > 2 else 2
            yield render(child, out, pre, lists + 1)
            out.indent -= own
            out.marker = ""
            out.block(1)
        else:
            holder = Node(node.tag)
            holder.children = [child]
            yield render(holder, out, pre, lists + 1)


def _cells(table: Node) -> tuple[list[Node], list[tuple[str, list[Node]]]]:
    """(captions, rows as (section, cells)); whatever else stands in a table is a row of one cell."""
    captions, rows = [], []
    for child in table.children:
        if isinstance(child, str):
            if child.strip(_SPACES):
                rows.append(("tbody", [_wrap(child)]))
        elif hidden(child):
            continue
        elif child.tag == "caption":
            captions.append(child)
        elif child.tag == "tr":
            rows.append(("tbody", _row(child)))
        elif child.tag in _SECTIONS:
            for row in child.children:
                if isinstance(row, Node) and row.tag == "tr":
                    if not hidden(row):
                        rows.append((child.tag, _row(row)))
                elif isinstance(row, Node) or row.strip(_SPACES):
                    rows.append((child.tag, [_wrap(row)]))
        else:
            rows.append(("tbody", [_wrap(child)]))
    order = {"thead": 0, "tbody": 1, "tfoot": 2}
    return captions, sorted(rows, key=lambda r: order[r[0]])


def _wrap(child) -> Node:
    cell = Node("td")
    cell.children = [child]
    return cell


def _row(row: Node) -> list[Node]:
    return [c if isinstance(c, Node) and c.tag in _CELLS else _wrap(c) for c in row.children if (not hidden(c) if isinstance(c, Node) else c.strip(_SPACES))]


def _lines(node: Node):
    out = Writer()
    yield render(node, out)
    return out.done()


class _Below:
    """The columns that cells of earlier rows reach down into: per column the first row that is free again."""

    def __init__(self) -> None:
        self.until, self.row = np.zeros(0, np.int32), 0

    def free(self, column: int) -> int:
        """The first column from here on that is free in this row."""
        while column < len(self.until):
            some = self.until[column : column + 4096] <= self.row
            at = int(some.argmax())
            if some[at]:
                return column + at
            column += len(some)
        return column

    def keep(self, column: int, across: int, down: int) -> None:
        end = min(column + across, _MOST_COLUMNS)
        if end > len(self.until):
            self.until = np.concatenate([self.until, np.zeros(max(end, min(2 * len(self.until), _MOST_COLUMNS)) - len(self.until), np.int32)])
        self.until[column:end] = self.row + down


def _aligned(grid: list[list[tuple[int, int, list[str]]]], widths: dict[int, int]) -> list[str]:
    """Lines of rows (per cell: its column, the first column behind the cell before it, lines) whose cells begin where their columns do."""
    known, out = sorted(widths), []
    starts = [0, *accumulate(widths[c] + 2 for c in known)]
    for row in grid:
        # a row's cells by the lines that they have, so that a long cell's lines don't pass the others again
        written: dict[int, list[tuple[int, int, str]]] = {}
        held = 0
        for column, behind, lines in row:
            start = starts[bisect_left(known, column)]
            held += start - starts[bisect_left(known, behind)]
            for k, value in enumerate(lines):
                if value:
                    written.setdefault(k, []).append((start, held, value))
        for k in sorted(written):
            parts, size, before = [], 0, 0
            for start, held, value in written[k]:
                if parts and size > start - 2:  # a wide cell, or one over several columns, is in the way
                    out.append("".join(parts).rstrip(_SPACES))
                    parts, size, before = [], 0, 0
                gap = max(0, start - size)
                gap = min(gap - max(0, min(held - before, gap) - MOST_HELD), FARTHEST)
                parts += (" " * gap, value)
                size, before = size + gap + len(value), held
            out.append("".join(parts).rstrip(_SPACES))
    return out


def _table(captions: list[Node], rows: list[tuple[str, list[Node]]]):
    grid: list[list[tuple[int, int, list[str]]]] = []  # per row: column, first column behind the cell before, lines
    below = _Below()
    widths: dict[int, int] = {}
    for _, cells in rows:
        column, line = 0, []
        for cell in cells:
            behind, column = column, below.free(column)
            own = cell.get() if cell.attributes else {}
            across = min(max(1, _number(own.get("colspan"), 1)), _MOST_ACROSS)
            down = min(max(1, _number(own.get("rowspan"), 1)), _MOST_DOWN)
            lines = yield _lines(cell)
            if down > 1:
                below.keep(column, across, down)
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(WIDEST, max(map(len, lines), default=0)))
            line.append((column, behind, lines))
            column += across
        below.row += 1
        grid.append(line)
    out: list[str] = []
    for caption in captions:
        out += yield _lines(caption)
    return out + [x for x in _aligned(grid, widths) if x]


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page.replace("\r\n", "\n").replace("\0", ""))
    if hidden(root):
        return ""
    if _VISIBILITY.search(page):
        without_invisible(root)
    return "\n".join(_run(_lines(root)))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        begin, size, texts = 0, 0, []
        for i in range(batch.num_rows):
            texts.append(extract(batch.column(1)[i].as_py()))
            size += len(texts[-1])
            if size > _MOST_OUT or i + 1 == batch.num_rows:  # texts can be longer than their pages
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(map(len, texts), pa.int64()), pa.array(texts, pa.string())], names=["page_id", "n_chars", "text"])
                begin, size, texts = i + 1, 0, []


def texts(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per page: page_id, n_chars, text."""
    let_workers_import(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_batches, f"page_id {kind}, n_chars long, text string")
