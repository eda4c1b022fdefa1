"""Layout-aware text of web pages.

A tree builder with implied tags puts a page's elements in order, visibility rules leave out what
a reader would not see, and a renderer lays out the rest: paragraphs with blank lines between
them, list items with markers and indents, and table cells in aligned columns. Nothing here
recurses, so nesting may be of any depth.
"""

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ehrseq.llm.common import map_rows

# Element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
LINES = frozenset(
    "address article aside body caption center dd details dialog dir div dt fieldset figcaption footer form header "
    "hgroup html legend li main menu nav option optgroup section select summary tbody td textarea tfoot th thead tr".split()
)
HIDDEN = frozenset("head script style template title noembed noframes iframe object audio video canvas datalist".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
# An open element of the first kind ends when one of the second begins, unless a barrier lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir", "table", "td", "th"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select", "datalist"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr", "caption"]), frozenset(["table"])),
    "tbody": (frozenset(["tbody", "thead", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["tbody", "thead", "tfoot", "tr", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["tbody", "thead", "tfoot", "tr", "caption"]), frozenset(["table"])),
}
CLOSES_P = (PARAGRAPHS | LINES) - frozenset("td th tr tbody thead tfoot caption option optgroup select textarea body html legend".split())
P_BARRIERS = frozenset("td th table caption button object".split())
CELL_BARRIERS = frozenset(["td", "th", "caption"])
TABLE_PARTS = frozenset("table caption tbody thead tfoot tr td th".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")
# A cell longer than this does not widen its column, or one long cell would pad every row: what follows
# it in its row goes on in the next line, in its own column.
PADDED_WIDTH = 40
MOST_SPAN = 1000


class Node:
    __slots__ = ("tag", "children", "span", "rows", "start", "lines", "hidden")

    def __init__(self, tag, attributes, hidden=False):
        self.tag, self.children, self.lines, self.hidden = tag, [], None, hidden or tag in HIDDEN
        self.span = self.rows = self.start = 1
        if attributes:
            self.span, self.rows = (_number(attributes.get(name), 1, MOST_SPAN) for name in ("colspan", "rowspan"))
            self.start = _number(attributes.get("start"), 1, 10**9)


def _number(text, default, most):
    text = (text or "").strip()
    return min(max(int(text), 1), most) if text.isascii() and text.isdigit() and len(text) < 10 else default


class _Builder(HTMLParser):
    """Elements become nodes; inline ones without effect on layout leave only their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.stack, self.open = [self.root], {"html": 1}
        self.tables, self.hidden = [], 0

    def updatepos(self, i, j):
        """Line numbers are not kept."""
        return j

    def _pop(self):
        node = self.stack.pop()
        self.open[node.tag] -= 1
        self.hidden -= node.hidden

    def _pop_to(self, position):
        while len(self.stack) > position:
            self._pop()

    def _find(self, tags, barriers):
        """Place on the stack of the lowest of the uppermost open ``tags`` above a barrier, or None."""
        if not any(self.open.get(tag) for tag in tags):
            return None
        found = None
        for position in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[position].tag
            if tag in tags:
                found = position
            elif tag in barriers:
                break
        return found

    def _push(self, tag, attributes, hidden=False):
        node = Node(tag, attributes, hidden)
        self.stack[-1].children.append(node)
        if tag == "table":
            self.tables.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1
            self.hidden += node.hidden

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        unseen = attrs and ("hidden" in attributes or _UNSEEN.search(attributes.get("style") or ""))
        if tag in ("html", "body"):
            if self.open.get("head"):
                self._pop_to(self._find({"head"}, ()))
            return
        if self.open.get("head") and tag not in HEAD_ONLY and tag != "head":
            self._pop_to(self._find({"head"}, ()))
        if tag in CLOSES_P and (place := self._find({"p"}, P_BARRIERS)):
            self._pop_to(place)
        if tag in ENDS and (place := self._find(*ENDS[tag])):
            self._pop_to(place)
        if tag in ("td", "th") and self.open.get("table") and self.stack[-1].tag != "tr":
            self._push("tr", {})
        if tag in VOID:
            if not unseen and (tag in ("br", "hr")):
                self._push(tag, attributes)
        elif unseen or self.hidden or tag in PARAGRAPHS or tag in LINES or tag in HIDDEN:
            # Inside hidden elements inline ones count too, to tell which end tag is whose.
            self._push(tag, attributes, bool(unseen))

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not self._find({"p"}, P_BARRIERS):
            # An end tag alone is an empty paragraph.
            self.handle_starttag("p", [])
        if not self.open.get(tag) or tag == "html":
            return
        barriers = () if tag in TABLE_PARTS else CELL_BARRIERS
        for position in range(len(self.stack) - 1, 0, -1):
            if self.stack[position].tag == tag:
                self._pop_to(position)
                return
            if self.stack[position].tag in barriers or (tag != "table" and tag in TABLE_PARTS and self.stack[position].tag == "table"):
                return

    def handle_data(self, data):
        if self.stack[-1].tag == "head" and data.strip():
            self._pop()
        self.stack[-1].children.append(data)


class _Page:
    """Lines of text as they grow: white space collapses, gaps between blocks don't add up."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], [], 0, False
        self.indent, self.marker = 0, None

    def _begin(self):
        if not self.line:
            if self.lines and self.gap > 1:
                self.lines.append("")
            if self.marker is not None:
                depth, text = self.marker
                self.line.append("  " * depth + text)
                self.marker = None
            else:
                self.line.append("  " * self.indent)
            self.gap = 0
        elif self.space:
            self.line.append(" ")
        self.space = False

    def text(self, data):
        parts = _SPACES.split(data)
        if len(parts) == 1:
            if data:
                self._begin()
                self.line.append(data)
            return
        if parts[0]:
            self._begin()
            self.line.append(parts[0])
        middle = " ".join(p for p in parts[1:] if p)
        if self.line:
            self.space = True
        if middle:
            self._begin()
            self.line.append(middle)
        if not parts[-1] and middle:
            self.space = True

    def raw(self, data):
        """Preformatted text."""
        for number, part in enumerate(data.split("\n")):
            if number:
                if not self.line:
                    self.lines.append("")
                self.end_line()
            if part:
                self._begin()
                self.line.append(part)

    def end_line(self, gap=1):
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def block(self, lines):
        """Lines laid out already, such as a table's."""
        self.end_line(2)
        for line in lines:
            self._begin()
            self.line.append(line)
            self.end_line()
        self.gap = 2


def _rendered(node: Node) -> list[str]:
    """Lines of a node's content; tables in it are laid out already."""
    page = _Page()
    lists: list[list] = []
    pre = 0
    todo: list[tuple] = [(child, True) for child in reversed(node.children)]
    while todo:
        item, opens = todo.pop()
        if isinstance(item, str):
            page.raw(item) if pre else page.text(item)
            continue
        tag = item.tag
        if item.hidden:
            continue
        if tag == "br":
            if not page.line and page.lines and page.gap <= 1:
                page.gap = 2
            page.end_line()
            continue
        if tag == "table" and item.lines is not None:
            page.block(item.lines)
            continue
        gap = 2 if tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists[1 - opens :]) else 1
        page.end_line(gap)
        if tag == "hr":
            continue
        if opens:
            if tag in ("ul", "ol"):
                lists.append([tag, item.start])
            elif tag == "li":
                kind, number = lists[-1] if lists else ("ul", 1)
                page.marker = (max(len(lists) - 1, 0), f"{number}. " if kind == "ol" else "- ")
                page.indent = max(len(lists), 1)
                if lists:
                    lists[-1][1] += 1
            elif tag == "pre":
                pre += 1
            elif tag == "dd":
                page.indent += 1
            todo.append((item, False))
            todo += [(child, True) for child in reversed(item.children)]
        elif tag in ("ul", "ol"):
            lists.pop()
            page.indent = len(lists)
        elif tag == "li":
            page.marker = None
            page.indent = max(len(lists) - 1, 0)
        elif tag == "pre":
            pre -= 1
        elif tag == "dd":
            page.indent = max(page.indent - 1, 0)
    page.end_line()
    return page.lines


def _lay_out(table: Node) -> list[str]:
    """A table's lines: each row's cells side by side, columns as wide as their widest padded cell."""
    out, rows, left_over = [], [], {}
    todo = list(reversed(table.children))
    while todo:
        node = todo.pop()
        if not isinstance(node, str) and node.hidden:
            continue
        if isinstance(node, str):
            out += [line for line in [_SPACES.sub(" ", node).strip()] if line]
        elif node.tag in ("tbody", "thead", "tfoot"):
            todo += reversed(node.children)
        elif node.tag == "tr":
            cells, column = [], 0
            waiting, left_over = left_over, {c: n - 1 for c, n in left_over.items() if n > 1}
            for cell in node.children:
                if not isinstance(cell, str) and cell.hidden:
                    continue
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    lines = [line for line in [_SPACES.sub(" ", cell).strip()] if line] if isinstance(cell, str) else _rendered(_around(cell))
                    if lines:
                        out += lines
                    continue
                while column in waiting:
                    column += 1
                cells.append((column, _rendered(cell)))
                for c in range(column, column + cell.span):
                    if cell.rows > 1:
                        left_over[c] = cell.rows - 1
                column += cell.span
            rows.append(cells)
        else:
            out += _rendered(_around(node))
    widths: dict[int, int] = {}
    for cells in rows:
        for column, lines in cells:
            wide = max((len(line) for line in lines), default=0)
            if wide <= PADDED_WIDTH:
                widths[column] = max(widths.get(column, 0), wide)
    used = sorted({column for cells in rows for column, lines in cells if any(lines)})
    starts = [sum(widths.get(c, 0) + 2 for c in used[:n]) for n in range(len(used))]
    for cells in rows:
        held = dict(cells)
        for n in range(max((len(lines) for lines in held.values()), default=0)):
            line = ""
            for column, start in zip(used, starts):
                part = (held.get(column) or [])[n : n + 1]
                if not part or not part[0]:
                    continue
                if line and len(line) > start - 2:
                    out.append(line)
                    line = ""
                line = line.ljust(start) + part[0]
            out.append(line.rstrip())
    return out


def _around(node: Node) -> Node:
    outer = Node("div", {})
    outer.children.append(node)
    return outer


def render(html: str | None) -> str:
    """The visible text of a page."""
    builder = _Builder()
    builder.feed(html or "")
    if builder.rawdata.startswith("<!"):
        builder.rawdata = ""  # a comment that never ends
    builder.close()
    # Inner tables come after outer ones, so backwards each finds those inside it laid out.
    for table in reversed(builder.tables):
        table.lines = _lay_out(table)
    return "\n".join(_rendered(builder.root)).strip("\n")


def extract_text(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """(id, text) of every page, whole.

    Null and empty pages have an empty text; broken markup is read as far as it makes sense.
    Repeated rows are read each; an empty table gives an empty result. Other columns are left out.
    """

    def each(lists):
        for rows in lists:
            yield {id_column: [r[0] for r in rows], "text": [render(r[1]) for r in rows]}

    given = pages.select(F.col(id_column), F.col(html).alias("_html"))
    kind = given.schema.fields[0].dataType.simpleString()
    return map_rows(given, each, f"`{id_column}` {kind}, text string")
