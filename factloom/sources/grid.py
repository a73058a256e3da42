"""HTML into table grids, in plain Python: no Spark here, so that it is tested alone.

The tree builder closes what page authors leave open inside tables, lists and
paragraphs. Tables are those of the three data-table classes; ``clean`` mode
takes any table with the class token, in document order, and lays headers and
data into places that spans of rows and columns hold.
"""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

#: Classes of data tables, in the order in which their tables are numbered. Fixed values.
TABLE_CLASSES = ("wikitable", "wikitable sortable", "wikitable sortable collapsible")
EMPTY = "-"
#: Columns that a cell spans at most, as the HTML standard has it: a browser shows no more. Rows have no limit.
WIDEST = 1000
NBSP = " "

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_INLINE = frozenset("a abbr b big cite code em font i p s small span strike strong sub sup tt u".split())
_SECTIONS = frozenset(("tbody", "thead", "tfoot"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_EDGES = re.compile(r"^[ \t\r\f]*\n\s*|\s*\n[ \t\r\f]*$")
_NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf(inity)?|nan)\s*", re.I | re.A)
#: Parts of a page of plain tags: a tag of a name and quoted values, a text, or a mark that begins neither.
_PARTS = re.compile(r'<(/?)([a-z][a-z0-9]*)((?:[ \t\n\r\f]+[a-z][a-z0-9-]*="[^"<>&]*")*)[ \t\n\r\f]*(/?)>|([^<]+)|(<)')
_VALUES = re.compile(r'([a-z][a-z0-9-]*)="([^"]*)"')
#: Tags whose content is read as that of any other.
_PLAIN = frozenset("a abbr b big blockquote body br caption center cite code col colgroup dd div dl dt em font h1 h2 h3 h4 h5 h6 head hr html i img li ol p pre s small span strike strong sub sup table tbody td tfoot th thead tr tt u ul".split())
_PUNCTUATION = str.maketrans("", "", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


class Node:
    """An element; ``items`` holds strings and nodes in order."""

    __slots__ = ("tag", "attrs", "items", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.items, self.parent = tag, attrs, [], parent

    def children(self) -> list[Node]:
        return [x for x in self.items if not isinstance(x, str)]

    def text(self) -> str:
        """All text within."""
        items = self.items
        if len(items) == 1 and isinstance(items[0], str):
            return items[0]
        return "".join(_texts(self))

    def first_text(self) -> str:
        """The text before the first child."""
        out = []
        for x in self.items:
            if not isinstance(x, str):
                break
            out.append(x)
        return "".join(out)

    def rows(self) -> list[Node]:
        """The children of a table, row groups replaced by their own children."""
        return [y for x in self.children() for y in (x.children() if x.tag in _SECTIONS else [x])]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def _close_to(self, tags: frozenset[str] | tuple[str, ...], stop: tuple[str, ...]) -> None:
        """Close the outermost open element of ``tags`` that lies within the nearest of ``stop``."""
        node, found = self.open, None
        while node.parent is not None and node.tag not in stop:
            if node.tag in tags:
                found = node
            node = node.parent
        if found is not None:
            self.open = found.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("td", "th"):
            self._close_to(("td", "th"), ("tr", "table"))
        elif tag == "tr":
            self._close_to(("tr", "td", "th", "caption"), ("table",))
        elif tag in _SECTIONS:
            self._close_to((*_SECTIONS, "tr", "td", "th", "caption"), ("table",))
        elif tag == "li":
            self._close_to(("li",), ("ul", "ol", "table"))
        elif tag in _ENDS_P:
            node = self.open
            while node.parent is not None and node.tag in _INLINE and node.tag != "p":
                node = node.parent
            if node.tag == "p":
                self.open = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {}, self.open)
        self.open.items.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open.tag == tag:
            self.open = self.open.parent

    def handle_endtag(self, tag: str) -> None:
        node = self.open
        while node.parent is not None and node.tag != tag:
            if node.tag == "table":
                return
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data: str) -> None:
        self.open.items.append(data)


def _plain_tree(html: str) -> Node | None:
    """The root over a page of plain tags, as ``_Builder`` would have it; None for any other page."""
    builder = _Builder()
    start, end, data = builder.handle_starttag, builder.handle_endtag, builder.handle_data
    for closes, tag, values, alone, text, other in _PARTS.findall(html):
        if text:
            data(unescape(text) if "&" in text else text)
        elif other or tag not in _PLAIN:
            return None
        elif closes:
            if values or alone:
                return None
            end(tag)
        elif alone:
            builder.handle_startendtag(tag, _VALUES.findall(values))
        else:
            start(tag, _VALUES.findall(values) if values else ())
    return builder.root


def tree(html: str) -> Node:
    """The root over the elements of ``html``; pages of plain tags are cut by one pattern, others by the parser."""
    root = _plain_tree(html)
    if root is None:
        builder = _Builder()
        builder.feed(html)
        builder.close()
        root = builder.root
    return root


def strip_punctuation(text: str) -> str:
    return text.translate(_PUNCTUATION)


def find_tables(root: Node, mode: str = "compat") -> list[Node]:
    """The data tables in the order of their numbers."""
    found: list[tuple[int, int, Node]] = []
    stack, at = [root], 0
    while stack:
        node = stack.pop()
        if node.tag == "table":
            kind = node.attrs.get("class", "")
            if mode == "clean" and TABLE_CLASSES[0] in kind.split():
                found.append((0, at, node))
            elif mode != "clean" and kind in TABLE_CLASSES:
                found.append((TABLE_CLASSES.index(kind), at, node))
            at += 1
        stack.extend(x for x in reversed(node.items) if not isinstance(x, str))
    return [n for _, _, n in sorted(found, key=lambda x: x[:2])]


def section_of(table: Node, title: str) -> str:
    """The text of the nearest heading before the table among its siblings, else the page's title."""
    siblings = table.parent.children() if table.parent else []
    before = siblings[: next(i for i, x in enumerate(siblings) if x is table)] if siblings else []
    for node in reversed(before):
        if node.tag in _HEADINGS:
            for child in node.children():
                if "id" in child.attrs:
                    text = child.first_text() or next((x for x in _texts(child) if x), "")
                    return strip_punctuation(text)
    return strip_punctuation(title)


def _texts(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            yield x
        else:
            stack.extend(reversed(x.items))


def _span(attrs: dict[str, str], name: str) -> int:
    """A span attribute; 1 where it is absent or no number, and for columns ``WIDEST`` at most."""
    if name not in attrs:
        return 1
    try:
        n = max(1, int(attrs[name]))
    except ValueError:
        return 1
    return min(n, WIDEST if name == "colspan" else (1 << 31) - 1)


def as_number(text: str) -> float | None:
    """The number that ``text`` reads as."""
    return float(text) if _NUMBER.fullmatch(text) else None


def number_text(x: float) -> str:
    """A number with up to 12 digits, and with a point."""
    text = f"{x:.12g}"
    return text if any(c in text for c in ".en") else text + ".0"


def header_rows(table: Node) -> tuple[list[list[tuple[str, int, int]]], bool, int]:
    """(rows of (text, colspan, rowspan), whether headers stand beside data, headers without text)."""
    found, vertical, bare, data = [], False, 0, False
    for row in table.rows():
        own = row.children()
        heads = [x for x in own if x.tag == "th"]
        cells = any(x.tag == "td" for x in own)
        if heads and (not cells and not data or cells):
            vertical |= cells
            line = []
            for x in heads:
                text = x.text().replace("\n", " ")
                bare += not text
                line.append((text.replace("'", "."), _span(x.attrs, "colspan"), _span(x.attrs, "rowspan")))
            found.append(line)
        elif cells:
            data = True
    return found, vertical, bare


def span_grid(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Header rows with spans resolved: a wide cell is repeated, a high one goes on as empty text."""
    grid = [[[text, high] for text, wide, high in row for _ in range(wide)] for row in rows]
    for i, row in enumerate(grid[:-1]):
        for j, (_, high) in enumerate(row):
            if high > 1:
                grid[i + 1].insert(j, ["", high - 1])
    return [[text for text, _ in row] for row in grid]


def data_cell(cell: Node) -> dict:
    """A cell as links, text, what the text is as a number, and colspan."""
    links = []
    for a in cell.items:
        if not isinstance(a, str) and a.tag == "a":
            link = a.first_text() if a.attrs.get("class") == "new" else a.attrs.get("title")
            if link:
                links.append(link)
    text = cell.text().replace(NBSP, " ")
    if "\n" in text:
        text = _EDGES.sub("", text).replace("\n", "/")
    td = text or (None if links else EMPTY)
    number = None if td is None else as_number(td)
    return {"links": links, "td": td, "number": None if number is None else number_text(number), "colspan": _span(cell.attrs, "colspan") if text else 1}


def data_rows(table: Node) -> list[list[dict]]:
    """Rows with a data cell, with all their cells."""
    rows = [row.children() for row in table.rows()]
    return [[data_cell(x) for x in row] for row in rows if any(x.tag == "td" for x in row)]


def places(rows: list[Node], most: int) -> list[list[tuple[Node, bool] | None]]:
    """For each row, by columns up to ``most``, the cell that holds the place and whether it begins in this row.

    A cell begins at the first free place of its row, and holds the columns and
    rows of its spans as far as no other does; what none holds is None.
    """
    out = []
    above: dict[int, tuple[Node, int]] = {}  # column: the cell from above, and for how many rows more
    for row in rows:
        held = {c: (cell, False) for c, (cell, _) in above.items()}
        above = {c: (cell, left - 1) for c, (cell, left) in above.items() if left > 1}
        at = 0
        for cell in row.children():
            if cell.tag not in ("td", "th"):
                continue
            while at in held:
                at += 1
            wide, high = _span(cell.attrs, "colspan"), _span(cell.attrs, "rowspan")
            for c in range(at, min(at + wide, most)):
                if c not in held:
                    held[c] = (cell, True)
                    if high > 1:
                        above[c] = (cell, high - 1)
            at += wide
        out.append([held.get(c) for c in range(max(held, default=-1) + 1)])
    return out


def laid_out(table: Node, heads: list[list[tuple[str, int, int]]]) -> tuple[list[list[str]], list[list[dict]]]:
    """Header rows and data rows by the places that cells hold, as wide as the header rows can be.

    A header's text is in the first of its rows, once for each column; a data
    cell is in each place that it holds. A place that none holds is empty.
    """
    rows = table.rows()
    tags = [{x.tag for x in row.children()} for row in rows]
    grid = places(rows, sum(wide for row in heads for _, wide, _ in row))
    header, data, seen = [], [], False
    known: dict[int, dict] = {}
    empty = {"links": [], "td": EMPTY, "number": None, "colspan": 1}

    def cell(place: tuple[Node, bool] | None) -> dict:
        if place is None:
            return empty
        if id(place[0]) not in known:
            known[id(place[0])] = data_cell(place[0]) | {"colspan": 1}
        return known[id(place[0])]

    for own, line in zip(tags, grid, strict=True):
        if "th" in own and ("td" in own or not seen):
            of_heads = [x for x in line if x is None or x[0].tag == "th"]
            header.append([x[0].text().replace("\n", " ").replace("'", ".") if x is not None and x[1] else "" for x in of_heads])
        if "td" in own:
            data.append([cell(x) for x in line])
            seen |= "th" not in own
    return header, data


def _let_go(root: Node) -> None:
    """Take a tree apart, so that it goes at once and not by Python's cycle collector."""
    stack = [root]
    while stack:
        node = stack.pop()
        node.parent = None
        stack.extend(x for x in node.items if not isinstance(x, str))


def parse_page(html: str, title: str, mode: str = "compat", data: bool = True) -> list[dict]:
    """One dictionary for each data table of a page."""
    found = []
    root = tree(html)
    for i, table in enumerate(find_tables(root, mode)):
        heads, vertical, bare = header_rows(table)
        grid, cells = laid_out(table, heads) if mode == "clean" else (span_grid(heads), data_rows(table) if data else [])
        found.append(
            {
                "table_ord": i,
                "section": section_of(table, title),
                "vertical": vertical,
                "n_rows": len(table.rows()),
                "attrs": table.attrs,
                "headers_raw": [[{"th": t, "colspan": c, "rowspan": r} for t, c, r in row] for row in heads],
                "header_grid": grid,
                "data_raw": cells if data else [],
                "headers_not_resolved": bare,
            }
        )
    _let_go(root)
    return found
