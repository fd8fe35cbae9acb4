"""Visible text of HTML pages, laid out as a text browser would.

A tokenizer and a tree builder make a tree of each page: missing html, head and body are implied, a new block ends an open
paragraph, items, terms, rows, cells and options end their open fellows, an end tag closes what is open inside its element, and
one without an element is ignored. Rendering leaves out what a browser doesn't show: head, scripts, styles, templates, embedded
objects, elements that are hidden by attribute, by an inline style or by the page's own style sheets (see ``styles``), closed details but
for their summary, and closed dialogs. Visibility is inherited and may be overridden. Formulas give their text, drawings that of their text
elements and foreign objects, but not what is drawn by reference only. White space collapses outside pre and textarea. Blocks
begin on a new line, paragraphs, headings, lists, tables and the like stand between blank lines, list items have
bullets or numbers and are indented by depth, and table cells are padded to their column's width (at most ``WIDEST``).

Nothing recurses, so nesting may be as deep as it likes.

Defined results: a null page gives null, an empty one an empty text; markup that is cut off is read as far as it goes; repeated
rows get a row each; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .styles import Sheet
from .work import lean, slices

WIDEST = 60
#: Items, quotes and cells within so many others are laid out as plain blocks, so that a page's text is never much longer than the page.
DEEPEST = 40

#: Fixed values of HTML: elements without content, with raw text, and with rules of their own.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes noscript object embed audio video canvas datalist annotation annotation-xml".split())
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker".split())
#: HTML may stand within these elements of a drawing or formula; elsewhere in it, these tags end it.
HOSTS = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HEAD = frozenset("base link meta script style title noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset menu hr".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li main nav search section summary tr thead tbody tfoot caption option optgroup center dir".split())
#: An open element is ended by the start of any of these, up to the first element of its scope.
ENDED_BY = {
    "p": BLOCK - frozenset("html body tr thead tbody tfoot caption option optgroup li dd dt summary legend".split()) | frozenset("li dd dt".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset("td th tr thead tbody tfoot".split()), "th": frozenset("td th tr thead tbody tfoot".split()),
    "tr": frozenset("tr thead tbody tfoot".split()), "thead": frozenset(["tbody", "tfoot", "thead"]), "tbody": frozenset(["tbody", "tfoot", "thead"]), "tfoot": frozenset(["tbody", "tfoot", "thead"]),
    "caption": frozenset("td th tr thead tbody tfoot".split()), "option": frozenset(["option", "optgroup"]), "optgroup": frozenset(["optgroup"]), "head": frozenset(["body"]),
}
#: The same the other way round: what the start of each element ends.
ENDS = {tag: tuple(k for k, by in ENDED_BY.items() if tag in by) for by in ENDED_BY.values() for tag in by}
IN_TABLES = frozenset("table tr td th thead tbody tfoot".split())
SCOPE = frozenset("table ul ol dl td th caption select button object template html body".split())

_OTHER = r"</([a-zA-Z][^\s/>]*+)[^>]*+>|<[!?/][^>]*+>|([^<]++|<)"
_COMMENT = r"<!--(.*?)(?:--!?>|\Z)|<([a-zA-Z][^\s/>]*+)"
#: Nothing here goes back over what it has read. The second one is for what follows a tag that never ends because of a quote: there, quotes are like other marks.
_TOKEN = re.compile(_COMMENT + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|" + _OTHER, re.DOTALL)
_PLAIN = re.compile(_COMMENT + r"([^>]*+)>|" + _OTHER, re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: bool = False) -> None:
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTRIBUTE.finditer(source)))}


class _Open:
    """Open elements from the outermost on, and where those of each name and those that bound a scope stand."""

    __slots__ = ("nodes", "places", "scopes")

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.scopes = [], {}, []
        self.push(root)

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in SCOPE:
            self.scopes.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """End the elements from this place on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()

    def last(self, tags) -> int:
        """Place of the innermost element with one of these names; 0 for none, or for the root."""
        return max((own[-1] for t in tags if (own := self.places.get(t))), default=0)

    def start(self, tag: str, attributes: dict[str, str]) -> Node:
        outer = self.nodes[-1]
        node = Node(tag, attributes, tag in ("svg", "math") or outer.foreign and outer.tag not in HOSTS)
        outer.children.append(node)
        self.push(node)
        return node

    def pop(self) -> None:
        self.cut(len(self.nodes) - 1)

    @property
    def inner(self) -> str:
        return self.nodes[-1].tag


def parse(source: str) -> Node:
    """The tree of a page; children are nodes and strings."""
    root = Node("html", {})
    open_ = _Open(root)
    at, size, token = 0, len(source), _TOKEN
    while at < size:
        m = token.match(source, at)
        if (text := m[5]) is not None:
            if text == "<" and source[at + 1 : at + 2].isalpha() and source[at + 1].isascii() or text == "<" and source[at + 1 : at + 2] in ("!", "?", "/"):
                if source.find(">", at) < 0:  # no further tag ends
                    text, m = source[at:], None
                elif token is _TOKEN:
                    token = _PLAIN
                    continue
            at = m.end() if m else size
            if open_.inner in ("html", "head") and not text.isspace():
                _body(open_, root)
            if open_.inner not in ("html", "head"):
                open_.nodes[-1].children.append(unescape(text) if "&" in text else text)
            continue
        at = m.end()
        if (tag := m[2]) is not None:
            tag = tag.lower()
            attributes = _attributes(m[3])
            if tag in ("html", "body"):
                if tag == "body" and not open_.places.get("body"):
                    _body(open_, root)
                    open_.nodes[-1].attributes.update(attributes)
                continue
            if tag == "head":
                if len(open_.nodes) == 1:
                    open_.start(tag, attributes)
                continue
            if open_.inner in ("html", "head") and tag not in HEAD:
                _body(open_, root)
            elif open_.inner == "html" and not any(n.tag == "body" for n in root.children if isinstance(n, Node)):
                open_.start("head", {})
            if tag in LEAVES:
                while open_.nodes[-1].foreign and open_.inner not in HOSTS:
                    open_.pop()
            _imply(open_, tag)
            node = open_.start(tag, attributes)
            if tag in VOID or node.foreign and m[3].rstrip().endswith("/"):
                open_.pop()
            elif tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE).search(source, at)
                raw = source[at : end.start() if end else size]
                node.children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                at = end.end() if end else size
                open_.pop()
        elif (tag := m[4]) is not None:
            _end(open_, tag.lower())
    return root


def _end(open_: _Open, tag: str) -> None:
    if tag == "br":
        open_.nodes[-1].children.append(Node("br", {}))
    elif tag == "p" and not open_.places.get("p"):
        open_.start("p", {})
        open_.pop()
    elif tag not in ("html", "body") and (at := open_.last((tag,))):
        # An inline end tag doesn't close a cell or a table.
        if tag in IN_TABLES or at >= open_.last(("table", "td", "th", "body")):
            open_.cut(at)


def _body(open_: _Open, root: Node) -> None:
    open_.cut(1)
    for n in root.children:
        if isinstance(n, Node) and n.tag == "body":
            open_.push(n)
            return
    open_.start("body", {})


def _imply(open_: _Open, tag: str) -> None:
    """End what the start of ``tag`` ends, and open what it needs."""
    if ends := ENDS.get(tag):
        while (at := open_.last(ends)) and at >= open_.scopes[-1]:
            open_.cut(at)
    _within_table(open_, tag)


def _within_table(open_: _Open, tag: str) -> None:
    if tag in ("td", "th") and open_.inner in ("table", "thead", "tbody", "tfoot"):
        open_.start("tr", {})


def _hidden(node: Node, style: dict[str, str]) -> bool:
    a = node.attributes
    if node.tag in UNSEEN or node.foreign and node.tag in UNDRAWN or node.tag == "input" and a.get("type", "").lower() == "hidden":
        return True
    if "display" in style:
        return style["display"] == "none"
    return "hidden" in a or node.tag == "dialog" and "open" not in a


class _Flow:
    """Lines of a block, and the line that is being filled."""

    __slots__ = ("lines", "inline", "gap", "node")

    def __init__(self, node: Node | None = None) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap, self.node = False, node

    def end_line(self) -> None:
        if self.inline:
            text = "".join(self.inline)
            self.inline = []
            if not text.isspace():
                self.add([text.strip(" ")])

    def add(self, lines: list[str]) -> None:
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if text[0] == " " and (not self.inline or self.inline[-1].endswith((" ", "\n"))):
            text = text[1:]
        if text:
            self.inline.append(text)

    def space(self) -> None:
        self.end_line()
        self.gap = True


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table from its cells: their lines, and how many columns and rows they span."""
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # the row below the last one that a cell from above takes of a column
    placed = []
    for number, row in enumerate(rows):
        at, own = 0, []
        for lines, span, down in row:
            while taken.get(at, 0) > number:
                at += 1
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(WIDEST, max(map(len, lines), default=0)))
            if down > 1:
                taken.update(dict.fromkeys(range(at, at + span), number + down))
            own.append((lines, at, span))
            at += span
        placed.append(own)
    out = []
    for row in placed:
        for k in range(max((len(lines) for lines, _, _ in row), default=0)):
            at, line, pad = 0, [], 0
            for lines, start, span in row:
                pad += sum(widths.get(c, 0) + 2 for c in range(at, start))
                own = lines[k] if k < len(lines) else ""
                line.append(" " * pad + own)
                width = sum(widths.get(c, 0) for c in range(start, start + span)) + 2 * (span - 1)
                pad = max(0, width - len(own)) + 2
                at = start + span
            out.append("".join(line).rstrip())
    return out


def _number(value: str | None, default: int, most: int = 1000) -> int:
    return min(most, int(value)) if value and value.strip().isdigit() else default


def _placed(node: Node) -> bool:
    """Does a drawing's text start at a place of its own?"""
    return node.tag == "text" or node.tag == "tspan" and not node.attributes.keys().isdisjoint(("x", "y", "dy"))


def render(root: Node) -> str:
    sheet = Sheet(root)
    flows = [_Flow()]
    tables: list[tuple[Node, list]] = []
    lists: list[list] = []
    pre = 0
    visible, drawn = [True], [""]  # of the open elements; drawn: "svg" where text isn't drawn
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        item, leaving = stack.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if not visible[-1] or drawn[-1] == "svg":
                continue
            if pre:
                flow.inline.append(item)
            elif item:
                flow.text(item)
            continue
        tag = item.tag
        if not leaving:
            style = sheet.style(item)
            if _hidden(item, style):
                continue
            seen = style["visibility"] == "visible" if "visibility" in style else visible[-1] and tag != "mphantom"
            if tag in VOID and tag != "hr" and not seen:
                if tag == "br":
                    flow.end_line()
                continue
            if tag == "br":
                if pre:
                    flow.inline.append("\n")
                else:
                    text = "".join(flow.inline).strip(" ")
                    flow.inline = []
                    flow.add([text])
                continue
            if tag == "img":
                if alt := item.attributes.get("alt", "").strip():
                    flow.text(alt)
                continue
            if tag == "input":
                if item.attributes.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel", "number") and (value := item.attributes.get("value", "").strip()):
                    flow.text(value)
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag in SPACED and not (tag in ("ul", "ol") and lists):
                flow.space()
            elif tag in BLOCK:
                flow.end_line()
            if tag in ("pre", "textarea"):
                flow.end_line()
                pre += 1
            elif tag in ("ul", "ol", "menu", "dir"):
                lists.append([tag == "ol", _number(item.attributes.get("start"), 1, 10**9)])
            elif tag == "table" and len(flows) < DEEPEST:
                tables.append((item, []))
                flows.append(_Flow(item))
            elif tag == "tr" and tables:
                tables[-1][1].append([])
            if (tag in ("li", "blockquote", "dd") or tag in ("td", "th") and tables and tables[-1][1]) and len(flows) < DEEPEST + 1:
                flows.append(_Flow(item))
            elif tag in ("td", "th"):
                flow.end_line()
            stack.append((item, True))
            visible.append(seen)
            drawn.append({"svg": "svg", "text": "text", "foreignobject": ""}.get(tag, drawn[-1]) if item.foreign else "")
            children = item.children
            if item.foreign:
                if drawn[-1] == "text" and _placed(item) and seen:
                    flow.text(" ")
                if tag in ("mfrac", "mroot", "mtr", "mtable"):
                    children = [x for c in children for x in (" ", c)]
            if tag == "details" and "open" not in item.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            stack += [(c, False) for c in reversed(children)]
            continue
        if drawn.pop() == "text" and _placed(item) and visible[-1]:
            flow.text(" ")
        visible.pop()
        if tag in ("pre", "textarea"):
            pre -= 1
            text = "".join(flow.inline)
            flow.inline = []
            lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            while lines and not lines[0].strip():
                del lines[0]
            while lines and not lines[-1].strip():
                del lines[-1]
            flow.add([x.rstrip() for x in lines])
        elif flow.node is item:
            flow.end_line()
            flows.pop()
            lines, outer = flow.lines, flows[-1]
            if tag in ("td", "th"):
                tables[-1][1][-1].append((lines, max(1, _number(item.attributes.get("colspan"), 1)), max(1, _number(item.attributes.get("rowspan"), 1, 65_534))))
            elif tag == "table":
                _, rows = tables.pop()
                outer.end_line()
                outer.add(lines)  # a caption, and what stands in the table but in no cell
                outer.add(_table(rows))
            else:
                head = indent = "  "
                if tag == "li":
                    head = "- "
                    if lists and lists[-1][0]:
                        number = _number(item.attributes.get("value"), lists[-1][1], 10**9)
                        head, lists[-1][1] = f"{number}. ", number + 1
                    indent = " " * len(head)
                outer.end_line()
                if lines:
                    outer.add([head + lines[0], *(indent + x if x else "" for x in lines[1:])])
        elif tag in BLOCK:
            flow.end_line()
        if tag in ("ul", "ol", "menu", "dir") and lists:
            lists.pop()
        if tag in SPACED and not (tag in ("ul", "ol") and lists):
            flows[-1].space()
    flow = flows[0]
    flow.end_line()
    lines: list[str] = []
    for x in flow.lines:
        x = x.replace("\xa0", " ").rstrip()
        if x or lines and lines[-1]:
            lines.append(x)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def html_to_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([html_to_text(x) for x in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id and text, from columns page_id and html."""
    return pages.select("page_id", "html").mapInArrow(lean(_extract), "page_id long, text string")
