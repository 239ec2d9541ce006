"""Layout-aware HTML rendering: a tree builder with implied tags, visibility rules, and a block layout.

All visible text is kept: navigation and footers too. Blocks start on lines of their own, paragraphs and the like
are set off by a blank line, list items are marked and indented by depth, and table cells are padded so that their
columns align. White space collapses as on a page, but not in pre.

Results for odd input: null and empty pages give an empty text; broken markup is repaired, never refused; depth is
unbounded, as nothing here recurses; rows that share an id are rendered apart; other columns are left alone.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from torquil.llm import common as C

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)|[^<]+|<""", re.S)
#: What stands in a tag up to its end, quoted or not; what repeats never gives back.
_INSIDE = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_SHADE = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist noembed noframes".split())
#: Unseen inside svg and math.
UNDRAWN = frozenset("title desc defs metadata symbol annotation annotation-xml".split())
#: Elements of math whose parts stand apart on a page: over, under and beside each other.
PARTS = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot mtr mlabeledtr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table caption tbody thead tfoot tr ul".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
CLOSES_P = BLOCK - frozenset("body html li dd dt legend option optgroup caption tbody thead tfoot tr summary".split()) | {"li", "dd", "dt"}
#: A start tag closes these, up to one of the fences.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
FENCES = frozenset({"table", "td", "th", "body", "html"})


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []


class Open:
    """The open elements, with the places of each name, so that none is looked for among all."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def has(self, name: str) -> bool:
        return bool(self.places.get(name))

    def close(self, names, fences) -> None:
        """Closes the nearest element of one name above the last fence, or all elements of several names there."""
        at = [p for n in names if (p := self.places.get(n))]
        if not at:
            return
        fence = max((p[-1] for n in fences if n not in names and (p := self.places.get(n))), default=0)
        found = [p[bisect.bisect_right(p, fence) if len(names) > 1 else -1] for p in at if p[-1] > fence]
        if found:
            while len(self.nodes) > min(found):
                self.places[self.nodes.pop().name].pop()


def _tag_end(page: str, at: int, last: int) -> int:
    """Where the tag ends that goes on at this place: at a > outside quotes, else at the next one; -1 if there is none."""
    if at > last:
        return -1
    end = _INSIDE.match(page, at).end()
    return end if end < len(page) and page[end] == ">" else page.find(">", at)


def build(page: str) -> Node:
    """The page's tree; end tags that are left out are implied, those that match nothing are ignored."""
    root = Node("html")
    open_ = Open(root)
    at, last = 0, page.rfind(">")
    while m := _TOKEN.match(page, at):
        at, name = m.end(), m[1]
        end = _tag_end(page, at, last) if name else -1
        if name is None or end < 0:
            if m[0][0] != "<" or m[0] == "<" or name:
                open_.nodes[-1].children.append(html.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        name, inside, at = name.lower(), page[at:end], end + 1
        if m[0][1] == "/":
            if name == "p" and not open_.has("p"):
                open_.nodes[-1].children.append(Node("p"))
            elif name not in VOID:
                open_.close({name}, FENCES - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") else {"table"} - {name})
            continue
        if name == "html" or name == "body" and open_.has("body"):
            continue
        if name in IMPLIED:
            open_.close(*IMPLIED[name])
        if name in CLOSES_P:
            open_.close({"p"}, FENCES | {"li", "blockquote", "div", "article", "section"} if name != "p" else FENCES)
        if name == "body" or open_.nodes[-1].name == "head" and name in BLOCK:
            open_.close({"head"}, {"html"})
        node = Node(name, inside)
        open_.nodes[-1].children.append(node)
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : stop.start() if stop else len(page)]
            node.children.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = stop.end() if stop else len(page)
        elif name not in VOID and not inside.rstrip().endswith("/") or name in BLOCK and name not in VOID:
            open_.push(node)
    return root


def attributes(node: Node) -> dict[str, str]:
    found: dict[str, str] = {}
    for k, a, b, c in _ATTRIBUTE.findall(node.attributes):
        found.setdefault(k.lower(), html.unescape(a or b or c or ""))
    return found


def visible(node: Node, drawn: bool = False) -> bool:
    """By its kind, hidden attribute, inline style, and closed dialogs; drawn: inside svg or math."""
    if node.name in UNSEEN or drawn and node.name in UNDRAWN:
        return False
    if not node.attributes:
        return node.name != "dialog"
    found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(node.attributes)}
    if "hidden" in found or _HIDING.search(found.get("style", "")) or node.name == "dialog" and "open" not in found:
        return False
    if drawn and found.get("display") == "none":
        return False
    return not (node.name == "input" and found.get("type", "").lower() == "hidden")


def lit_box(node: Node, before: bool, drawn: bool = False) -> bool:
    """Whether the box itself is drawn: visibility is inherited, and what is inside can be visible again."""
    if "visibility" not in node.attributes.lower():
        return before
    found = attributes(node)
    style = _SHADE.findall(found.get("style", ""))
    last = style[-1].lower() if style else found.get("visibility", "") if drawn else ""
    return last == "visible" if last in ("hidden", "collapse", "visible") else before


def texts(node: Node) -> str:
    """All visible text below a node, as one line."""
    out, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif visible(x):
            todo += reversed(x.children)
    return _SPACE.sub(" ", "".join(out)).strip(" ")


def options(select: Node) -> tuple[list[str], bool]:
    """The lines a select shows, and whether it is a list: all options and the labels of their groups if so, else the chosen option, which is the last one selected or the first one that can be."""
    own = attributes(select)
    size = re.match(r"\s*(\d+)", own.get("size", ""))
    listed = int(size[1]) > 1 if size and int(size[1]) else "multiple" in own
    lines, chosen, first = [], None, None
    todo = [(c, False) for c in reversed(select.children)]
    while todo:
        x, off = todo.pop()
        if isinstance(x, str) or not visible(x):
            continue
        found = attributes(x)
        off = off or "disabled" in found
        if x.name == "option":
            line = found.get("label") or texts(x)
            lines.append(line)
            chosen = line if "selected" in found else chosen
            first = line if first is None and not off else first
            continue
        if x.name == "optgroup" and found.get("label"):
            lines.append(found["label"])
        todo += [(c, off) for c in reversed(x.children)]
    if listed:
        return lines, True
    shown = chosen if chosen is not None else first
    return [shown] if shown is not None else [], False


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two, combining ones none."""
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of one box: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap, self.indent, self.mark, self.space = 0, 0, "", False

    def text(self, text: str) -> None:
        words = _SPACE.sub(" ", text)
        if words == " " or not words:
            self.space = self.space or bool(words)
            return
        if self.line and (self.space or words[0] == " "):
            self.line.append(" ")
        self.line.append(words.strip(" "))
        self.space = words[-1] == " "

    def kept(self, text: str) -> None:
        for k, part in enumerate(text.split("\n")):
            if k:
                self.end(True)
            if part:
                self.line.append(part)

    def end(self, blank: bool = False) -> None:
        if self.line or blank and self.lines and not self.gap:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            mark = self.mark or ""
            self.lines.append((" " * (self.indent - len(mark)) + mark + "".join(self.line)).rstrip() if self.line else "")
            self.mark = ""
        self.line, self.space = [], False

    def apart(self) -> None:
        self.end()
        if self.lines:
            self.gap = 1


class Grid:
    """A table's cells by row and column; cells that reach over columns or down keep others from their places."""

    def __init__(self):
        self.rows: list[dict[int, str]] = []
        self.taken: dict[int, tuple[int, int]] = {}  # column: (the next one that is free, last row)
        self.column = 0

    def row(self) -> None:
        self.rows.append({})
        self.column = 0

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.taken:
            stop, last = self.taken[self.column]
            if last < len(self.rows):
                del self.taken[self.column]
            else:
                self.column = stop
        if text:
            self.rows[-1][self.column] = text
        if down != 1:
            self.taken[self.column] = self.column + across, len(self.rows) + down - 1 if down else 1 << 62
        self.column += across


def aligned(rows: list[dict[int, str]]) -> list[str]:
    """Rows of cells as lines with columns of equal width; a cell's own lines stand below each other. Columns without text take no room."""
    cells = [{k: c.split("\n") for k, c in r.items()} for r in rows if r]
    widths: dict[int, int] = {}
    for r in cells:
        for k, lines in r.items():
            widths[k] = max(widths.get(k, 0), *map(width, lines))
    columns = sorted(widths)
    out = []
    for r in cells:
        last = max(r)
        for i in range(max(map(len, r.values()))):
            parts = []
            for k in columns:
                if k > last:
                    break
                text = r[k][i] if k in r and i < len(r[k]) else ""
                parts.append(text + " " * (widths[k] - width(text)))
            out.append("  ".join(parts).rstrip())
    return out


def _span(node: Node, name: str) -> int:
    found = re.match(r"\s*(\d+)", attributes(node).get(name, ""))
    return int(found[1]) if found else 1


def render(page: str) -> str:
    flows, tables, lists, pre, drawn = [Flow()], [], [], 0, 0
    todo: list[tuple[Node | str, bool, bool]] = [(build(page), True, True)]
    while todo:
        node, enters, lit = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if lit:
                (flow.kept if pre else flow.text)(node)
            continue
        name = node.name
        if enters:
            if not visible(node, drawn > 0):
                continue
            lit = lit_box(node, lit, drawn > 0)
            if not lit and name in ("img", "textarea", "select", "hr"):
                continue
            if name == "br":
                flow.end(True)
                continue
            if name == "img":
                found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(node.attributes)}
                if found.get("alt"):
                    flow.text(html.unescape(found["alt"]))
                continue
            if name == "textarea":
                flow.end()
                flow.kept(re.sub(r"\A\n", "", "".join(node.children).replace("\r\n", "\n")))
                flow.end()
                continue
            if name == "select":
                shown, listed = options(node)
                for line in shown:
                    if listed:
                        flow.end()
                    flow.text(line)
                if listed:
                    flow.end()
                continue
            if drawn and name in ("text", "mtr", "mlabeledtr"):
                flow.end()
            if drawn and name in PARTS:
                todo.append((node, False, lit))
                todo += [x for c in reversed(node.children) for x in ((c, True, lit), (" ", True, lit))]
                continue
            if name in ("svg", "math"):
                drawn += 1
            if name in BLOCK:
                (flow.apart if name in APART and not (name in ("ul", "ol") and lists) else flow.end)()
            if name in ("ul", "ol", "menu"):
                lists.append([name, 0])
                flow.indent += 2 if name != "ol" else 3
            elif name == "li":
                if lists:
                    lists[-1][1] += 1
                flow.mark = f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "
                flow.indent = max(flow.indent, len(flow.mark))
            elif name in ("blockquote", "dd"):
                flow.indent += 4
            elif name == "pre":
                pre += 1
            elif name == "hr":
                flow.line.append("---")
                flow.apart()
            elif name == "table":
                tables.append(Grid())
            elif name == "tr" and tables:
                tables[-1].row()
            elif name in ("td", "th") and tables:
                flows.append(Flow())
            todo.append((node, False, lit))
            todo += [(c, True, lit) for c in reversed(node.children)]
            continue
        if name in ("td", "th") and tables:
            flow.end()
            flows.pop()
            tables[-1].cell("\n".join(flow.lines), max(1, _span(node, "colspan")), _span(node, "rowspan"))
            continue
        if name == "table" and tables:
            flow.end()
            for line in aligned(tables.pop().rows):
                flow.line.append(line)
                flow.end()
        elif name in ("ul", "ol", "menu"):
            flow.end()
            lists.pop()
            flow.indent -= 2 if name != "ol" else 3
        elif name in ("blockquote", "dd"):
            flow.end()
            flow.indent -= 4
        elif name == "pre":
            pre -= 1
        elif name in ("svg", "math"):
            drawn -= 1
        elif drawn and name in ("text", "mtr", "mlabeledtr"):
            flow.end()
        if name in BLOCK:
            (flow.apart if name in APART and not (name in ("ul", "ol") and lists) else flow.end)()
    flows[0].end()
    return "\n".join(flows[0].lines)


def _render(batch: pa.RecordBatch, column: str):
    texts = [render(p) if p else "" for p in batch.column(column).to_pylist()]
    at = batch.schema.get_field_index(column)
    yield batch.set_column(at, "text", pa.array(texts, pa.string()))


def html_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns of pages and text: the rendered page."""
    C.tune(pages.sparkSession)
    schema = StructType([pages.schema[c] for c in keep]).add("text", "string")
    return C.mapped(pages.select(*keep, F.col(f"`{column}`").cast("string").alias("__html")), _render, schema, column="__html")


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    out = html_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=("page_id",))
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
