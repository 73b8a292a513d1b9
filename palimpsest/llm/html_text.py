"""HTML to text as it would be laid out: blocks on lines of their own, lists with marks, tables in aligned columns, nothing hidden.

A page becomes a tree first: end tags that HTML lets one leave out are implied, void elements have no content, stray end tags
are ignored. Style sheets hide what their rules for one element (tag, classes, id) hide. The tree is then rendered from the leaves up: an element is inline text, or lines with the blank lines it
wants around it.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math datalist area map title".split())
_PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu dir".split())
_BLOCKS = _PARAGRAPHS | frozenset("html body address article aside center details dialog dd div dt figcaption footer form header hgroup legend li main nav section summary search".split())
_TABLE = frozenset("caption colgroup thead tbody tfoot tr td th".split())
#: What the start of an element ends, and which open elements that search doesn't leave.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}) for t in ("thead", "tbody", "tfoot", "caption", "colgroup")},
}
_SCOPE = frozenset("table td th caption html".split())
#: Characters of a cell's line that its column is made as wide as, at most, and of a line up to which columns are kept.
CELL, MARGIN = 120, 240
_DEPTH = 200  # deeper elements join the one at this depth

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_SPACES = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_MARK = re.compile(r"[{};]")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")
_IMPORTANT = re.compile(r"!\s*important\b", re.I)
#: What ``visibility`` shows; inherit and the like keep the parent's value, other words aren't values.
_VISIBILITY = {"visible": True, "initial": True, "hidden": False, "collapse": False, **dict.fromkeys(("inherit", "unset", "revert", "revert-layer"))}


def _blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules of a style sheet in one pass over its braces; at-rules are left out with all that is in them.
    What is never closed ends with the sheet."""
    sheet = _COMMENT.sub(" ", sheet)
    start, at, known = 0, 0, -1
    while m := _MARK.search(sheet, at):
        at, mark = m.end(), m[0]
        if known != start:
            known, begin = start, re.compile(r"\S").search(sheet, start)
            within_at_rule = begin[0] == "@"
        if mark == ";":
            start = at if within_at_rule else start
        elif mark == "}":
            start = at
        elif within_at_rule:
            depth = 1
            while depth and (m := _MARK.search(sheet, at)):
                at, depth = m.end(), depth + {"{": 1, "}": -1}.get(m[0], 0)
            if depth:
                return
            start = at
        else:
            end = at
            while (m := _MARK.search(sheet, end)) and m[0] == ";":
                end = m.end()
            if m is None or m[0] == "}":
                yield sheet[start : at - 1], sheet[at : m.start() if m else len(sheet)]
                at = m.end() if m else len(sheet)
            start = at


def _rules(sheet: str) -> list[tuple[str, frozenset[str], str | None, str, str]]:
    """(tag, classes, id, usual declarations, important ones) of the rules of a style sheet that have display or visibility. Selectors of one
    element only, by tag, classes and id; others and at-rules are left out."""
    found = []
    for selectors, body in _blocks(sheet):
        own = [d.strip() for d in body.lower().split(";") if d.strip().startswith(("display", "visibility"))]
        if own:
            usual, marked = (";".join(_IMPORTANT.sub("", d) for d in own if bool(_IMPORTANT.search(d)) == m) for m in (False, True))
            for s in selectors.split(","):
                if (m := _SELECTOR.fullmatch(s.strip())) and m[0]:
                    parts = re.findall(r"[.#][\w-]+", m[2])
                    ids = [p[1:] for p in parts if p[0] == "#"]
                    if len(set(ids)) < 2:
                        found.append(((m[1] or "*").lower(), frozenset(p[1:] for p in parts if p[0] == "."), ids[0] if ids else None, usual, marked))
    return found


def _apply(root: Node, sheets: list[str]) -> None:
    """Puts the declarations of matching rules around each element's own style: weaker ones before it, important ones after it."""
    rules = [r for sheet in sheets for r in _rules(sheet)]
    rules.sort(key=lambda r: (r[2] is not None, len(r[1]), r[0] != "*"))  # by weight, then as they come
    by: dict[tuple[str, str], list[int]] = {}  # rules by what an element needs for them: an id, else a class, else the tag
    for i, (tag, classes, id_, _, _) in enumerate(rules):
        by.setdefault(("#", id_) if id_ is not None else (".", min(classes)) if classes else ("", tag), []).append(i)
    nodes = [root] if rules else []
    while nodes:
        for node in nodes.pop().children:
            if not isinstance(node, str):
                nodes.append(node)
                classes, id_ = set(node.attrs.get("class", "").split()), node.attrs.get("id")
                near = sorted(i for key in (("", "*"), ("", node.tag), ("#", id_), *((".", c) for c in classes)) for i in by.get(key, ()))
                own = [r for r in map(rules.__getitem__, near) if r[0] in ("*", node.tag) and r[1] <= classes and r[2] in (None, id_)]
                if own:
                    node.attrs["style"] = ";".join([*[r[3] for r in own], node.attrs.get("style", ""), *[r[4] for r in own]])


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def parse(page: str) -> Node:
    root = Node("html", {})
    stack, at, end, sheets = [root], 0, len(page), []

    def close(tags, stop) -> bool:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
                return True
            if stack[i].tag in stop:
                return False
        return False

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else end]
        if text:
            stack[-1].children.append(html.unescape(text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            close({tag}, _SCOPE - {tag} if tag not in _TABLE and tag != "table" else {"table"} - {tag})
            continue
        if tag in _BLOCKS or tag == "table":
            close({"p"}, _SCOPE | {"button"})
        if tag == "body":
            close({"head"}, set())
        if tag in _ENDS:
            tags, stop = _ENDS[tag]
            while close(tags, stop):
                pass
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and re.fullmatch("h[1-6]", stack[-1].tag):
            stack.pop()
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /\n\t") else {})
        stack[-1].children.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            node.children.append(html.unescape(page[at : stop.start() if stop else end]) if tag in ("textarea", "title") else page[at : stop.start() if stop else end])
            at = page.find(">", stop.start()) + 1 or end if stop else end
            if tag == "style" and node.attrs.get("media", "all").lower() in ("", "all", "screen"):
                sheets += node.children
        elif tag not in _VOID and not m[3].rstrip().endswith("/") or tag in _BLOCKS and tag != "hr":
            if len(stack) < _DEPTH:
                stack.append(node)
    _apply(root, sheets)
    return root


class _Lines:
    """Lines so far; ``gap`` blank lines are wanted before the next one, ``lead`` before the first."""

    def __init__(self):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.gap = self.lead = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.inline.append(first)
            for line in rest:
                self.flush(True)
                self.inline.append(line)
        else:
            self.inline.append(_SPACES.sub(" ", s))

    def flush(self, keep: bool = False) -> None:
        line = "".join(self.inline)
        line = line.rstrip() if keep else _SPACES.sub(" ", line).strip(" ")
        self.inline = []
        if line or keep:
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append(line)

    def block(self, lines: list[str], before: int, after: int | None = None) -> None:
        self.flush()
        if lines:
            self.gap = max(self.gap, before)
            if self.lines and self.gap:
                self.lines += [""] * self.gap
            elif not self.lines:
                self.lead = before
            self.lines += lines
            self.gap = before if after is None else after


def _shown(node: Node, visible: bool) -> tuple[bool, bool, str | None]:
    """Whether the element is laid out, whether its own text is visible, and its display, if its style has one."""
    if node.tag in _HIDDEN:
        return False, False, None
    if not node.attrs:
        return True, visible, None
    found = _STYLE.findall(_COMMENT.sub(" ", node.attrs["style"].lower())) if "style" in node.attrs else []
    style = {name: value for name, value in found if name == "display" or value in _VISIBILITY}
    if "hidden" in node.attrs or style.get("display") == "none" or node.tag == "dialog" and "open" not in node.attrs or node.tag == "input":
        return False, False, None
    own = _VISIBILITY.get(style.get("visibility", "inherit"))
    visible = visible if own is None else own
    return True, visible, style.get("display")


def _render(node: Node, out: _Lines, visible: bool, pre: bool, depth: int) -> None:
    number = 1
    if node.tag == "ol":
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    closed = node.tag == "details" and "open" not in node.attrs
    for child in node.children:
        if isinstance(child, str):
            if visible and not closed:
                out.text(child, pre)
            continue
        shown, own, display = _shown(child, visible)
        if not shown or closed and child.tag != "summary":
            continue
        tag = child.tag
        if tag == "br":
            out.flush(bool("".join(out.inline).strip()) or bool(out.lines) and not out.gap)
        elif tag == "hr":
            out.block(["-" * 3] if own else [], 1)
        elif tag == "table" and display not in ("block", "inline"):
            out.block(_table(child, own, pre, depth), 1)
        elif tag == "li" and display is None:
            inner = _Lines()
            _render(child, inner, own, pre, depth + 1)
            inner.flush()
            mark = "• "
            if node.tag == "ol":
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
                mark, number = f"{number}. ", number + 1
            lines = inner.lines
            out.block([(mark if i == 0 else " " * len(mark)) + s if s else s for i, s in enumerate(lines)], 0)
        elif (tag in _BLOCKS or display in ("block", "flex", "grid", "list-item")) and display not in ("inline", "inline-block", "contents"):
            inner = _Lines()
            _render(child, inner, own, pre or tag == "pre", depth + 1)
            inner.flush()
            lines = inner.lines
            if tag == "pre":
                while lines and not lines[0].strip():
                    lines.pop(0)
                while lines and not lines[-1].strip():
                    lines.pop()
            if tag in ("blockquote", "dd"):
                lines = ["    " + s if s else s for s in lines]
            margin = 0 if tag in ("ul", "ol", "menu", "dir") and node.tag == "li" else int(tag in _PARAGRAPHS)
            out.block(lines, max(margin, inner.lead), max(margin, inner.gap))  # margins at a block's edges are its own too
        elif tag in _TABLE:  # outside of a table: each on a line
            out.flush()
            _render(child, out, own, pre, depth + 1)
            out.flush()
        else:
            _render(child, out, own, pre, depth + 1)


def _holds_cells(node: Node) -> bool:
    """Whether rows or cells of the table around stand below an element that is no part of one, such as a form."""
    return any(not isinstance(c, str) and (c.tag in ("tr", "td", "th") or c.tag not in ("table", "caption") and _holds_cells(c)) for c in node.children)


def _rows(node: Node, visible: bool, pre: bool, depth: int, top: _Lines) -> list[list[tuple[Node, bool]]]:
    """The rows of a table in the order head, bodies, foot: (cell, visible). Captions and all that stands in no cell, at whatever level, go to ``top``."""
    parts: dict[str, list] = {"thead": [], "": [], "tfoot": []}

    def walk(n: Node, seen: bool, part: str, row: list | None) -> None:
        for child in n.children:
            if isinstance(child, str):
                if seen and child.strip():
                    top.text(child, False)
                continue
            shown, own, _ = _shown(child, seen)
            if not shown:
                continue
            if child.tag in ("td", "th"):
                top.flush()
                if row is None:
                    parts[part].append([(child, own)])
                else:
                    row.append((child, own))
            elif child.tag in ("tr", "thead", "tbody", "tfoot", "colgroup") or child.tag not in ("table", "caption") and _holds_cells(child):
                top.flush()
                cells = row
                if child.tag == "tr":
                    cells = []
                    parts[part].append(cells)
                walk(child, own, child.tag if child.tag in ("thead", "tfoot") else part, cells)
                top.flush()
            else:
                holder = Node("div", {})
                holder.children = [child]
                _render(holder, top, seen, pre, depth + 1)
                top.flush()

    walk(node, visible, "", None)
    top.flush()
    return parts["thead"] + parts[""] + parts["tfoot"]


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isdigit() and len(value) < 6 else 1


def _table(node: Node, visible: bool, pre: bool, depth: int) -> list[str]:
    """Captions and text that stands in no cell first, then the rows; columns are as wide as their widest cell and two blanks apart.

    Lines of more than CELL characters count for no column's width, and a cell whose column begins more than MARGIN
    characters into the line follows the one before it: so a line has at most MARGIN + 2 blanks that aren't of the page.
    """
    top = _Lines()
    grid, busy = [], {}  # busy: column -> rows it is still taken
    for cells in _rows(node, visible, pre, depth, top):
        row, column = [], 0
        for cell, own in cells:
            while busy.get(column, 0) > 0:
                column += 1
            inner = _Lines()
            _render(cell, inner, own, pre, depth + 1)
            inner.flush()
            span = _span(cell, "colspan")
            row.append((column, span, inner.lines))
            for c in range(column, column + span):
                busy[c] = max(busy.get(c, 0), _span(cell, "rowspan"))
            column += span
        busy = {c: n - 1 for c, n in busy.items() if n > 1}
        grid.append(row)
    n = max([c + s for row in grid for c, s, _ in row], default=0)
    width = [0] * n
    for wide in (False, True):  # cells of one column set the widths, wider ones then stretch their last column
        for row in grid:
            for c, s, lines in row:
                if (s > 1) == wide:
                    need = max((len(x) for x in lines if len(x) <= CELL), default=0) - sum(width[c : c + s]) - 2 * (s - 1)
                    width[c + s - 1] += max(0, need)
    begins = [0, *itertools.accumulate(w + 2 for w in width)]
    out = top.lines
    for row in grid:
        for i in range(max([len(lines) for _, _, lines in row], default=0)):
            line, wide = [], 0
            for c, _, lines in row:
                if i < len(lines) and lines[i]:
                    gap = max(begins[c] - wide if begins[c] <= MARGIN else 0, 2 if wide else 0)
                    line += [" " * gap, lines[i]]
                    wide += gap + len(lines[i])
            out.append("".join(line).rstrip())
    return out


def render(page: str) -> str:
    """All visible text of a page."""
    out = _Lines()
    _render(parse(page), out, True, False, 0)
    out.flush()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) of each page, in one pass without a shuffle. Null and empty pages give the empty text; each row gives a row.

    A page is rendered whole, whatever its length. Elements nested more than 200 deep are taken as children of the one at that depth.
    """
    base = pages.select(pages[id_col].alias("page_id"), pages[html_col].cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text = pa.array([render(x) if x else "" for x in part.column(1).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), text], ["page_id", "text"])

    return base.mapInArrow(run, f"page_id {base.schema['page_id'].dataType.simpleString()}, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages; a null page has an empty one."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
