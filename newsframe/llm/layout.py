"""Layout-aware rendering of pages to text (operator 4).

A small tree builder closes elements that HTML lets authors leave open
(paragraphs, list items, table rows and cells, the head before text or a tag
of the body, ...) and ignores stray end
tags. Rendering walks the tree once and emits all visible text: blocks on
lines of their own with blank lines around paragraphs, headings, lists and
tables; list items with markers and hanging indents; table cells in aligned
columns; preformatted text as it is; the labels and formulas of svg and math
without their titles, definitions and annotations. Scripts, styles, the head, templates,
hidden elements (attribute or style), closed details and form values are not
visible.

Cells over ``ALIGN_MAX`` characters do not widen their column, so one long
cell cannot multiply a long table's size. Work and memory are linear in the
page.

Defined cases: null and empty pages give an empty text; unclosed comments
and tags run to the end; rows that repeat an id are rendered one by one;
null ids are kept; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks

ALIGN_MAX = 60      # widest cell that its column is aligned to
COLUMN_GAP = "  "
MAX_SPAN = 100      # columns or rows that one cell spans, at most

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas "
                   "datalist input meta link".split())
#: Not shown inside svg and math, whose other text is.
FOREIGN_HIDDEN = frozenset("title desc defs metadata annotation annotation-xml".split())
#: Blank lines around a block.
GAP = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset".split(), 1) | dict.fromkeys(
    "address article aside body center details dd div dt figcaption footer form header html legend li main nav "
    "option section summary caption tr".split(), 0)
#: Start tags that close an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details div dl fieldset figure footer form h1 h2 h3 h4 h5 "
                   "h6 header hr main nav ol p pre section table ul".split())
#: Start tag -> (open elements it closes, elements beyond which it looks no further).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, set()),
}
P_SCOPE = {"table", "td", "th", "caption", "button", "object"}
END_SCOPE = {"td": {"table"}, "th": {"table"}, "tr": {"table"}, "li": {"ul", "ol"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)"
                  r"((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_UNQUOTED = re.compile(r"=\s*[^\s\"'>]+/\Z")
_BLANK = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def _attrs(text: str) -> dict[str, str]:
    if not text.strip("/ \n\t"):
        return {}
    return {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTR.findall(text)}


def tree(html: str) -> Node:
    """The element tree with implied end tags."""
    root = Node("#root", {})
    stack, opened = [root], Counter()

    def close(depth: int) -> None:
        for n in stack[depth:]:
            opened[n.tag] -= 1
        del stack[depth:]

    def close_any(tags: set, scope: set) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return close(i)
            if stack[i].tag in scope:
                return

    def put(text: str) -> None:
        text = unescape(text)
        if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
            close(len(stack) - 1)
        stack[-1].children.append(text)

    at = 0
    while (m := _TAG.search(html, at)):
        if m.start() > at:
            put(html[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                close_any({tag}, END_SCOPE.get(tag, set()))
            continue
        if tag in ENDS_P:
            close_any({"p"}, P_SCOPE)
        if tag in IMPLIED:
            close_any(*IMPLIED[tag])
        elif opened["head"] and tag not in HIDDEN and tag not in ("base", "meta", "link", "head"):
            close_any({"head"}, set())
        node = Node(tag, _attrs(m[3]))
        stack[-1].children.append(node)
        if (opened["svg"] or opened["math"] or tag in ("svg", "math")) and not opened["foreignobject"]:
            if tag in FOREIGN_HIDDEN:
                node.attrs["hidden"] = ""
            if m[3].endswith("/") and not _UNQUOTED.search(m[3]):
                continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            body = html[at:end.start() if end else len(html)]
            node.children.append(unescape(body) if tag in ("textarea", "title") else body)
            at = end.end() if end else len(html)
        elif tag not in VOID:
            stack.append(node)
            opened[tag] += 1
    if at < len(html):
        put(html[at:])
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or "hidden" in a or ("style" in a and _UNSEEN.search(a["style"])))


BR = object()


def flow(items: list) -> list[str]:
    """Lines of a sequence of inline texts, line breaks (BR), block bounds
    (blank lines wanted, as int) and ready lines (list)."""
    lines: list[str] = []
    run: list[str] = []
    gap = 0

    def flush(forced: bool = False) -> None:
        nonlocal gap
        text = _BLANK.sub(" ", "".join(run)).strip(" ")
        run.clear()
        if text or forced:
            if gap and lines:
                lines.append("")
            gap = 0
            lines.append(text)

    for x in items:
        if isinstance(x, str):
            run.append(x)
        elif x is BR:
            flush(True)
        else:
            flush()
            if isinstance(x, int):
                gap = max(gap, x)
            elif x:
                if gap and lines:
                    lines.append("")
                gap = 0
                lines += x
    flush()
    while lines and not lines[-1]:
        lines.pop()
    return lines


def _span(cell: Node, name: str) -> int:
    v = cell.attrs.get(name, "1")
    return min(max(int(v), 1), MAX_SPAN) if v.isascii() and v.isdigit() and len(v) < 9 else 1


def table_lines(rows: list[list[tuple[Node, list[str]]]]) -> list[str]:
    """Cells in aligned columns; spanning cells take up their columns and rows."""
    grid, widths, below = [], {}, {}
    for row in rows:
        out, col, spans = [], 0, {}
        for cell, lines in row:
            while below.get(col, 0):
                col += 1
            n, down = _span(cell, "colspan"), _span(cell, "rowspan")
            out.append((col, n, lines))
            for c in range(col, col + n):
                spans[c] = down - 1
            if n == 1:
                w = max((len(x) for x in lines if len(x) <= ALIGN_MAX), default=0)
                widths[col] = max(widths.get(col, 0), w)
            col += n
        below = {c: d - 1 for c, d in below.items() if d > 1 and c not in spans} | {c: d for c, d in spans.items() if d}
        grid.append(out)
    used = sorted(widths)
    left = {c: sum(widths[x] + len(COLUMN_GAP) for x in used[:i]) for i, c in enumerate(used)}
    result = []
    for out in grid:
        for i in range(max((len(x[2]) for x in out), default=0)):
            line = ""
            for col, _, lines in out:
                if i < len(lines) and lines[i]:
                    at = left.get(col, len(line) + len(COLUMN_GAP) if line else 0)
                    line = line.ljust(at) if len(line) + len(COLUMN_GAP) <= at or not line else line + COLUMN_GAP
                    line += lines[i]
            result.append(line.rstrip())
    return [x for x in result if x]


def render(html: str | None) -> str:
    """The page's visible text."""
    if not html:
        return ""
    root = tree(html)
    # frames: node, child iterator, items of the enclosing flow, own items,
    # preformatted, data of lists and tables
    out: list = []
    stack = [(root, iter(root.children), out, out, False, None)]
    while stack:
        node, children, outer, items, pre, data = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            _leave(node, outer, items, data, stack)
        elif isinstance(child, str):
            if pre:
                for i, part in enumerate(child.replace("\r\n", "\n").split("\n")):
                    if i:
                        items.append(BR)
                    items.append(part.replace(" ", "\xa0").replace("\t", "\xa0" * 4))
            elif node.tag not in ("table", "thead", "tbody", "tfoot", "tr", "ul", "ol") or child.strip():
                items.append(child)
        elif visible(child):
            tag = child.tag
            if tag == "br":
                items.append(BR)
                continue
            if tag == "details" and "open" not in child.attrs:
                child.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"]
            if tag in ("li", "td", "th", "table", "blockquote", "dd", "pre", "caption"):
                own: list = []
            else:
                own = items
                if tag in GAP:
                    items.append(_gap(tag, node))
            nested = {"rows": [], "caption": []} if tag == "table" else {"n": child.attrs.get("start", "1")} \
                if tag in ("ol", "ul") else None
            stack.append((child, iter(child.children), items, own, pre or tag in ("pre", "textarea"), nested))
            if tag == "tr" and (t := _enclosing(stack, "table")):
                t["rows"].append([])
    return "\n".join(x.replace("\xa0", " ").rstrip() for x in flow(out))


def _gap(tag: str, parent: Node) -> int:
    """Blank lines around a block; a list inside an item has none."""
    return 0 if parent.tag == "li" and tag in ("ul", "ol") else GAP[tag]


def _enclosing(stack: list, *tags: str) -> dict | None:
    for node, *_, data in reversed(stack):
        if data is not None and node.tag in tags:
            return data
        if node.tag in ("td", "th"):
            return None
    return None


def _leave(node: Node, outer: list, items: list, data: dict | None, stack: list) -> None:
    tag = node.tag
    if items is outer:
        if tag in GAP:
            outer.append(_gap(tag, stack[-1][0]))
        elif tag in ("button", "label", "select", "text"):
            outer.append(" ")
        return
    lines = flow(items)
    if tag in ("td", "th"):
        table = _enclosing(stack, "table")
        if table is not None:
            if not table["rows"]:
                table["rows"].append([])
            table["rows"][-1].append((node, lines))
            return
    elif tag == "caption" and (table := _enclosing(stack, "table")) is not None:
        table["caption"] += lines
        return
    elif tag == "table":
        lines = lines + data["caption"] + table_lines(data["rows"])
    elif tag == "li":
        home, data = next(((f[0].tag, f[-1]) for f in reversed(stack) if f[0].tag in ("ol", "ul")), ("", None))
        mark = "- "
        if home == "ol":
            n = int(data["n"]) if re.fullmatch(r"-?\d{1,8}", data["n"]) else 1
            mark, data["n"] = f"{n}. ", str(n + 1)
        lines = [(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines or [""])]
    elif tag in ("blockquote", "dd"):
        lines = ["  " + x if x else x for x in lines]
    outer += [GAP.get(tag, 0), lines, GAP.get(tag, 0)]


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines, n_chars) per row of ``pages``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "html"):
            out = [render(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), pa.array(out, pa.string()),
                 pa.array([t.count("\n") + 1 if t else 0 for t in out], pa.int64()), pa.array([*map(len, out)], pa.int64())],
                names=["page_id", "text", "n_lines", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, text string, n_lines long, n_chars long")
