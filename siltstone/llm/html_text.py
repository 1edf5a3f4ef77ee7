"""HTML extraction by layout-aware rendering.

A small tree builder reads tags leniently: void elements, raw text (script, style, title, textarea), implied
end tags (p, li, dt, dd, option, tr, td, th, thead, tbody, head), stray end tags and missing ones. A quote
opens an attribute's value only after ``=``, and only if it is closed somewhere, so stray quotes lose no text.

Elements that a browser does not show are left out: head, script, style, template, noscript, the ``hidden``
attribute, what a closed ``details`` or ``dialog`` holds, and what inline styles or the page's ``style``
elements set to ``display:none`` or ``visibility:hidden`` (a visible child of a hidden parent is shown). Of
style sheets, rules with plain selectors count (tag, class, id and their compounds); combinators,
pseudo-classes and at-rules such as ``@media`` do not.

All other text is rendered: runs of white space count as one space except in ``pre`` and ``textarea``; blocks
start on lines of their own, with a blank line around paragraphs, headings, lists and tables; list items
carry a dash or their number (``start`` and ``value`` count) and are indented by depth; table cells are padded
so that columns align, cells that span columns or rows included.

The parser keeps a stack, not a recursion, so deeply nested pages are no danger.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*'|[^\s>]*+))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SIMPLE = re.compile(r"(?:[a-z][a-z0-9]*|\*)?(?:[.#][a-z0-9_-]+)*", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_STYLED = re.compile("hidden|style", re.I)
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title datalist iframe noembed noframes canvas audio video rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCK = SPACED | frozenset("html body div section article nav header footer main aside li dt dd form fieldset legend address hr figcaption details summary option select tr caption thead tbody tfoot center".split())
#: What may stand in <head>: any other start tag, or text that is not blank, ends an open head.
HEAD = frozenset("base link meta noframes noscript script style template title".split())
#: A start tag in the key's set ends an open element of the key, searched no higher than its scope.
ENDED_BY = {
    "p": BLOCK - {"tr", "caption", "thead", "tbody", "tfoot", "option", "html", "body"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "thead", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "thead", "tfoot"},
    "thead": {"tbody", "tfoot"},
    "tbody": {"tbody", "tfoot"},
    "head": {"body"},
}
SCOPE = {"p": {"table", "td", "th", "button", "body"}, "li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "head": set()} | {k: {"table"} for k in ("tr", "td", "th", "thead", "tbody")}
#: What a start tag can end, in the order in which open elements are looked at.
_ENDS = {tag: [k for k, by in ENDED_BY.items() if tag in by] for tag in set().union(*ENDED_BY.values())}


class Node:
    __slots__ = ("tag", "attrs", "kids", "mark")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.mark = tag, attrs, [], "- "


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):  # of repeated names, the first counts
        quoted = len(value) > 1 and value[0] in "\"'" and value[-1] == value[0]
        out.setdefault(name.lower(), html.unescape(value[1:-1] if quoted else value))
    return out


def parse(text: str) -> Node:
    root = Node("#root")
    stack, open_tags = [root], {}
    at = 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop().tag] -= 1

    def find(tag: str, scope) -> int:
        if not open_tags.get(tag):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag == tag:
                return i
            if stack[i].tag in scope:
                return 0
        return 0

    def leave_head() -> None:
        while stack[-1].tag == "head":
            close(len(stack) - 1)

    def add(piece: str) -> None:
        piece = html.unescape(piece) if "&" in piece else piece
        if stack[-1].tag == "head" and piece.strip(" \t\n\f\r"):
            leave_head()
        stack[-1].kids.append(piece)

    while True:
        m = _TOKEN.search(text, at)
        if m is None:
            if at < len(text):
                add(text[at:])
            return root
        if m.start() > at:
            add(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = find(tag, {"table"} if tag in ("p", "li", "td", "th", "tr") and tag != "table" else ())
            if depth:
                close(depth)
            elif tag == "br":
                leave_head()
                stack[-1].kids.append(Node("br"))
            continue
        if tag not in HEAD:
            leave_head()
        for ended in _ENDS.get(tag, ()):
            depth = find(ended, SCOPE[ended])
            if depth:
                close(depth)
        node = Node(tag, m[3])
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(text, at)
            body = text[at : end.start() if end else len(text)]
            node.kids.append(html.unescape(body) if tag in ("title", "textarea") else body)
            at = end.end() if end else len(text)
        elif tag not in VOID and not m[3].endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1


def declarations(text: str) -> dict[str, tuple[bool, str]]:
    """The ``display`` and ``visibility`` that a declaration block sets, as (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and value and name in ("display", "visibility"):
            important = value.endswith("important") and "!" in value
            own = (important, value.partition("!")[0].strip())
            if name not in out or important or not out[name][0]:
                out[name] = own
    return out


def _top_level(css: str) -> str:
    """A style sheet without comments and at-rules."""
    css = _COMMENT.sub(" ", css)
    out, at = [], 0
    while (sign := css.find("@", at)) >= 0:
        out.append(css[at:sign])
        brace, end = css.find("{", sign), css.find(";", sign)
        if end >= 0 and (brace < 0 or end < brace):
            at = end + 1
            continue
        depth, at = 0, brace if brace >= 0 else len(css)
        while at < len(css):
            depth += (css[at] == "{") - (css[at] == "}")
            at += 1
            if depth == 0:
                break
    return "".join([*out, css[at:]])


class Sheet:
    """Rules on display and visibility, found by the last id, class or tag of their selector."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        stack, sheets = [root], []
        while stack:
            node = stack.pop()
            if node.tag == "style":
                sheets.append("".join(k for k in node.kids if isinstance(k, str)))
            stack.extend(k for k in reversed(node.kids) if not isinstance(k, str))
        for n, (selectors, body) in enumerate(_RULE.findall(_top_level("\n".join(sheets)))):
            for name, (important, value) in declarations(body).items():
                for selector in selectors.split(","):
                    plain = selector.strip()
                    if not plain or not _SIMPLE.fullmatch(plain):
                        continue
                    parts = re.findall(r"[.#]?[^.#]+", plain)
                    weight = (important, sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), sum(p[0] not in ".#*" for p in parts), n)
                    parts = [p if p[0] in ".#" else p.lower() for p in parts]
                    self.rules.setdefault(parts[-1], []).append((name, weight, value, frozenset(parts) - {"*"}))

    def style(self, node: Node, attrs: dict[str, str]) -> dict[str, str]:
        """What rules and the inline style make of an element."""
        own = {node.tag, *(f".{c}" for c in attrs.get("class", "").split()), *([f"#{attrs['id']}"] if attrs.get("id") else [])}
        best: dict[str, tuple] = {}
        for key in (*own, "*") if self.rules else ():
            for name, weight, value, parts in self.rules.get(key, ()):
                if parts <= own and (name not in best or weight > best[name][0]):
                    best[name] = (weight, value)
        found = {name: value for name, (_, value) in best.items()}
        for name, (important, value) in declarations(attrs.get("style", "")).items():
            if important or name not in best or not best[name][0][0]:
                found[name] = value
        return found


PRE, UNSHOWN = 1, 2


def state_of(node: Node, sheet: Sheet, state: int) -> int | None:
    """The element's bits of PRE and UNSHOWN under its parent's state; None if it and all it holds are left out."""
    if node.tag in UNSEEN:
        return None
    if node.tag in ("pre", "textarea", "xmp"):
        state |= PRE
    if not sheet.rules and node.tag != "dialog" and not _STYLED.search(node.attrs):
        return state
    attrs = attributes(node.attrs) if node.attrs else {}
    style = sheet.style(node, attrs)
    display = style.get("display")
    if display == "none" or "hidden" in attrs and display is None or node.tag == "dialog" and "open" not in attrs and display is None:
        return None
    if node.tag == "input" and attrs.get("type", "").lower() == "hidden":
        return None
    visibility = style.get("visibility")
    if visibility in ("hidden", "collapse"):
        return state | UNSHOWN
    return state & ~UNSHOWN if visibility == "visible" else state


class Lines:
    """Text in the making: lines, the current line, and the blank line that the next text needs."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.blank = False
        self.pad = ""
        self.mark = ""

    def put(self, text: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(text.split("\n")):
                if i:
                    self.end(keep=True)
                if part:
                    self._start()
                    self.line.append(part)
            return
        text = _SPACE.sub(" ", text)
        if text.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            text = text[1:]
        if text:
            self._start()
            self.line.append(text)

    def _start(self) -> None:
        if not self.line:
            if self.blank and self.done and self.done[-1]:
                self.done.append("")
            self.blank = False
            self.line.append(self.pad + self.mark)
            self.pad += " " * len(self.mark)
            self.mark = ""

    def end(self, keep: bool = False) -> None:
        if self.line:
            self.done.append("".join(self.line).rstrip())
            self.line = []
        elif keep:
            self.done.append("")

    def text(self) -> str:
        self.end()
        return "\n".join(self.done).strip("\n")


def render(root: Node) -> str:
    """The visible text of a tree."""
    sheet = Sheet(root)
    out = Lines()
    frames: list[tuple] = []  # lines of tables around, with their cells
    stack: list[tuple] = [("open", root, 0)]
    while stack:
        what, node, state = stack.pop()
        if what == "text":
            out.put(node, bool(state & PRE))
        elif what == "open":
            if node.tag == "br":
                out.end(keep=True)
            elif node.tag == "hr":
                out.end()
                out.blank = True
            elif node.tag in ("td", "th") and frames and frames[-1][1] is not None:
                stack.append(("cell", (node, out), state))
                out = Lines()
                stack.extend(_kids(node, sheet, state))
            elif node.tag == "table":
                out.end()
                out.blank = True
                frames.append((out, []))
                stack.append(("table", node, state))
                stack.extend(_kids(node, sheet, state))
            else:
                saved = None
                if node.tag in BLOCK:
                    out.end()
                    out.blank = out.blank or node.tag in SPACED and not (node.tag in ("ul", "ol") and out.pad)
                if node.tag in ("ul", "ol", "blockquote", "dd"):
                    saved = (out, out.pad, out.mark)
                    out.pad += "  " if node.tag in ("blockquote", "dd") or out.pad else ""
                elif node.tag == "li":
                    saved = (out, out.pad, "")
                    out.mark = node.mark
                elif node.tag == "tr" and frames and frames[-1][1] is not None:
                    frames[-1][1].append([])
                stack.append(("close", (node, saved), state))
                stack.extend(_kids(node, sheet, state))
        elif what == "cell":
            cell, before = node
            if not frames[-1][1]:
                frames[-1][1].append([])
            a = attributes(cell.attrs) if cell.attrs else {}
            frames[-1][1][-1].append((out.text(), _count(a.get("colspan"), 1, 1000), _count(a.get("rowspan"), 0, 65534)))
            out = before
        elif what == "table":
            before, rows = frames.pop()
            out.end()
            for line in _grid(rows):
                out._start()
                out.line.append(line)
                out.end()
            out.blank = True
        else:
            closed, saved = node
            if closed.tag in BLOCK:
                out.end()
                out.blank = out.blank or closed.tag in SPACED and not (closed.tag in ("ul", "ol") and saved and saved[1])
            if saved:
                saved[0].pad, saved[0].mark = saved[1], saved[2]
    return out.text()


def _number(text: str | None) -> int | None:
    found = _NUMBER.match(text or "")
    return int(found[1]) if found else None


def _count(text: str | None, least: int, most: int) -> int:
    """A span; 1 where none is given or it is no number."""
    n = _number(text)
    return 1 if n is None or n < least else min(n, most)


def _kids(node: Node, sheet: Sheet, state: int) -> list[tuple]:
    """What stands in a node, last first. Items of an ordered list get their numbers; a closed ``details`` shows its summary only."""
    out, n = [], 1
    attrs = attributes(node.attrs) if node.tag in ("ol", "details") and node.attrs else {}
    closed = node.tag == "details" and "open" not in attrs
    if node.tag == "ol":
        start = _number(attrs.get("start"))
        n = 1 if start is None else start
    for kid in node.kids:
        if isinstance(kid, str):
            if not state & UNSHOWN and not closed and (node.tag not in ("table", "tr", "tbody", "thead", "tfoot", "ul", "ol") or kid.strip()):
                out.append(("text", kid, state))
            continue
        if closed and kid.tag != "summary":
            continue
        own = state_of(kid, sheet, state)
        if own is None:
            continue
        if kid.tag == "summary":
            closed = closed and not out  # the first one only
            if node.tag == "details" and "open" not in attrs:
                out.append(("open", kid, own))
                break
        if kid.tag == "li" and node.tag == "ol":
            value = _number(attributes(kid.attrs).get("value")) if kid.attrs else None
            n = n if value is None else value
            kid.mark = f"{n}. "
            n += 1
        out.append(("open", kid, own))
    return out[::-1]


def _grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of a table with its columns padded to one width; a cell of several lines takes as many. Cells are (text, columns, rows); 0 rows: all below."""
    placed: list[list[tuple[int, list[str], int]]] = []
    held: dict[int, int] = {}  # rows that a cell above still takes in a column
    for r, row in enumerate(rows):
        col, cells = 0, []
        taken, held = held, {c: n - 1 for c, n in held.items() if n > 1}
        for text, span, down in row:
            while col in taken:
                col += 1
            cells.append((col, text.split("\n"), span))
            below = (len(rows) - r if down == 0 else min(down, len(rows) - r)) - 1
            if below:
                held |= {c: below for c in range(col, col + span)}
            col += span
        placed.append(cells)
    widths: dict[int, int] = {}
    for cells in placed:
        for col, lines, span in cells:
            if span == 1:
                widths[col] = max(widths.get(col, 0), *map(len, lines))
    out = []
    for cells in placed:
        full, at = [], 0
        for col, lines, span in cells:
            full += [([""], widths.get(c, 0)) for c in range(at, col)]
            full.append((lines, sum(widths.get(c, 0) for c in range(col, col + span)) + 3 * (span - 1)))
            at = col + span
        for i in range(max((len(lines) for lines, _ in full), default=0)):
            out.append(" | ".join((lines[i] if i < len(lines) else "").ljust(w) for lines, w in full).rstrip())
    return out


def extract(text: str | None) -> str:
    return render(parse(text)) if text else ""


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [extract(h.as_py()) for h in part.column(2)]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(lines, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_lines"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_lines; one row per input row. Null and empty pages give empty texts."""
    C.ship(pages.sparkSession)
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return source.mapInArrow(_run, "page_id long, url string, text string, n_chars long, n_lines long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(C.table(spark, sf_dir, "pages"))
