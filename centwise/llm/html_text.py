"""HTML extraction with layout-aware rendering (operator 2).

A tree builder reads the markup the way browsers forgive it (implied end tags, void elements, raw
text, unclosed tags); the renderer walks the tree without recursion and writes every visible text:
block elements on lines of their own with their margins as blank lines, list items with bullets or
numbers and a hanging indent, preformatted text as it is, and tables as columns of aligned cells.
Cell lines longer than ``CELL`` characters are wrapped at blanks, so padding stays small; no text
is cut.

Formulas (math) and the text elements of inline drawings (svg) are inline text.

Invisible: comments, head, script, style, template, noscript, iframes and media fallback, annotations
of formulas, titles, descriptions and definitions of drawings, hidden inputs, elements with the ``hidden`` attribute or an inline ``display:none`` / ``visibility:hidden``,
and the content of a closed ``details`` below its summary.

Defined cases: null and empty html give the empty text; markup that ends anywhere is closed there;
any nesting depth works, in time that grows with the page: items, definitions and quotes nested deeper
than ``DEEPEST`` are lines without mark or indent; repeated rows are rendered alike; empty tables give empty results; extra
columns pass through, ``rendered`` wins over a clashing one.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from centwise.llm.common import pieces, read

CELL = 80
# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript title textarea".split())
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section summary table ul caption listing plaintext xmp textarea""".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir hr listing".split())
UNSEEN = frozenset("head script style template noscript iframe object audio video canvas title noembed noframes datalist rp".split())
CLOSES_P = BLOCKS - frozenset("body html dd dt li option optgroup caption legend textarea".split()) | {"li", "dd", "dt"}
HEAD_ONLY = frozenset("base link meta script style template title noscript".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
GROUPS = frozenset(("tbody", "thead", "tfoot"))
SCOPES = frozenset("table td th caption html template button object".split())

FOREIGN = frozenset(("svg", "math"))
FOREIGN_UNSEEN = {"math": frozenset("annotation annotation-xml mphantom".split()),
                  "svg": frozenset("defs symbol clippath mask pattern marker metadata desc title".split())}
SVG_TEXT = frozenset("text foreignobject".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
# HTML elements that end svg and math around them.
ENDS_FOREIGN = HEADINGS | frozenset("""b big blockquote body br center code dd div dl dt em embed head hr i img li listing menu meta nobr ol p
    pre ruby s small span strong strike sub sup table tt u ul var""".split())

# A quote delimits a value directly after "=" only (if it is closed); anywhere else it is a character.
_NAME, _IS = r"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*", r"[ \t\n\r\f]*=[ \t\n\r\f]*"
_TOKEN = re.compile(r"<!--(?:-?>|.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^ \t\n\r\f/>]*)((?:[ \t\n\r\f/]+|"
                    rf"{_NAME}(?:{_IS}(?:\"[^\"]*\"|'[^']*'|[^ \t\n\r\f>]+)?)?)*+)(?:>|\Z)", re.S)
_ATTR = re.compile(rf"({_NAME})(?:{_IS}(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\r\f>]+))?)?")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(text):
        out.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return out


INLINE_BOUNDS = BLOCKS | SCOPES
# Items, definitions and quotes nested deeper than so many boxes are lines without mark or indent.
DEEPEST = 40
ITEMS = frozenset(("li", "dd", "blockquote"))


class Builder:
    def __init__(self) -> None:
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)    # of the open elements, by tag

    def _last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _up_to(self, tags: frozenset[str], bounds: frozenset[str]) -> int | None:
        """The innermost open element of ``tags`` unless one of ``bounds`` is further in."""
        at = self._last(tags)
        return at if at and at >= self._last(bounds) else None

    def _cut(self, at: int) -> None:
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def _close(self, tags: Iterable[str], bounds: frozenset[str] = SCOPES) -> None:
        if (at := self._up_to(frozenset(tags), bounds)) is not None:
            self._cut(at)

    def text(self, text: str) -> None:
        if text:
            if self.open[-1].tag == "head" and text.strip(" \t\n\r\f"):
                self._cut(-1)
            self.open[-1].kids.append(text)

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> None:
        if tag in ENDS_FOREIGN:
            while (at := self._up_to(FOREIGN, HTML_INSIDE)) is not None:
                self._cut(at)
        if tag in ("html", "body"):
            self._close(("head",), frozenset())
            if (at := self._up_to(frozenset((tag,)), frozenset())) is not None:
                self.open[at].attrs.update({k: v for k, v in attrs.items() if k not in self.open[at].attrs})
                return
        elif self.open[-1].tag == "head" and tag not in HEAD_ONLY:
            self._cut(-1)
        if tag in CLOSES_P:
            self._close(("p",), SCOPES)
        if tag == "li":
            self._close(("li",), SCOPES | LISTS)
        elif tag in ("dt", "dd"):
            self._close(("dt", "dd"), SCOPES | {"dl"})
        elif tag in ("option", "optgroup"):
            self._close(("option",), SCOPES | {"select", "datalist"})
            if tag == "optgroup":
                self._close(("optgroup",), SCOPES | {"select", "datalist"})
        elif tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._cut(-1)
        elif tag in GROUPS or tag in ("caption", "colgroup", "tr") or tag in CELLS:
            if (table := self._up_to(frozenset(("table",)), frozenset())) is None:
                return                                     # table parts outside a table: no element
            keep = table + 1
            if tag in CELLS or tag == "tr":
                while keep < len(self.open) and self.open[keep].tag in GROUPS:
                    keep += 1
            if tag in CELLS and keep < len(self.open) and self.open[keep].tag == "tr":
                keep += 1
            self._cut(keep)
            if tag in CELLS and self.open[-1].tag != "tr":
                self._push("tr", {})
        self._push(tag, attrs)
        if closed or tag in VOID:
            self._cut(-1)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        self.places[tag].append(len(self.open))
        self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and self._up_to(frozenset(("p",)), SCOPES) is None:
            self.start("p", {})
            self._cut(-1)
        elif tag in HEADINGS:
            self._close(HEADINGS)
        elif tag in FOREIGN:
            self._close((tag,), frozenset())
        elif tag in BLOCKS or tag in CELLS or tag in GROUPS or tag in ("tr", "head", "template", "button", "select", "object"):
            inner = tag in CELLS or tag in GROUPS or tag == "tr"
            self._close((tag,), frozenset(("table",)) if inner else frozenset() if tag == "table" else SCOPES - {tag})
        else:                                              # inline: never closes a block
            self._close((tag,), INLINE_BOUNDS)


def parse(markup: str) -> Node:
    """The tree of a page."""
    tree, at = Builder(), 0
    while at < len(markup):
        m = _TOKEN.search(markup, at)
        if m is None:
            tree.text(html.unescape(markup[at:]))
            break
        tree.text(html.unescape(markup[at:m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        foreign = tag in FOREIGN or tree.places["svg"] or tree.places["math"]    # "/>" closes there
        tree.start(tag, attributes(m[3]), bool(m[3].endswith("/") and foreign))
        if tag in RAW and tree.open[-1].tag == tag:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(markup, at)
            raw = markup[at:stop.start() if stop else len(markup)]
            tree.open[-1].kids.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            tree._cut(-1)
            at = stop.end() if stop else len(markup)
    return tree.root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    style = node.attrs.get("style")
    return not style or not re.search(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", style, re.I)


def shown(node: Node) -> list[Node | str]:
    """What a math or svg element shows: the formula without annotations; the drawing's text
    elements, with blanks between."""
    unseen, out, work = FOREIGN_UNSEEN[node.tag], [], [(node, False)]
    while work:
        at, inside = work.pop()
        at.kids = [k for k in at.kids if isinstance(k, str) or k.tag not in unseen]
        if at.tag in SVG_TEXT and not inside:
            out += [" ", at, " "]
            inside = True
        if visible(at):
            work.extend((k, inside) for k in reversed(at.kids) if isinstance(k, Node))
    return out if node.tag == "svg" else node.kids


class Box:
    """Lines of a block; margins are blank lines between, not around, its content."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.margin = 0
        self.space = False

    def write(self, text: str) -> None:
        if not text:
            return
        flat = _SPACE.sub(" ", text)
        if flat == " ":
            self.space = True
            return
        if (self.space or flat[0] == " ") and self.now:
            self.now.append(" ")
        self.now.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def write_as_is(self, text: str) -> None:
        first, *rest = text.expandtabs(8).replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.now.append(first)
        for line in rest:
            self.line(True)
            self.now.append(line)

    def line(self, keep_blank: bool = False) -> None:
        """End the current line."""
        text = "".join(self.now).rstrip(" ")
        self.now, self.space = [], False
        if text or keep_blank:
            self._put([text])

    def _put(self, lines: list[str]) -> None:
        if self.lines and self.margin:
            self.lines.append("")
        self.margin = 0
        self.lines += lines

    def block(self, spaced: bool) -> None:
        self.line()
        self.margin = max(self.margin, int(spaced))

    def put(self, lines: list[str]) -> None:
        self.line()
        if lines:
            self._put(lines)

    def done(self) -> list[str]:
        self.line()
        return self.lines


def wrap(lines: list[str], width: int = CELL) -> list[str]:
    out = []
    for line in lines:
        while len(line) > width and (cut := line.rfind(" ", 1, width + 1)) > 0 or len(line) > width and (cut := line.find(" ", width)) > 0:
            out.append(line[:cut].rstrip())
            line = line[cut + 1:].lstrip()
        out.append(line)
    return out


def _span(attrs: dict[str, str], name: str, most: int) -> int:
    m = re.match(r"\s*(\d{1,9})", attrs.get(name, ""))
    return min(most, max(1, int(m[1]))) if m else 1


def table_lines(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, colspan, rowspan) as aligned columns."""
    placed: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}                             # column -> rows it is still taken for
    width: dict[int, int] = {}
    for row in rows:
        line, col, held = [], 0, {}
        for lines, across, down in row:
            while taken.get(col, 0) > 0:
                col += 1
            lines = wrap(lines)
            line.append((col, across, lines))
            if across == 1:
                width[col] = max(width.get(col, 0), min(CELL, max(map(len, lines), default=0)))
            if down > 1:
                held.update(dict.fromkeys(range(col, col + across), down))
            col += across
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        taken.update({c: n - 1 for c, n in held.items()})
        placed.append(line)
    out = []
    for line in placed:
        starts, at, last = {}, 0, 0
        for col, _, _ in line:
            at += sum(width.get(c, 0) + 2 for c in range(last, col) if c in width)
            starts[col], last = at, col
        for k in range(max((len(lines) for *_, lines in line), default=0)):
            text = ""
            for col, _, lines in line:
                if k < len(lines) and lines[k]:
                    text = text.ljust(starts[col]) + (lines[k] if not text or len(text) < starts[col] or not starts[col] else "  " + lines[k])
            out.append(text.rstrip(" "))
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    boxes = [Box()]
    lists: list[list] = []                                  # [ordered, next number]
    tables: list[list] = []                                 # rows of the open tables
    boxed: list[bool] = []                                  # of the open items: whether they have a box
    pre = 0
    work: list = [(root, False)]
    while work:
        node, leaving = work.pop()
        box = boxes[-1]
        if isinstance(node, str):
            box.write_as_is(node) if pre else box.write(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("pre", "textarea", "listing", "plaintext", "xmp"):
                pre -= 1
            if tag in LISTS:
                lists.pop()
            if tag in ITEMS and boxed.pop():
                lines = boxes.pop().done()
                mark = "  "
                if tag == "li":
                    ordered = lists[-1] if lists else [False, 1]
                    mark = f"{ordered[1]}. " if ordered[0] else "- "
                    ordered[1] += 1
                if lines:
                    boxes[-1].put([(mark if i == 0 else " " * len(mark) if x else "") + x for i, x in enumerate(lines)])
            elif tag in CELLS:
                lines = boxes.pop().done()
                if tables and tables[-1]:
                    tables[-1][-1].append((lines, _span(node.attrs, "colspan", 1000), _span(node.attrs, "rowspan", 65534)))
                else:
                    boxes[-1].put(lines)
            elif tag == "table":
                boxes[-1].put(table_lines(tables.pop()))
            if tag in BLOCKS:
                boxes[-1].block(tag in SPACED and not (tag in LISTS and lists))
            continue
        if not visible(node):
            continue
        if tag == "br":
            box.line(True)
            continue
        if tag in BLOCKS:
            box.block(tag in SPACED and not (tag in LISTS and lists))
        if tag == "hr":
            box.put(["----"])
            box.margin = 1
            continue
        if tag == "input" and node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search", "email", "url", "tel"):
            box.write(node.attrs.get("value", ""))
        kids = shown(node) if tag in FOREIGN else node.kids
        if tag == "details" and "open" not in node.attrs:
            kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
        if tag in ("pre", "textarea", "listing", "plaintext", "xmp"):
            pre += 1
            if kids and isinstance(kids[0], str) and kids[0][:1] == "\n":
                kids = [kids[0][1:], *kids[1:]]
        if tag in LISTS:
            start = node.attrs.get("start", "")
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
        if tag in ITEMS:
            boxed.append(len(boxes) <= DEEPEST)
        if boxed[-1] if tag in ITEMS else tag in CELLS:
            boxes.append(Box())
        elif tag == "table":
            tables.append([])
        elif tag == "tr" and tables:
            tables[-1].append([])
        work.append((node, True))
        work.extend((k, False) for k in reversed(kids))
    return "\n".join(boxes[0].done()).strip("\n")


def extract_text(markup: str | None) -> str:
    return render(parse(markup)) if markup else ""


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "rendered") -> DataFrame:
    """``pages`` with ``out_col``: the visible text of ``html_col``."""
    rest = T.StructType([f for f in pages.schema if f.name.lower() != out_col.lower()])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            text = pa.array([extract_text(x.as_py()) for x in batch.column(html_col)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in rest), text], names=[*rest.names, out_col])

    return pages.mapInArrow(run, T.StructType([*rest, T.StructField(out_col, T.StringType(), False)]))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "html")
    return extract(pages, out_col="text").select("page_id", "text")
