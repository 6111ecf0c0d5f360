"""Visible text of web pages, laid out by block, list and table.

A page becomes a tree: end tags that HTML lets authors leave out are implied (p, li, dt, dd, option, table
parts), unknown or stray end tags are passed over. Elements that a browser does not show are left out: the
head, scripts, styles, templates, what is marked hidden or styled away, closed details and dialogs, embedded media
and frames, and of drawings and formulas titles, descriptions, definitions and annotations. Invisible elements
hide their text, but a child may be made visible again. Only style attributes are read, no style sheets. The
rest is written as lines: blocks on lines of their own, paragraphs and headings apart by a blank line, list items
behind a bullet or number at the depth of their list, table cells padded to the width of their column.

Numbers of lists, spans and character references hold as far as they have at most nine digits (seven). Time and memory grow with the
page, whatever it leaves open or spans: indents end at `DEEPEST` columns, and columns that begin beyond `WIDEST` are not aligned.

Null and empty pages give an empty text. Repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import ready

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas meta link base param source track".split())
#: Parts of drawings and formulas that are not shown; title and others above hold there too.
UNSEEN_WITHIN = {"svg": frozenset("desc defs metadata symbol clippath mask marker pattern".split()), "math": frozenset(["annotation", "annotation-xml"])}
#: Blocks apart by a blank line, and blocks on lines of their own.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr menu".split())
BLOCK = APART | frozenset(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main nav search section summary "
    "optgroup option caption".split()
)
LISTS = frozenset("ul ol menu dir".split())
#: An open element is closed by the start of one of these, if nothing of the third set stands between.
CLOSED_BY = {
    "p": (BLOCK - frozenset("html body dd dt li option optgroup caption".split()), frozenset("button td th caption table object".split())),
    "li": (frozenset(["li"]), LISTS | {"table", "td", "th"}),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl", "table", "td", "th"])),
    "option": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "optgroup": (frozenset(["optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    "th": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    "caption": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot", "colgroup"]), frozenset(["table"])),
    "colgroup": (frozenset(["tr", "td", "th", "tbody", "thead", "tfoot"]), frozenset(["table"])),
    **{x: (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])) for x in ("tbody", "thead", "tfoot")},
    "head": (frozenset(["body"]), frozenset()),
}
_CLOSES: dict[str, frozenset] = {}
for _open, (_starts, _) in CLOSED_BY.items():
    for _tag in _starts:
        _CLOSES[_tag] = _CLOSES.get(_tag, frozenset()) | {_open}
#: End tags do not reach beyond these.
WALLS = {t: frozenset(["table"]) for t in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption")}
#: What may begin a tag, and what a tag holds up to its end; quantifiers that give nothing back, so no text is read twice.
OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
INNER = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
NUMBER = re.compile(r"-?[0-9]{1,9}")
#: References by numbers that no character has, or with zeros in front.
ZEROS, BEYOND = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
#: Columns of text beyond which nothing is indented further or aligned.
DEEPEST, WIDEST = 160, 1000
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse|inherit|initial|unset)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def _unescaped(text: str) -> str:
    if "&#" in text:
        text = BEYOND.sub("\ufffd", ZEROS.sub("&#", text))
    return html.unescape(text)


def _number(value: str | None, otherwise: int | None) -> int | None:
    """A whole number of at most nine digits, or the other one."""
    value = (value or "").strip()
    return int(value) if NUMBER.fullmatch(value) else otherwise


class Tags:
    """The tags of a page, in time that grows with its length whatever is left open.

    A tag that does not end is text. When one is met, the ends of all tags are worked out at once, from the page's end on: from a sign
    that a tag comes to outside quotes, it goes on to its end or behind the quoted text to the next sign.
    """

    def __init__(self, page: str) -> None:
        self.page, self.signs, self.ends = page, None, None

    def _end(self, at: int) -> int:
        """Where the tag whose inner part begins here ends, or -1."""
        if self.signs is None:
            stop = INNER.match(self.page, at).end()
            if stop < len(self.page) and self.page[stop] == ">":
                return stop
            self.signs = [m.start() for m in re.finditer("[>\"']", self.page)]
            self.ends, later = [-1] * (len(self.signs) + 1), {}
            for k in range(len(self.signs) - 1, -1, -1):
                sign = self.page[self.signs[k]]
                if sign == ">":
                    self.ends[k] = self.signs[k]
                else:
                    self.ends[k] = self.ends[later[sign] + 1] if sign in later else -1
                    later[sign] = k
        return self.ends[bisect_left(self.signs, at)]

    def next(self, at: int) -> tuple[int, int, re.Match | None, str]:
        """Where the next tag, comment or declaration begins and ends, and of a tag its name and inner part; at the end of the page nothing."""
        page = self.page
        while m := OPENING.search(page, at):
            begin = m.start()
            if m[2] is None:
                comment = page.startswith("<!--", begin)
                end = page.find("-->", begin + 4) if comment else page.find(">", begin + 2)
                if end >= 0:
                    return begin, end + (3 if comment else 1), None, ""
                if comment:
                    return begin, len(page), None, ""
                if page.find(">", begin) < 0:
                    break
            elif (end := self._end(m.end())) >= 0:
                return begin, end + 1, m, page[m.end() : end]
            at = begin + 1
        return len(page), len(page), None, ""


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), _unescaped(value.strip("\"'")))
    return out


def tree(page: str) -> Node:
    """The page's elements; children are nodes and strings."""
    root = Node("#root", {})
    open_, at, tags = [root], 0, Tags(page)
    count: Counter[str] = Counter()

    def shut(k: int) -> None:
        count.subtract(x.tag for x in open_[k:])
        del open_[k:]

    while True:
        begin, end, m, inner = tags.next(at)
        # a "<" that starts no tag is text
        if text := page[at:begin]:
            open_[-1].children.append(_unescaped(text))
        if begin == len(page):
            return root
        at = end
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            wall = WALLS.get(tag, frozenset())
            for k in range(len(open_) - 1, 0, -1) if count[tag] > 0 else ():
                if open_[k].tag == tag:
                    shut(k)
                    break
                if open_[k].tag in wall or tag not in ("table", "body", "html") and tag not in WALLS and open_[k].tag in ("td", "th"):
                    break
            else:
                if tag == "br":
                    open_[-1].children.append(Node("br", {}))
            continue
        ending = [e for e in _CLOSES.get(tag, ()) if count[e] > 0]
        for k in range(len(open_) - 1, 0, -1) if ending else ():
            own = open_[k].tag
            if own in CLOSED_BY and tag in CLOSED_BY[own][0]:
                shut(k)
                ending = [e for e in ending if count[e] > 0]
            if not ending or all(own in CLOSED_BY[e][1] for e in ending):
                break
        node = Node(tag, _attributes(inner) if inner.strip() else {})
        open_[-1].children.append(node)
        drawn = count["svg"] > 0 or count["math"] > 0 or tag in ("svg", "math", "path")
        if inner.endswith("/") and tag not in BLOCK and drawn:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            inner = page[at : end.start() if end else len(page)]
            node.children.append(_unescaped(inner) if tag in ("textarea", "title") else inner)
            at = end.end() if end else len(page)
        elif tag not in VOID:
            open_.append(node)
            count[tag] += 1


def _hidden(node: Node, parent: Node | None) -> bool:
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    if node.tag == "input":
        return a.get("type", "").lower() not in ("submit", "button", "reset")
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary":
        return True
    # a collapsed row takes no room
    if node.tag in ("tr", "tbody", "thead", "tfoot") and [x.lower() for x in VISIBILITY.findall(a.get("style", ""))][-1:] == ["collapse"]:
        return True
    return "style" in a and bool(HIDING.search(a["style"]))


def _seen(node: Node, parent: bool, inside: str) -> bool:
    """Whether the element's own text is visible, given its parent's; a child may set it back."""
    found = VISIBILITY.findall(node.attrs.get("style", ""))
    own = (found[-1] if found else node.attrs.get("visibility", "") if inside == "svg" or node.tag == "svg" else "").lower().strip()
    return own in ("visible", "initial") if own in ("visible", "initial", "hidden", "collapse") else parent


class Sheet:
    """Lines under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        #: the pieces of the line at hand
        self.line: list[str] = []
        self.gap, self.blank, self.indent, self.lead = False, False, "", ""

    def end_line(self) -> None:
        if self.line or self.lead:
            self._write()
        self.gap = False

    def _write(self) -> None:
        self.lines.append((self.lead or self.indent) + "".join(self.line))
        self.line, self.lead = [], ""

    def put(self, text: str) -> None:
        """Text of which runs of white space count as one blank."""
        flat = SPACE.sub(" ", text)
        words = flat.strip(" ")
        if not words:
            self.gap |= bool(flat)
            return
        self._apart()
        if (self.gap or flat[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(words)
        self.gap = flat[-1] == " "

    def keep(self, text: str) -> None:
        """Text as it is."""
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self._apart()
                self._write()
            if part:
                self.line.append(part)

    def _apart(self) -> None:
        if self.blank and not self.line:
            if self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False

    def block(self, apart: bool) -> None:
        self.end_line()
        self.blank |= apart and bool(self.lines)

    def text(self) -> str:
        self.end_line()
        lines = [x.rstrip() for x in self.lines]
        first, last = 0, len(lines)
        while last and not lines[last - 1]:
            last -= 1
        while first < last and not lines[first]:
            first += 1
        return "\n".join(lines[first:last])


def _span(node: Node, name: str, most: int) -> int:
    return max(1, min(_number(node.attrs.get(name), 1), most))


class Taken:
    """The columns that cells of earlier rows reach down into, as runs of columns without a gap.

    A run is kept whole until the first of all cells ends, so a row passes over it in one step.
    """

    def __init__(self) -> None:
        #: of each run its first column, the one behind its last, and its cells: first column, the one behind, and the row at which it ends
        self.runs: list[list] = []
        self.starts: list[int] = []
        self.soonest = float("inf")

    def at_row(self, row: int) -> None:
        if row >= self.soonest:
            cells = [cell for run in self.runs for cell in run[2] if cell[2] > row]
            self.runs, self.starts, self.soonest = [], [], float("inf")
            for cell in cells:
                self.add(cell)

    def add(self, cell: tuple[int, int, int]) -> None:
        self.soonest = min(self.soonest, cell[2])
        k = bisect_right(self.starts, cell[0]) - 1
        if k >= 0 and self.runs[k][1] >= cell[0]:
            self.runs[k][1] = max(self.runs[k][1], cell[1])
            self.runs[k][2].append(cell)
        else:
            k += 1
            self.starts.insert(k, cell[0])
            self.runs.insert(k, [cell[0], cell[1], [cell]])
        while k + 1 < len(self.runs) and self.starts[k + 1] <= self.runs[k][1]:
            _, end, cells = self.runs.pop(k + 1)
            self.starts.pop(k + 1)
            self.runs[k][1] = max(self.runs[k][1], end)
            self.runs[k][2] += cells


def grid(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Rows of cells (text, columns, rows) as lines, each cell padded to its column.

    Columns that no cell has to itself take no room; columns that begin beyond `WIDEST` are not aligned.
    """
    width: dict[int, int] = {}
    placed, taken = [], Taken()
    for number, row in enumerate(rows):
        taken.at_row(number)
        at, run, cells, down_from = 0, 0, [], []
        for text, columns, down in row:
            while run < len(taken.runs) and taken.runs[run][0] <= at:
                at = max(at, taken.runs[run][1])
                run += 1
            lines = text.split("\n")
            cells.append((at, lines))
            if columns == 1:
                width[at] = max(width.get(at, 0), *map(len, lines))
            if down > 1:
                down_from.append((at, at + columns, number + down))
            at += columns
        for cell in down_from:
            taken.add(cell)
        placed.append(cells)
    alone = sorted(width)
    room = [0, *accumulate(width[c] + 2 for c in alone)]
    out = []
    for cells in placed:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for c, lines in cells:
                if k < len(lines) and lines[k]:
                    begin = min(room[bisect_left(alone, c)], WIDEST)
                    line = line.ljust(begin) + ("  " if len(line) > begin else "") + lines[k]
            out.append(line)
    return out


def render(page: str | None) -> str:
    """The visible text of a page."""
    if not page:
        return ""
    sheets, tables, lists = [Sheet()], [], []
    # (node, parent, False: enter, True: leave)
    walk: list[tuple] = [(tree(page), None, False)]
    pre, indents = 0, []
    # of the open elements: whether their own text shows, and the drawing or formula they are in
    seen, inside = [True], [""]
    while walk:
        node, parent, leave = walk.pop()
        sheet = sheets[-1]
        if isinstance(node, str):
            if parent.tag in ("table", "tbody", "thead", "tfoot", "tr") and not node.strip() or parent.tag == "details" and "open" not in parent.attrs:
                continue
            if not seen[-1]:
                continue
            if pre:
                # the line break behind the start tag is no text
                sheet.keep(node.removeprefix("\n") if parent.tag == "pre" and parent.children[0] is node else node)
            else:
                sheet.put(node)
            continue
        tag = node.tag
        if not leave:
            if _hidden(node, parent) or tag in UNSEEN_WITHIN.get(inside[-1], ()):
                continue
            if inside[-1] == "svg" and node.attrs.get("display", "").strip().lower() == "none":
                continue
            shown = _seen(node, seen[-1], inside[-1])
            if not shown and tag in ("br", "wbr", "input", "hr"):
                continue
            if tag == "br":
                if sheet.line or sheet.lead:
                    sheet.end_line()
                elif sheet.lines and sheet.lines[-1]:
                    sheet.lines.append("")
                continue
            if tag == "wbr":
                continue
            if tag == "input":
                sheet.put(" " + node.attrs.get("value", "") + " ")
                continue
            if tag == "table":
                sheet.block(True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                sheets.append(Sheet())
                lists.append(None)
            elif tag == "li":
                sheet.block(False)
                order = next((x for x in reversed(lists) if x), None) or {"tag": "ul", "next": 1, "before": ""}
                order["next"] = _number(node.attrs.get("value"), order["next"])
                bullet = f"{order['next']}. " if order["tag"] == "ol" else "- "
                order["next"] += 1
                sheet._apart()
                sheet.lead, sheet.indent = order["before"] + bullet if shown else "", order["before"] + " " * (len(bullet) if len(order["before"]) < DEEPEST else 0)
            elif tag in LISTS:
                nested = parent is not None and parent.tag == "li"
                sheet.block(not nested)
                lists.append({"tag": tag, "next": _number(node.attrs.get("start"), 1), "before": sheet.indent, "lead": sheet.lead})
            elif tag == "hr":
                sheet.block(True)
                continue
            elif tag in BLOCK:
                # a paragraph that opens a list item stands behind its bullet
                if not (sheet.lead and not sheet.line):
                    sheet.block(tag in APART)
                if tag in ("dd", "blockquote"):
                    indents.append(sheet.indent)
                    sheet.indent += "    " if len(sheet.indent) < DEEPEST else ""
                if tag == "pre":
                    pre += 1
            elif tag == "q" and shown:
                sheet.put('"')
            elif tag == "text" and inside[-1] == "svg":
                # labels stand apart
                sheet.block(False)
            seen.append(shown)
            inside.append(tag if tag in UNSEEN_WITHIN else "" if tag == "foreignobject" else inside[-1])
            walk.append((node, parent, True))
            walk.extend((child, node, False) for child in reversed(node.children))
            continue
        shown, within = seen.pop(), inside.pop()
        if tag == "table":
            for line in grid(tables.pop()):
                sheet._apart()
                sheet.lines.append((sheet.lead or sheet.indent) + line)
                sheet.lead = ""
            sheet.block(True)
        elif tag in ("td", "th") and tables and lists and lists[-1] is None:
            lists.pop()
            text = sheets.pop().text()
            tables[-1][-1].append((text, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
        elif tag == "li":
            sheet.block(False)
            sheet.indent = sheet.indent[: -len(sheet.indent.lstrip(" ")) or None]
            order = next((x for x in reversed(lists) if x), None)
            sheet.indent = order["before"] if order else ""
        elif tag in LISTS:
            order = lists.pop()
            sheet.block(not any(lists))
            sheet.indent = order["before"]
        elif tag in BLOCK:
            if tag == "pre":
                pre -= 1
            sheet.block(tag in APART)
            if tag in ("dd", "blockquote"):
                sheet.indent = indents.pop()
        elif tag == "q" and shown:
            sheet.line.append('"')
        elif tag == "text" and within == "svg":
            sheet.block(False)
    return sheets[0].text()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, text`` of every row."""
    ready(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x.as_py()) for x in batch.column(1)], pa.string())], ["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
