"""Visible text of raw HTML, laid out: a tree builder with implied tags, then a renderer of blocks.

The tree builder closes elements that the next tag ends without saying so (p before a block, li before li,
cells and rows of tables, options) and ignores end tags that match nothing. The renderer leaves out what is
not shown (head, scripts, styles, templates, comments; elements that attributes, styles or the page's rules take out by
display, with all in them; text that is hidden by visibility, which elements inside can turn back), collapses white space outside
pre and textarea, puts blocks on lines of their own and paragraphs apart by an empty line, numbers and
indents lists, and pads the cells of a table's column to one width.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard, by what they do here.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "noscript", "iframe", "noembed", "noframes", "xmp"}
UNSEEN = {"area", "audio", "base", "canvas", "col", "colgroup", "datalist", "embed", "head", "iframe", "link", "meta", "noembed", "noframes", "noscript", "object", "param", "script", "source", "style", "svg", "template", "title", "track", "video"}
BLOCK = {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "search", "section", "select", "summary", "table", "ul"}
APART = {"blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "listing", "xmp"}
LISTS = {"ul", "ol", "menu", "dir"}
# An open element that each start tag ends, and the elements that stop the search for it.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "body": {"head"}}
STOPS = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
TABLE = {"table", "template"}
SECTIONS = {"thead", "tbody", "tfoot"}
# The open elements of a table that its parts go into; what else is open above them ends.
INTO = {"td": {"tr", "table", *SECTIONS}, "th": {"tr", "table", *SECTIONS}, "tr": {"table", *SECTIONS}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements open at once; deeper ones become siblings, as in browsers. Largest spans of the HTML standard.
DEEPEST, WIDEST, TALLEST = 512, 1000, 65534

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""\s*/*\s*([^\s=>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_WHOLE = re.compile(r"\s*([+-]?\d{1,400})")
_RULE = re.compile(r"/\*.*?\*/|([^{}]*)([{}])", re.S)
_COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
_SHOWS = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?", re.I)
_SCREEN = re.compile(r"(?:only\s+)?(?:screen|all)?$", re.I)


class Node:
    __slots__ = ("attributes", "children", "gone", "seen", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.gone, self.seen = False, True
        self.children: list[Node | str] = []


def tokens(source: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """(kind, name or text, attributes) with kind start, end or text; comments and declarations are passed over."""
    at, n = 0, len(source)
    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", html.unescape(source[at:lt]), {}
        if lt == n:
            return
        after = source[lt + 1 : lt + 2]
        if after in ("!", "?"):
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                if source.startswith((">", "->"), lt + 4):
                    end, width = source.find(">", lt + 4), 1
                else:
                    width = 3
            else:
                end, width = source.find(">", lt), 1
            at = n if end < 0 else end + width
            continue
        closing = after == "/"
        name = _NAME.match(source, lt + 1 + closing)
        if not name:
            if closing:  # a comment, by the standard
                end = source.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                yield "text", "<", {}
                at = lt + 1
            continue
        tag, at, attributes = name[0].lower(), name.end(), {}
        while at < n and source[at] != ">":
            part = _ATTRIBUTE.match(source, at)
            if not part or part.end() == at:
                at += 1
                continue
            value = part[2] or ""
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            attributes.setdefault(part[1].lower(), html.unescape(value))
            at = part.end()
        at += 1
        if closing:
            yield "end", tag, {}
            continue
        yield "start", tag, attributes
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            body = source[at : end.start()] if end else source[at:]
            yield "text", html.unescape(body) if tag in ("title", "textarea") else body, {}
            at = end.start() if end else n


def tree(source: str) -> Node:
    """The elements of a page below a root without a name.

    From DEEPEST open elements on, elements are siblings of the last open one, and their end tags end nothing else;
    what is not seen there is still an element of its own, so its text stays unseen.
    """
    root = Node("", {})
    stack = [root]
    over: list[str] = []  # open elements that were not pushed

    def close(tags: set[str], stops: set[str]) -> None:
        """Close down to the outermost open element of `tags` above the innermost of `stops`."""
        lowest = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in stops or stack[k].tag == "template":
                break
            if stack[k].tag in tags:
                lowest = k
        if lowest is not None:
            del stack[lowest:]

    def push(node: Node) -> None:
        if len(stack) < DEEPEST or (len(stack) == DEEPEST and unseen(node)):
            stack.append(node)
            over.clear()
        else:
            over.append(node.tag)

    for kind, name, attributes in tokens(source):
        if kind == "end" and name in over:
            del over[len(over) - 1 - over[::-1].index(name) :]
            if name in BLOCK or name in APART:  # what follows is on a line of its own
                stack[-1].children.append(Node("div", {}))
            continue
        if kind == "text":
            stack[-1].children.append(name)
        elif kind == "start":
            if name in ENDS:
                close(ENDS[name], STOPS.get(name, TABLE))
            if name in APART or name in BLOCK:
                close({"p"}, {"button", "td", "th", "table", "object", "caption"})
            if name in ("html", "body") and any(x.tag == name for x in stack):
                continue
            if name == "a":
                close({"a"}, {"td", "th", "table", *BLOCK, *APART})
            if name in INTO and next((x.tag for x in reversed(stack) if x.tag in TABLE), "") == "table":
                while stack[-1].tag not in INTO[name]:
                    stack.pop()
                if name in ("td", "th") and stack[-1].tag != "tr" and len(stack) < DEEPEST:
                    row = Node("tr", {})
                    stack[-1].children.append(row)
                    push(row)
            node = Node(name, attributes)
            stack[-1].children.append(node)
            if name == "form" and stack[-1].tag in INTO["td"]:  # its rows and cells are the table's
                continue
            if name not in VOID:
                push(node)
        elif name == "p" and not any(x.tag == "p" for x in stack):
            stack[-1].children.append(Node("p", {}))
        elif name == "br":
            stack[-1].children.append(Node("br", {}))
        else:
            # an end tag of text inside (b, span) doesn't leave a block; one of a block doesn't leave a cell
            walls = {"td", "th", "table"} - {name} if name in BLOCK | APART else ({"td", "th", "table"} | BLOCK | APART) - {name}
            if name in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                walls = {"table"} - {name}
            if name in ("html", "body"):
                walls = {""}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if stack[k].tag in walls or stack[k].tag == "template":
                    break
    return root


def shows(text: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of declarations: whether important, and the value; the last of equal weight counts."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in _SHOWS.findall(text):
        if name.lower() not in out or bool(important) >= out[name.lower()][0]:
            out[name.lower()] = bool(important), value.lower()
    return out


def unseen(node: Node) -> bool:
    """Whether a node is not shown by its element, its attributes or its style alone."""
    a = node.attributes
    said = {k: v for k, (_, v) in shows(a.get("style", "")).items()}
    if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden") or said.get("visibility") in ("hidden", "collapse"):
        return True
    return said["display"] == "none" if "display" in said else "hidden" in a or (node.tag == "dialog" and "open" not in a)


class Compound:
    """A tag, classes and ids that one element must have."""

    __slots__ = ("classes", "ids", "tag")

    def __init__(self, tag: str, rest: str):
        self.tag, self.classes, self.ids = tag.lower(), frozenset(re.findall(r"\.([\w-]+)", rest)), frozenset(re.findall(r"#([\w-]+)", rest))

    def fits(self, node: Node) -> bool:
        return self.tag in ("*", node.tag) and self.ids <= {node.attributes.get("id", "")} and (not self.classes or self.classes <= set(node.attributes.get("class", "").split()))


def _selector(text: str) -> list[tuple[str, Compound]] | None:
    """Compounds from the last to the first, each with how it lies below the next: a child (>) or anywhere (blank). None: not understood."""
    out, join = [], " "
    for part in re.sub(r"\s*>\s*", " > ", text.strip()).split():
        if part == ">":
            join = ">"
            continue
        m = _COMPOUND.match(part)
        if not m or not (m[1] or m[2]):
            return None
        out.append((join, Compound(m[1] or "*", m[2])))
        join = " "
    return out[::-1] if out and join == " " else None


def _lies_in(selector: list[tuple[str, Compound]], at: int, path: list[Node], end: int) -> bool:
    """Whether the compounds from `at` on fit ancestors among path[:end], the element of compound at - 1 being path[end]."""
    if at == len(selector):
        return True
    places = (end - 1,) if selector[at - 1][0] == ">" else range(end - 1, -1, -1)
    return any(k >= 0 and selector[at][1].fits(path[k]) and _lies_in(selector, at + 1, path, k) for k in places)


class Rules:
    """What the style elements of a page say of display and visibility.

    Rules count whose selectors are tags, classes and ids joined by descent or as children, outside of at-rules or in media
    that a screen of any size matches. Important ones count before others, then inline styles, then the more specific, then the last.
    """

    def __init__(self, root: Node):
        self.found: dict[str, list[tuple]] = {}
        order, todo = 0, [root]
        while todo:
            node = todo.pop()
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
            if node.tag != "style" or not self._screen(node.attributes.get("media", "")):
                continue
            heads: list[str] = []
            for part in _RULE.finditer("".join(c for c in node.children if isinstance(c, str))):
                if part[2] == "{":
                    heads.append(part[1].rsplit(";", 1)[-1].strip())
                elif part[2] == "}" and heads:
                    head, said = heads.pop(), shows(part[1])
                    if not said or head.startswith("@") or not all(h[:6].lower() == "@media" and self._screen(h[6:]) for h in heads):
                        continue
                    for one in head.split(","):
                        if selector := _selector(one):
                            order += 1
                            self._add(selector, order, said)

    @staticmethod
    def _screen(media: str) -> bool:
        return any(_SCREEN.match(m.strip()) for m in media.split(","))

    def _add(self, selector: list[tuple[str, Compound]], order: int, said: dict[str, tuple[bool, str]]) -> None:
        last = selector[0][1]
        name = next((f"#{i}" for i in last.ids), next((f".{c}" for c in last.classes), last.tag))
        weight = (sum(len(c.ids) for _, c in selector), sum(len(c.classes) for _, c in selector), sum(c.tag != "*" for _, c in selector), order)
        self.found.setdefault(name, []).append((selector, weight, said))

    def of(self, node: Node, path: list[Node]) -> dict[str, str]:
        """The values of display and visibility that rules and the inline style give a node below path."""
        best: dict[str, tuple] = {}

        def offer(said: dict[str, tuple[bool, str]], inline: bool, weight: tuple) -> None:
            for k, (important, v) in said.items():
                if k not in best or best[k][0] <= (important, inline, weight):
                    best[k] = (important, inline, weight), v

        if self.found:
            for name in (node.tag, "*", f"#{node.attributes.get('id', '')}", *(f".{c}" for c in set(node.attributes.get("class", "").split()))):
                for selector, weight, said in self.found.get(name, ()):
                    if selector[0][1].fits(node) and _lies_in(selector, 1, path, len(path)):
                        offer(said, False, weight)
        if "style" in node.attributes:
            offer(shows(node.attributes["style"]), True, ())
        return {k: v for k, (_, v) in best.items()}


def settle(root: Node, rules: Rules) -> None:
    """Set for each node whether it and all in it is gone (display), and whether its own text is seen (visibility, which nodes below can turn back)."""
    path, todo = [root], [(c, 1) for c in reversed(root.children) if isinstance(c, Node)]
    while todo:
        node, depth = todo.pop()
        del path[depth:]
        a, said = node.attributes, rules.of(node, path)
        by_default = "hidden" in a or (node.tag == "dialog" and "open" not in a)  # any rule for display counts before it
        node.gone = node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden") or (said["display"] == "none" if "display" in said else by_default)
        visibility = said.get("visibility", "inherit")
        node.seen = path[-1].seen if visibility in ("inherit", "unset") else visibility not in ("hidden", "collapse")
        path.append(node)
        if not node.gone:
            todo.extend((c, depth + 1) for c in reversed(node.children) if isinstance(c, Node))


def whole(text: str, other: int) -> int:
    """The whole number at the begin of an attribute, within 32 bits."""
    m = _WHOLE.match(text)
    return max(-(2**31), min(2**31 - 1, int(m[1]))) if m else other


class Page:
    """Lines of text. `gap` is the number of line ends that the next text needs before it."""

    def __init__(self):
        self.lines: list[str] = [""]
        self.gap, self.blank, self.fresh = 0, False, True
        self.indent = ""
        self.mark = ""

    def apart(self, ends: int) -> None:
        self.blank = False
        if not self.fresh:
            self.gap = max(self.gap, ends)

    def write(self, text: str, kept: bool = False) -> None:
        if kept:
            for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
                if i:
                    self.turn()
                if line:
                    self.put(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.blank = True
            words = words[1:]
        if not words:
            return
        trailing = words.endswith(" ")
        self.put(words.rstrip(" ") if trailing else words)
        self.blank = trailing

    def put(self, text: str) -> None:
        if self.gap:
            self.lines.extend([""] * self.gap)
            self.blank = False
        elif self.blank and self.lines[-1].strip(" ") and text:
            text = " " + text
        if not self.lines[-1]:
            self.lines[-1] = self.indent + self.mark
            if self.mark:
                self.indent += " " * len(self.mark)
                self.mark = ""
        self.gap, self.blank, self.fresh = 0, False, False
        self.lines[-1] += text

    def turn(self) -> None:
        """A line break inside a block."""
        if self.gap:
            self.gap += 1
        elif not self.fresh:
            self.lines.append("")
        self.blank = False

    def text(self) -> str:
        lines = [x.rstrip(" \t") for x in self.lines]
        out: list[str] = []
        for line in lines:
            if line or (out and out[-1]):
                out.append(line)
        while out and not out[-1]:
            out.pop()
        return "\n".join(out)


def width(text: str) -> int:
    """Columns that a text takes: wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(node: Node, page: Page, kept: bool = False) -> None:
    counter = [whole(node.attributes.get("start", ""), 1)]
    for child in node.children:
        if isinstance(child, str):
            if node.seen:
                page.write(child, kept)
        elif not child.gone:
            element(child, page, kept, node.tag, counter)


def element(node: Node, page: Page, kept: bool, parent: str, counter: list[int]) -> None:
    tag = node.tag
    if tag == "br":
        page.turn()
    elif tag == "img":
        if node.seen and (alt := node.attributes.get("alt", "")):
            page.write(alt)
    elif tag == "input":
        if node.seen and node.attributes.get("type", "text").lower() in ("text", "submit", "button", "search", "email", "url", "reset", "tel"):
            page.write(node.attributes.get("value", ""))
    elif tag == "table":
        page.apart(2)
        table(node, page)
        page.apart(2)
    elif tag in LISTS:
        nested = parent in LISTS or parent == "li"
        page.apart(1 if nested else 2)
        render(node, page, kept)
        page.apart(1 if nested else 2)
    elif tag == "li":
        page.apart(1)
        before, mark = page.indent, page.mark
        counter[0] = whole(node.attributes.get("value", ""), counter[0])
        page.mark = "" if not node.seen else f"{counter[0]}. " if parent == "ol" else "- "
        page.indent += "  " if mark else ""
        counter[0] += 1
        render(node, page, kept)
        page.indent, page.mark = before, ""
        page.apart(1)
    elif tag == "dd":
        page.apart(1)
        before, page.indent = page.indent, page.indent + "  "
        render(node, page, kept)
        page.indent = before
        page.apart(1)
    elif tag == "blockquote":
        page.apart(2)
        before, page.indent = page.indent, page.indent + "  "
        render(node, page, kept)
        page.indent = before
        page.apart(2)
    elif tag in APART or tag in BLOCK:
        page.apart(2 if tag in APART else 1)
        if tag == "details" and "open" not in node.attributes:
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary" and not child.gone:
                    element(child, page, kept, tag, counter)
        else:
            render(node, page, kept or tag in ("pre", "listing", "xmp"))
        page.apart(2 if tag in APART else 1)
    elif tag == "q":
        if node.seen:
            page.write('"')
        render(node, page, kept)
        if node.seen:
            page.put('"')
    else:
        render(node, page, kept or tag == "textarea")


def _rows(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node) and not child.gone:
            if child.tag == "tr":
                yield child
            elif child.tag in SECTIONS:
                yield from _rows(child)


def _loose(node: Node, page: Page) -> None:
    """What lies in a table or its sections outside of rows."""
    for child in node.children:
        if isinstance(child, str):
            if node.seen and child.strip():
                page.write(child)
        elif child.gone:
            continue
        elif child.tag in SECTIONS:
            _loose(child, page)
        elif child.tag != "tr":
            element(child, page, False, "table", [1])


def _span(node: Node, name: str, most: int) -> int:
    value = whole(node.attributes.get(name, ""), 1)
    if value == 0 and name == "rowspan":  # to the end
        return most
    return min(most, max(1, value))


def table(node: Node, page: Page) -> None:
    """Cells of a column start at the same place; a cell with several lines takes as many lines of its row."""
    _loose(node, page)
    page.apart(1)
    grid: list[list[list[str]]] = []
    until: dict[int, int] = {}  # the last row that a cell of the column reaches into
    single: dict[int, int] = {}
    for r, row in enumerate(_rows(node)):
        line: list[list[str]] = []
        for cell in row.children:
            hidden = isinstance(cell, Node) and cell.gone
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or hidden:
                if isinstance(cell, Node) and not hidden or isinstance(cell, str) and cell.strip() and row.seen:
                    loose = Page()
                    render(cell, loose) if isinstance(cell, Node) else loose.write(cell)
                    line.append(loose.text().split("\n"))
                continue
            while until.get(len(line), -1) >= r:
                line.append([""])
            inner = Page()
            render(cell, inner)
            body = inner.text().split("\n")
            wide, last = _span(cell, "colspan", WIDEST), r + _span(cell, "rowspan", TALLEST) - 1
            at = len(line)
            for k in range(wide):
                until[at + k] = max(until.get(at + k, -1), last)
            line.append(body)
            line.extend([""] for _ in range(wide - 1))
            if wide == 1:
                single[at] = max(single.get(at, 0), max(map(width, body)))
        grid.append(line)
    for line in grid:
        for k in range(max((len(cell) for cell in line), default=0)):
            out, at = "", 0
            for c, cell in enumerate(line):
                text = cell[k] if k < len(cell) else ""
                if text:
                    out += " " * max(at - width(out), 2 if out else 0) + text
                at += single.get(c, 0) + 2 if single.get(c, 0) else 0
            if out:
                page.apart(1)
                page.write(out, kept=True)
        page.apart(1)


def visible_text(source: str) -> str:
    """The text that a reader of the page sees."""
    if sys.getrecursionlimit() < 20 * DEEPEST:
        sys.setrecursionlimit(20 * DEEPEST)
    root = tree(source)
    settle(root, Rules(root))
    page = Page()
    render(root, page)
    return page.text()


TEXTS = "page_id bigint, url string, text string"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            texts = [None if x is None else visible_text(x) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text for each row of pages (page_id, url, html). Nothing is shuffled.

    A null html gives a null text, an empty one or one without visible text gives "". Repeated rows are
    rendered each; null ids and urls stay; other columns are ignored; an empty table gives an empty table.
    """
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(_extract, TEXTS)
