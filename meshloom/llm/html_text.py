"""Visible text of web pages, laid out: a tree builder, visibility rules and a text renderer.

The builder makes a tree of any input: it adds the tags that HTML lets authors leave out
(rows of cells, ends of paragraphs, items, cells and options), closes what an end tag
covers, ignores end tags that match nothing, and moves text that stands directly in a table
before it. The renderer drops what browsers don't show (head, scripts, styles, templates,
hidden and undisplayed elements, closed details, options that aren't selected) and keeps
all other text: blocks on lines of their own, margins as one blank line, items with bullets
or numbers, preformatted text as it is, table cells in aligned columns.

Rules of style sheets count where they set display or visibility on a screen of any width, by
compound selectors (a tag, classes, an id, or several of them on one element, as in
``p.note``), also below others (``nav a``, ``div > p``); of several the cascade chooses. An
element that is displayed as a block stands on lines of its own, a block displayed inline
doesn't. Selectors that look at siblings, states or attributes don't count, nor does a table's
or list's own layout change. By choice, what stands inside svg, object, audio, video, canvas and noscript is no text of the page.
Cells are aligned by the columns that their characters take on a terminal.

A null page gives null; an empty or invisible one the empty text. Rows are independent of
each other, repeated rows give equal texts; other columns, whatever their names, aren't
read; nothing is shuffled.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The elements of HTML by their behaviour.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = set("head script style template title noscript iframe noembed noframes object audio video canvas svg datalist meta link base area map".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup p pre "
    "search section summary table ul".split()
)
MARGIN = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_P = BLOCK - {"body", "html", "optgroup", "legend"} | {"xmp"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TABLE_PARTS = {"table", "thead", "tbody", "tfoot", "tr", "caption", "colgroup"}
#: For a start tag: the open elements that it ends, and those at which the search for them stops.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
#: What a head holds; anything else ends it.
IN_HEAD = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements that an end tag for something outside them does not close.
SCOPE = {"table", "td", "th", "caption", "template", "object"}

ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HIDES = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|$)|<!--|-->", re.S)
MARKS = re.compile(r"""\"(?:[^"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[{};]""")
DECLARED = re.compile(r"(display|visibility)\s*:\s*([\w-]+)\s*(!\s*important)?$", re.I)
INLINE_DISPLAY = re.compile(r"display\s*:\s*([\w-]+)", re.I)
#: Values of display that put text on lines of its own, and that leave it in the line.
BLOCKS, INLINES = {"block", "flex", "grid", "table", "list-item", "flow-root", "table-row", "table-caption"}, {"inline", "inline-block", "inline-flex", "inline-grid", "inline-table", "contents"}
#: Elements of tables, and others, that stand on lines of their own outside of them.
LAID = {"td", "th", "tr", "caption", "tbody", "thead", "tfoot", "xmp"}
STEPS = re.compile(r"\s*(>)\s*|\s+")
COMPOUND = re.compile(r"(?:[A-Za-z_][\w-]*)?(?:[.#][A-Za-z_][\w-]*)*$")
NAMES = re.compile(r"[.#]?[A-Za-z_][\w-]*")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("start", tag, attributes as written) or ("end", tag, "")."""
    at, size = 0, len(page)
    unclosed: set[str] = set()  # quotation marks of which no more follow
    while at < size:
        start = page.find("<", at)
        if start < 0 or start + 1 >= size:
            yield "text", page[at:], ""
            return
        if start > at:
            yield "text", page[at:start], ""
        ch = page[start + 1]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = size if end < 0 else end + 3
            continue
        if ch in "!?":
            end = page.find(">", start)
            at = size if end < 0 else end + 1
            continue
        closing = ch == "/"
        name_at = start + 1 + closing
        if name_at >= size or not (page[name_at].isascii() and page[name_at].isalpha()):
            if closing and name_at < size:
                end = page.find(">", name_at)
                at = size if end < 0 else end + 1
            else:
                yield "text", "<", ""
                at = start + 1
            continue
        end = name_at
        while end < size and page[end] not in " \t\n\r\f/>":
            end += 1
        tag = page[name_at:end].lower()
        stop = end
        while True:  # the > that no quotation marks hold
            stop = page.find(">", stop)
            if stop < 0:
                return  # a tag that never ends is no text
            inner = page[end:stop]
            mark = next((q for q in "\"'" if q not in unclosed and inner.count(q) % 2 and re.search(rf"=\s*{q}[^{q}]*$", inner)), None)
            if mark is None:
                break
            close = page.find(mark, stop)
            if close < 0:
                unclosed.add(mark)
                break
            stop = close
        if closing:
            yield "end", tag, ""
        else:
            yield "start", tag, page[end:stop]
        at = stop + 1
        if not closing and tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I | re.A).search(page, at)
            stop = close.start() if close else size
            yield "text", page[at:stop], "raw" if tag not in ("textarea", "title") else ""
            at = stop


def attributes(written: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(written):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def tree(page: str) -> Node:
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {"html": [0]}  # tag: places in the stack, so that a deep one needs no search

    def opening(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(at: int) -> None:
        """Close the open elements from this place on."""
        for node in reversed(stack[at:]):
            places[node.tag].pop()
        del stack[at:]

    def push(tag: str, attrs: dict[str, str]) -> None:
        parent = stack[-1]
        if parent.tag in TABLE_PARTS - {"caption"}:
            if tag == "table":  # a table directly in a table ends it
                close({"table"}, set())
                parent = stack[-1]
            elif tag == "form":  # a form in a table is empty: what follows stays in the table
                parent.children.append(Node(tag, attrs))
                return
            elif tag not in TABLE_PARTS | {"td", "th", "col", "script", "style", "template"} and not (tag == "input" and attrs.get("type", "").lower() == "hidden"):
                before_table(Node(tag, attrs), tag not in VOID)
                return
        node = Node(tag, attrs)
        parent.children.append(node)
        if tag not in VOID:
            opening(node)

    def before_table(item: Node | str, opens: bool = False) -> None:
        tables = places.get("table")
        at = tables[-1] if tables else 0
        if at == 0:
            stack[-1].children.append(item)
        else:
            siblings = stack[at - 1].children
            siblings.insert(next((i for i in range(len(siblings) - 1, -1, -1) if siblings[i] is stack[at]), len(siblings)), item)
        if opens and isinstance(item, Node):
            opening(item)

    def close(names: set[str], stops: set[str]) -> bool:
        """Close the innermost open element of these names, unless one of ``stops`` holds it."""
        last = lambda tags: max((places[t][-1] for t in tags if places.get(t)), default=0)
        found = last(names)
        if not found:
            return False
        if any(n.tag in stops for n in stack[found + 1 :]) if len(stack) - found < 50 else last(stops - names) > found:
            return False
        cut(found)
        return True

    for kind, value, rest in tokens(page):
        if kind == "text":
            text = value if rest == "raw" else html.unescape(value)
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                cut(len(stack) - 1)
            if stack[-1].tag in TABLE_PARTS - {"caption"} and text.strip():
                before_table(text)
            elif text:
                stack[-1].children.append(text)
        elif kind == "start":
            attrs = attributes(rest) if rest.strip(" \t\n\r\f/") else {}
            if value in ("html", "body") and places.get(value):
                close({"head"}, set())
                continue
            if value in ENDS_P:
                close({"p"}, SCOPE | {"button"})
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                cut(len(stack) - 1)
            if value in IMPLIED_ENDS:
                names, stops = IMPLIED_ENDS[value]
                while close(names, stops):
                    pass
            if value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                push("tr", {})
            if stack[-1].tag == "head" and value not in IN_HEAD:
                cut(len(stack) - 1)
            push(value, attrs)
        elif value == "br":
            close({"head"}, SCOPE)
            push("br", {})
        elif value == "p":
            if not close({"p"}, SCOPE | {"button"}):
                stack[-1].children.append(Node("p", {}))
        elif value in TABLE_PARTS | {"td", "th"}:
            close({value}, {"table"} - {value})
        elif value in BLOCK | {"select", "button", "template", "option"}:
            close({value}, SCOPE - {value})
        elif value not in ("html", "body"):
            close({value}, SCOPE | BLOCK)  # a text-level element doesn't close the blocks inside it
    return root


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on every screen."""
    for query in media.lower().split(","):
        words = query.split()
        if words in ([], ["all"], ["screen"], ["only", "screen"], ["only", "all"]) or words[0] == "not" and len(words) == 2 and words[1] not in ("all", "screen") and "(" not in query:
            return True
    return False


def style_rules(css: str) -> Iterator[tuple[str, list[str]]]:
    """(selectors, declarations) of the rules that apply on a screen."""
    css = COMMENT.sub(" ", css)
    opened: list[tuple[str, bool, list[str]]] = [("@", True, [])]
    at = 0

    def inside(said: str) -> bool:
        above, applies, _ = opened[-1]
        if not applies or not above.startswith("@"):
            return False
        if not said.startswith("@"):
            return True
        name, _, rest = re.sub(r"^(@[\w-]+)", r"\1 ", said).lower().partition(" ")
        return name in ("@layer", "@supports") or name == "@media" and on_screen(rest)

    for mark in MARKS.finditer(css + "}" * (css.count("{") + 1)):  # the end closes all that is open
        if mark[0] not in ("{", "}", ";"):
            continue
        said = css[at : mark.start()].strip()
        at = mark.end()
        if mark[0] == "{":
            opened.append((said, inside(said), []))
            continue
        opened[-1][2].append(said)
        if mark[0] == "}" and len(opened) > 1:
            selectors, applies, declared = opened.pop()
            if applies and not selectors.startswith("@"):
                yield selectors, declared


class Styles:
    """How the page's own style rules and an element's attributes display it."""

    def __init__(self, root: Node) -> None:
        # name that a selector ends with: [(names of each element on its way, whether it is a child, property, (important, ids, classes, tags, order, value))]
        self.selectors: dict[str, list[tuple[list[set[str]], list[bool], str, tuple]]] = {}
        self.found: dict[int, dict[str, str]] = {}
        order = 0
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style" and on_screen(node.attrs.get("media", "")):
                for selectors, declared in style_rules("".join(c for c in node.children if isinstance(c, str))):
                    for found in filter(None, map(DECLARED.match, declared)):
                        order += 1
                        for s in selectors.lower().split(","):
                            self.add(s.strip(), found[1].lower(), bool(found[3]), order, found[2].lower())
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if self.selectors:
            self.match(root)

    def add(self, selector: str, what: str, important: bool, order: int, value: str) -> None:
        steps = STEPS.split(selector)
        compounds = steps[::2]
        if not all(c and COMPOUND.match(c) for c in compounds):
            return
        names = [NAMES.findall(c) for c in compounds]
        flat = [n for own in names for n in own]
        kinds = [sum(n[0] == k for n in flat) for k in "#."]
        rule = (important, *kinds, len(flat) - sum(kinds), order, value)
        self.selectors.setdefault(names[-1][-1], []).append(([set(own) for own in names], [c == ">" for c in steps[1::2]], what, rule))

    def match(self, root: Node) -> None:
        """Find the rule of each element that the cascade chooses, down the tree with the names of the elements above."""
        path: list[set[str]] = []
        todo = [(root, 0)]
        while todo:
            node, depth = todo.pop()
            del path[depth:]
            names = {node.tag, *("." + c.lower() for c in node.attrs.get("class", "").split()), "#" + node.attrs.get("id", "").lower()}
            path.append(names)
            best: dict[str, tuple] = {}
            for name in names & self.selectors.keys():
                for way, child, what, rule in self.selectors[name]:
                    if way[-1] <= names and (what not in best or rule > best[what]) and above(way, child, path):
                        best[what] = rule
            if best:
                self.found[id(node)] = {what: rule[-1] for what, rule in best.items()}
            todo += [(c, depth + 1) for c in reversed(node.children) if isinstance(c, Node)]

    def display(self, node: Node) -> str | None:
        """The value of display that a style gives an element."""
        if own := INLINE_DISPLAY.search(node.attrs.get("style", "")):
            return own[1].lower()
        return self.found[id(node)].get("display") if id(node) in self.found else None

    def visible(self, node: Node, before: bool) -> bool:
        if own := VISIBILITY.search(node.attrs.get("style", "")):
            return own[1].lower() == "visible"
        given = self.found[id(node)].get("visibility") if id(node) in self.found else None
        return before if given in (None, "inherit") else given == "visible"

    def undisplayed(self, node: Node) -> bool:
        attrs = node.attrs
        if node.tag in UNSEEN or node.tag == "dialog" and "open" not in attrs:
            return True
        if attrs and ("hidden" in attrs or HIDES.search(attrs.get("style", ""))):
            return True
        return bool(self.found) and self.display(node) == "none"


def above(way: list[set[str]], child: list[bool], path: list[set[str]]) -> bool:
    """Whether elements above the last of ``path`` match the way to it: each the parent of the next, or anywhere above."""
    at = {len(path) - 1}
    for names, is_child in zip(way[-2::-1], child[::-1], strict=True):
        places = [i - 1 for i in at] if is_child else range(max(at))
        at = {i for i in places if i >= 0 and names <= path[i]}
        if not at:
            return False
    return True


class Lines:
    """Lines of text in the making: inline text gathers in one until a block or a break ends it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline = ""
        self.space = False
        self.margin = False

    def text(self, text: str, keep: bool) -> None:
        if keep:
            if self.space and self.inline:  # the space before it
                self.inline += " "
            self.space = False
            first, *more = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.add(first)
            for line in more:
                self.end(always=True)
                self.add(line)
            return
        body = SPACE.sub(" ", text)
        if body.startswith(" "):
            self.space = bool(self.inline)
        inner = body.strip(" ")
        if inner:
            self.add((" " if self.space and self.inline else "") + inner)
            self.space = body.endswith(" ")

    def add(self, text: str) -> None:
        if text and self.margin:
            if self.lines:
                self.lines.append("")
            self.margin = False
        self.inline += text

    def end(self, always: bool = False) -> None:
        """End the line, if it has text or ``always``."""
        if self.inline or always and (self.lines or not self.margin):
            self.lines.append(self.inline.rstrip(" "))
        self.inline, self.space = "", False

    def block(self, margin: bool) -> None:
        self.end()
        self.margin = self.margin or margin and bool(self.lines)

    def put(self, lines: list[str], margin: bool) -> None:
        """Lines that are ready, as a block."""
        self.block(margin)
        if lines:
            if self.margin:
                self.lines.append("")
            self.margin = False
            self.lines += lines
            self.margin = margin

    def done(self) -> list[str]:
        self.end()
        return trimmed(self.lines)


def trimmed(lines: list[str]) -> list[str]:
    """Without blank lines at either end."""
    a, b = 0, len(lines)
    while a < b and not lines[a].strip():
        a += 1
    while b > a and not lines[b - 1].strip():
        b -= 1
    return lines[a:b]


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for marks that combine."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def number(value: str | None, default: int) -> int:
    return int(value) if value and re.fullmatch(r"\s*-?\d{1,9}\s*", value) else default


#: A part of the rendering; it yields the parts that it waits for, gets their results and returns its own.
Step = Generator["Step", list[str] | None, list[str] | None]


def render(root: Node) -> str:
    hidden = Styles(root)

    # into, children, items and table are steps: they yield the steps that they wait for, so that depth takes no recursion
    def into(lines: Lines, node: Node, keep: bool, visible: bool) -> Step:
        if hidden.undisplayed(node):
            return
        tag = node.tag
        visible = hidden.visible(node, visible)
        if tag == "br":
            lines.end(always=True)
        elif tag == "wbr" or tag in ("img", "embed", "col", "colgroup"):
            pass
        elif tag == "hr":
            lines.block(True)
        elif tag == "input":
            if visible and node.attrs.get("type", "text").lower() not in ("hidden", "password", "checkbox", "radio", "image", "file", "range", "color"):
                lines.text(" " + node.attrs.get("value", "") + " ", False)
        elif tag == "select":
            chosen = options(node)
            for option in chosen:
                lines.text(" ", False)
                yield children(lines, option, False, visible)
                lines.text(" ", False)
        elif tag == "table":
            lines.put((yield table(node, visible)), True)
        elif tag in ("ul", "ol", "menu", "dir"):
            lines.put((yield items(node, visible)), True)
        elif tag == "blockquote" or tag == "dd":
            inner = Lines()
            yield children(inner, node, keep, visible)
            lines.put([("  " + line).rstrip() for line in inner.done()], tag == "blockquote")
        elif tag == "details" and "open" not in node.attrs:
            lines.block(False)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    yield into(lines, child, keep, visible)
                    break
            lines.block(False)
        elif (hidden.display(node) in BLOCKS) if (tag not in BLOCK and tag not in LAID) else hidden.display(node) not in INLINES:
            lines.block(tag in MARGIN)
            yield children(lines, node, keep or tag in ("pre", "xmp"), visible)
            lines.block(tag in MARGIN)
        else:
            yield children(lines, node, keep or tag in ("textarea", "pre", "xmp"), visible)

    def children(lines: Lines, node: Node, keep: bool, visible: bool) -> Step:
        first = node.tag in ("pre", "textarea")
        for child in node.children:
            if isinstance(child, Node):
                yield into(lines, child, keep, visible)
            elif visible:
                lines.text(child.removeprefix("\r").removeprefix("\n") if first else child, keep)
            first = False

    def options(node: Node) -> list[Node]:
        found, todo = [], [c for c in reversed(node.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            if n.tag == "option" and not hidden.undisplayed(n):
                found.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        if "multiple" in node.attrs or number(node.attrs.get("size"), 1) > 1:
            return found
        return [n for n in found if "selected" in n.attrs][-1:] or found[:1]

    def items(node: Node, visible: bool) -> Step:
        ordered = node.tag == "ol"
        own = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and not hidden.undisplayed(c)]
        step = -1 if ordered and "reversed" in node.attrs else 1
        n = number(node.attrs.get("start"), len(own) if step < 0 else 1)
        out: list[str] = []
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                if hidden.undisplayed(child):
                    continue
                n = number(child.attrs.get("value"), n)
                mark = f"{n}. " if ordered else "- "
                n += step
                inner = Lines()
                shown = VISIBILITY.search(child.attrs.get("style", ""))
                yield children(inner, child, False, visible if not shown else shown[1].lower() == "visible")
                for i, line in enumerate(inner.done()):
                    out.append(((mark if i == 0 else " " * len(mark)) + line).rstrip())
            else:
                inner = Lines()
                if isinstance(child, Node):
                    yield into(inner, child, False, visible)
                elif visible:
                    inner.text(child, False)
                out += [("  " + line).rstrip() for line in inner.done()]
        return out

    def cells(node: Node, visible: bool) -> Iterator[tuple[str, Node, bool]]:
        """("caption", "row" or "block", element, visible) in the order of display: head, bodies, foot.

        A block is what belongs in no table; it stands among the rows.
        """
        parts: dict[str, list] = {"caption": [], "thead": [], "tbody": [], "tfoot": []}
        for child in node.children:
            if not isinstance(child, Node) or hidden.undisplayed(child):
                continue
            if child.tag in ("thead", "tbody", "tfoot"):
                shown = VISIBILITY.search(child.attrs.get("style", ""))
                seen = visible if not shown else shown[1].lower() == "visible"
                parts[child.tag] += [("row" if r.tag == "tr" else "block", r, seen) for r in child.children if isinstance(r, Node) and not hidden.undisplayed(r)]
            elif child.tag == "tr":
                parts["tbody"].append(("row", child, visible))
            elif child.tag == "caption":
                parts["caption"].append(("caption", child, visible))
            else:
                parts["tbody"].append(("block", child, visible))
        for part in parts.values():
            yield from part

    def table(node: Node, visible: bool) -> Step:
        out: list[str] = []
        grid: list[dict[int, list[str]]] = []
        taken: dict[int, int] = {}  # column: rows that a cell above still takes
        wide: list[tuple[int, int, int]] = []  # (row, column, columns) of cells over more than one
        for kind, row, seen in cells(node, visible):
            inner = Lines()
            if kind == "caption":
                yield children(inner, row, False, seen)
                out += inner.done()
                continue
            line: dict[int, list[str]] = {}
            at = 0
            later = {c: n - 1 for c, n in taken.items() if n > 1}
            for cell in row.children if kind == "row" else [row]:
                if not isinstance(cell, Node) or hidden.undisplayed(cell):
                    continue
                inner = Lines()
                if kind == "block" or cell.tag not in ("td", "th"):
                    yield into(inner, cell, False, seen)
                    if not inner.inline and not inner.lines:
                        continue
                else:
                    shown = VISIBILITY.search(cell.attrs.get("style", ""))
                    yield children(inner, cell, False, seen if not shown else shown[1].lower() == "visible")
                while at in taken:
                    at += 1
                span = min(max(number(cell.attrs.get("colspan"), 1), 1), 1000)
                down = min(max(number(cell.attrs.get("rowspan"), 1), 1), 65534)
                line[at] = inner.done()
                if span > 1:
                    wide.append((len(grid), at, span))
                if down > 1:
                    later |= dict.fromkeys(range(at, at + span), down - 1)
                at += span
            taken = later
            grid.append(line)
        spans = {(r, c): n for r, c, n in wide}
        widths: dict[int, int] = {}
        for r, line in enumerate(grid):
            for c, text in line.items():
                if (r, c) not in spans:
                    widths[c] = max(widths.get(c, 0), max(map(width, text), default=0))
        starts, at = {}, 0
        for c in sorted({c for line in grid for c in line}):
            starts[c] = at
            at += widths[c] + 2 if widths.get(c) else 0
        for line in grid:
            for k in range(max((len(text) for text in line.values()), default=0)):
                made, wide_so_far = "", 0
                for c, text in sorted(line.items()):
                    if k < len(text) and text[k]:
                        gap = starts[c] - wide_so_far if wide_so_far <= max(starts[c] - 2, 0) else 2
                        made += " " * gap + text[k]
                        wide_so_far += gap + width(text[k])
                out.append(made.rstrip())
        return trimmed(out)

    lines = Lines()
    waiting, result = [into(lines, root, False, True)], None
    while waiting:
        try:
            step, result = waiting[-1].send(result), None
            waiting.append(step)
        except StopIteration as end:
            waiting.pop()
            result = end.value
    return "\n".join(lines.done())


def visible_text(page: str | None) -> str | None:
    """The page's visible text; null for null."""
    return None if page is None else render(tree(page))


def visible_texts(pages: DataFrame, key: str = "page_id", html_column: str = "html") -> DataFrame:
    """(key, text) of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([visible_text(p) for p in part.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return pages.select(F.col(key).cast("long").alias(key), F.col(html_column).alias("html")).mapInArrow(work, f"{key} long, text string")
