"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a plain-text layout.

The builder opens and closes what the source leaves out (paragraphs, list items, rows, cells, options), keeps raw-text
elements whole and flattens what nests deeper than ``DEPTH``, as browsers do. Not shown are scripts, styles, the head,
templates, fallbacks, closed details and dialogs, unselected options, and what ``hidden``, ``display:none`` or
``visibility:hidden`` hide, inline or by simple selectors of the page's own style sheets; of svg its text elements are shown, of
math all but annotations and phantoms. All other text is: white space collapses but in
preformatted text, paragraphs are apart by a blank line, other blocks by a line break, list items have marks and
indents, and table cells stand in aligned columns, spans included.

Defined cases: a null or empty page has an empty text; broken or cut tags never raise, an unclosed tag or comment ends
the page as in browsers; pages of any length are taken whole, and cells that span many rows and columns cost no more than others;
of attributes and titles that repeat the first counts; repeated rows give equal texts; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 200
#: Cells longer than this don't widen their column.
COLUMN = 80

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style template noscript noframes noembed iframe head title object audio video canvas datalist meta link annotation annotation-xml mphantom".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul xmp".split())
BLOCKS = CLOSES_P | frozenset("html body li dt dd tr caption legend option optgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre figure table menu dir hr fieldset xmp".split())
#: For a start tag: the open elements that it ends, and those beyond which it doesn't look.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "caption"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
#: Elements of svg that show no text of theirs, and elements of math whose parts stand apart.
UNDRAWN = frozenset("title desc defs metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
APART = frozenset("mfrac msub msup msubsup mroot mover munder munderover mmultiscripts mtr mlabeledtr mtable".split())
#: Start tags that end svg and math, unless they are in one of the elements that may hold HTML.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
HOLDERS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: End tags don't reach out of these, unless they name them.
WALLS = frozenset("table td th caption button select template".split())

#: An attribute as the tokenizer's states have it: quotes open a value only right after "=", elsewhere they are characters.
NAMED = r"""[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+"""
VALUE = r"""(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"%s(?:"|\Z)|'%s(?:'|\Z)|%s|(?=>|\Z)))?+"""
PLAIN = r"""[^ \t\n\f\r"'>][^ \t\n\f\r>]*+"""
ATTRIBUTE = re.compile(f"({NAMED})" + VALUE % ('([^"]*+)', "([^']*+)", f"({PLAIN})"))
TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[ \t\n\f\r/]++|"""
    + NAMED + VALUE % ('[^"]*+', "[^']*+", PLAIN)
    + r""")*+)(>|\Z)|</(?:>|[^a-zA-Z][^>]*+(?:>|\Z))""",
    re.S,
)
SPACE = re.compile(r"[ \t\n\r\f]+")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
NONE, HIDDEN, SHOWN, KEPT = (re.compile(p) for p in (r"display\s*:\s*none", r"visibility\s*:\s*(?:hidden|collapse)", r"visibility\s*:\s*visible", r"white-space\s*:\s*(?:pre|break-spaces)"))
SIMPLE = re.compile(r"([a-z][\w-]*)?(?:([.#])([\w-]+))?\Z")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, source: str = ""):
        self.tag, self.attributes, self.children = tag, attributes(source) if source else {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(next((v for v in values if v), "")))
    return out


def tree(page: str) -> Node:
    """The elements of a page; children are nodes and strings."""
    root, stack, at = Node("#page"), [], 0
    stack.append(root)
    tags = ["#page"]

    def close(count: int) -> None:
        del stack[len(stack) - count :], tags[len(tags) - count :]

    def end(names: tuple[str, ...], walls) -> bool:
        for back, tag in enumerate(reversed(tags), 1):
            if tag in names:
                close(back)
                return True
            if tag in walls:
                return False
        return False

    def open_(tag: str, source: str = "") -> Node:
        node = Node(tag, source)
        stack[-1].children.append(node)
        if tag not in VOID and len(stack) < DEPTH:
            stack.append(node)
            tags.append(tag)
        return node

    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text:
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if not found:
            return root
        at, name = found.end(), found[2]
        if not name:
            continue
        if not found[4]:  # the page ends inside the tag
            return root
        name = name.lower()
        if found[1]:
            if name in VOID and name != "br":
                continue
            if name in ("br", "p") and name not in tags:
                open_(name)
                if name == "p" and tags[-1] == "p":
                    close(1)
            elif name in tags:
                end((name,), WALLS - {name} if name not in ("tr", "tbody", "thead", "tfoot", "table") else ("table",) if name != "table" else ())
            continue
        if foreign := "svg" in tags or "math" in tags:
            inner = next(t for t in reversed(tags) if t in ("svg", "math") or t in HOLDERS)
            foreign = inner in ("svg", "math")
            if foreign and name in BREAKOUT:
                end((inner,), ())
                foreign = False
        if (foreign or name in ("svg", "math")) and found[3].endswith("/") and all(m.end() < len(found[3]) for m in ATTRIBUTE.finditer(found[3])):
            stack[-1].children.append(Node(name, found[3]))
            continue
        if "head" in tags and name not in ("title", "meta", "link", "script", "style", "base", "template", "noscript", "head"):
            end(("head",), ())
        if name in CLOSES_P and "p" in tags:
            end(("p",), WALLS)
        if name in IMPLIED:
            end(*IMPLIED[name])
            if name in ("td", "th") and tags[-1] in ("table", "tbody", "thead", "tfoot"):
                open_("tr")
        if name in ("html", "body") and name in tags:
            continue
        node = open_(name, found[3])
        if name in RAW:
            finish = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw = page[at : finish.start() if finish else len(page)]
            node.children.append(unescape(raw) if name in ("textarea", "title") and "&" in raw else raw)
            at = finish.end() if finish else len(page)
            if stack[-1] is node:
                close(1)


def hiding_rules(root: Node) -> dict[str, str]:
    """Simple selectors of the page's style sheets, to their declarations that hide or keep space."""
    out: dict[str, str] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "style":
            for selectors, body in RULE.findall(COMMENT.sub("", "".join(node.children))):
                if NONE.search(body) or HIDDEN.search(body) or KEPT.search(body):
                    for s in selectors.lower().split(","):
                        if SIMPLE.match(s.strip()):
                            out[s.strip()] = out.get(s.strip(), "") + ";" + body.lower()
        todo += [c for c in node.children if isinstance(c, Node)]
    return out


class Layout:
    """Lines of text, with breaks held back until text follows."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = 0
        self.space = False

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words == " ":
            self.space = self.space or bool(self.line)
            return
        if (self.space or words[0] == " ") and self.line:
            self.line.append(" ")
        self.space = words[-1] == " "
        self.line.append(words.strip(" "))

    def kept(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.line.append(first)
        for more in rest:
            self.end(True)
            self.line.append(more)

    def end(self, always: bool = False) -> None:
        """End the line."""
        whole = "".join(self.line).rstrip(" ")
        if whole or always:
            if whole or not self.blank:
                if self.blank > 1 and self.lines:
                    self.lines.append("")
                self.blank = 0
            self.lines.append(whole)
        self.line, self.space = [], False

    def block(self, apart: bool = False) -> None:
        self.end()
        self.blank = max(self.blank, 2 if apart else 1)

    def add(self, lines: list[str]) -> None:
        for one in lines:
            self.line = [one]
            self.end(True)

    def done(self) -> list[str]:
        self.end()
        lines = self.lines
        while lines and not lines[-1]:
            lines.pop()
        start = next((i for i, x in enumerate(lines) if x), 0)
        return lines[start:]


def styled(node: Node, rules: dict[str, str]) -> str:
    a = node.attributes
    own = a.get("style", "").lower() if a else ""
    if rules:
        names = [node.tag, *(p + "." + c for c in a.get("class", "").lower().split() for p in ("", node.tag)), *(p + "#" + a["id"].lower() for p in ("", node.tag) if "id" in a)]
        own = ";".join([*(rules[n] for n in names if n in rules), own])
    return own


def number(value: str | None, otherwise: int, most: int) -> int:
    return min(most, max(1, int(value))) if value and value.strip().isdecimal() and len(value) < 9 else otherwise


def drawing(node: Node, out: Layout, rules: dict[str, str], unseen: bool) -> None:
    """The texts of an svg element, and what HTML it holds."""
    for child in node.children:
        if isinstance(child, str) or child.tag in UNDRAWN or child.tag in UNSEEN:
            continue
        a = child.attributes
        style = ";".join([*(f"{n}:{a[n].lower()}" for n in ("display", "visibility") if n in a), styled(child, rules)]) if a or rules else ""
        if NONE.search(style):
            continue
        hidden = True if HIDDEN.search(style) else False if SHOWN.search(style) else unseen
        if child.tag in ("text", "foreignobject"):
            out.text(" ")
            render(child, out, rules, bool(KEPT.search(style)), hidden)
            out.text(" ")
        else:
            drawing(child, out, rules, hidden)


def render(node: Node, out: Layout, rules: dict[str, str], pre: bool = False, unseen: bool = False) -> None:
    """Lay out a node's children."""
    counter = number(node.attributes.get("start"), 1, 10**8) if node.tag == "ol" else None
    children = node.children
    if node.tag == "details" and "open" not in node.attributes:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    elif node.tag == "select" and "multiple" not in node.attributes:
        options = [c for c in children if isinstance(c, Node)]
        children = [c for c in options if "selected" in c.attributes][:1] or options[:1]
    for child in children:
        if isinstance(child, str):
            if not unseen:
                out.kept(child) if pre else out.text(child)
            continue
        tag, a = child.tag, child.attributes
        if tag in UNSEEN or (a and ("hidden" in a or tag == "dialog" and "open" not in a)) or (tag == "dialog" and not a):
            continue
        style = styled(child, rules) if a or rules else ""
        hidden, space = unseen, pre
        if style:
            if NONE.search(style):
                continue
            hidden = True if HIDDEN.search(style) else False if SHOWN.search(style) else unseen
            space = bool(KEPT.search(style)) or pre
        if tag == "br":
            out.end(True)
        elif tag == "table":
            out.block(True)
            out.add(grid(child, rules, hidden))
            out.block(True)
        elif tag == "li":
            out.block()
            part = Layout()
            render(child, part, rules, space, hidden)
            if counter is None:
                mark = "- "
            else:
                counter = number(a.get("value"), counter, 10**8)
                mark, counter = f"{counter}. ", counter + 1
            lines = part.done()
            out.add([(mark if not i else " " * len(mark) if x else "") + x for i, x in enumerate(lines)])
            out.block()
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol") and node.tag == "li"
            out.block(tag in SPACED and not nested)
            if tag in ("pre", "xmp"):
                if child.children and isinstance(child.children[0], str):
                    child.children[0] = child.children[0].removeprefix("\n")
                render(child, out, rules, True, hidden)
            elif tag == "dd":
                part = Layout()
                render(child, part, rules, space, hidden)
                out.add(["  " + x if x else x for x in part.done()])
            else:
                render(child, out, rules, space, hidden)
            out.block(tag in SPACED and not nested)
        elif tag == "svg":
            drawing(child, out, rules, hidden)
        elif node.tag in APART and not pre:
            out.text(" ")
            render(child, out, rules, space, hidden)
            out.text(" ")
        elif tag in ("td", "th"):  # outside a table
            out.text(" ")
            render(child, out, rules, space, hidden)
            out.text(" ")
        else:
            if tag == "textarea":
                space = True
            render(child, out, rules, space, hidden)


def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Neighbours that end in the same row as one; sorted."""
    out: list[tuple[int, int, int]] = []
    for one in spans:
        if out and out[-1][2] == one[2] and one[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], one[1]), one[2])
        else:
            out.append(one)
    return out


def grid(table: Node, rules: dict[str, str], unseen: bool) -> list[str]:
    """A table's caption and rows, its cells in aligned columns."""
    out, rows, last, loose = Layout(), [], [], []
    todo = list(reversed(table.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip(" \t\n\r\f"):
                loose.append(child)
            continue
        style = styled(child, rules) if child.attributes or rules else ""
        if child.tag in UNSEEN or "hidden" in child.attributes or NONE.search(style):
            continue
        if child.tag in ("tbody", "thead"):
            todo += reversed(child.children)
        elif child.tag == "tfoot":
            last += [c for c in child.children if isinstance(c, Node) and c.tag == "tr"]
            todo += [c for c in reversed(child.children) if isinstance(c, str) or c.tag != "tr"]
        elif child.tag == "tr":
            rows.append(child)
        elif child.tag not in ("colgroup", "col"):
            loose.append(child)
    if loose:
        holder = Node("div")
        holder.children = loose
        render(holder, out, rules, False, unseen)
        out.block()
    cells: list[list[tuple[int, int, list[str]]]] = []
    spans: list[tuple[int, int, int]] = []  # columns from, to, and the row that is free again, of cells that reach down
    for y, row in enumerate(rows + last):
        spans = [s for s in spans if s[2] > y]
        x, line, nth, down = 0, [], 0, []
        for cell in row.children:
            if isinstance(cell, str):
                if not cell.strip(" \t\n\r\f"):
                    continue
                holder = Node("td")
                holder.children = [cell]
                cell = holder
            elif cell.tag in ("svg", "math"):
                holder = Node("td")
                holder.children = [cell]
                cell = holder
            style = styled(cell, rules) if cell.attributes or rules else ""
            if cell.tag in UNSEEN or "hidden" in cell.attributes or NONE.search(style):
                continue
            while nth < len(spans) and spans[nth][0] <= x:
                x = max(x, spans[nth][1])
                nth += 1
            part = Layout()
            render(cell, part, rules, bool(KEPT.search(style)), True if HIDDEN.search(style) else unseen and not SHOWN.search(style))
            wide, high = number(cell.attributes.get("colspan"), 1, 1000), number(cell.attributes.get("rowspan"), 1, len(rows) + len(last) - y)
            if high > 1:
                if down and down[-1][1:] == (x, y + min(high, 1000)):
                    down[-1] = (down[-1][0], x + wide, down[-1][2])
                else:
                    down.append((x, x + wide, y + min(high, 1000)))
            line.append((x, wide, part.done()))
            x += wide
        cells.append(line)
        if down:
            spans = joined(sorted(spans + down))
    widths: dict[int, int] = {}
    for line in cells:
        for x, wide, lines in line:
            if wide == 1:
                widths[x] = max([widths.get(x, 0), *(len(s) for s in lines if len(s) <= COLUMN)])
    starts, at = {}, 0
    for x in sorted({x for line in cells for x, _, _ in line} | set(widths)):  # only columns where something stands
        starts[x] = at
        at += widths[x] + 2 if x in widths else 0
    for line in cells:
        for i in range(max((len(lines) for _, _, lines in line), default=0)):
            text = ""
            for x, _, lines in line:
                if i < len(lines) and lines[i]:
                    text = text.ljust(starts[x]) if len(text) < starts[x] or not text else text + "  "
                    text += lines[i]
            out.add([text])
    return out.done()


def page_text(page: str | None) -> tuple[str, str]:
    """(title, visible text) of a page."""
    root = tree((page or "").replace("\0", "�"))
    title, todo = "", [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            title = SPACE.sub(" ", "".join(node.children)).strip(" ")
            break
        if node.tag not in ("svg", "body"):
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    out = Layout()
    render(root, out, hiding_rules(root))
    return title, "\n".join(out.done()).replace("\xa0", " ")


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2)
        found = [page_text(pages[i].as_py()) for i in range(batch.num_rows)]
        columns = [pa.array([f[k] for f in found], pa.string()) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "title", "text"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, title, text of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(texts, "page_id long, url string, title string, text string")


def op4_html(spark, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
