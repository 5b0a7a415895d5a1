"""Layout-aware text of HTML pages.

A small tree builder reads tags with quoted attributes, comments and raw-text elements, supplies the end tags that HTML
lets authors leave out, and ignores stray ones. The end tag of a formatting element doesn't end the blocks inside it.
The renderer leaves out what a browser doesn't show and emits everything else. Not shown are scripts, styles, the head,
closed dialogs, all but the summary of closed details, of SVG and MathML titles, descriptions, definitions and
annotations, and what `hidden`, a `style` attribute or a rule of the page's style elements takes away; visibility is
inherited, so a visible element inside a hidden one is shown. Of rules those count whose selectors are a tag, classes
and ids of one element; rules with combinators, attributes or states, and at-rules, are not read. Blocks stand on
lines of their own with blank lines between paragraphs, list items behind bullets or numbers (start, value, reversed,
type) with indentation, preformatted text as it stands, table cells in aligned columns (cells that would begin beyond
column ALIGNED of a line follow two spaces after the one before), with their spans over columns and rows, and the values
of buttons and text fields where they are.

Defined results: null and empty html give empty text; broken markup is read as far as possible and never fails;
unclosed comments and scripts run to the end of the page; very deep nesting needs no recursion, and the time grows in
proportion to the page, for which an end tag of a formatting element is carried into CARRIED open blocks, as in browsers;
repeated rows give equal texts; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

_TAG = re.compile(
    r"<!--.*?(?:-->|--!>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>?",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\r\n\f]+")
_STYLE = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_SHEET = re.compile(r"<style\b[^>]*>(.*?)(?:</style|\Z)", re.I | re.S)
_BRACE = re.compile(r"[{}]")
_SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript plaintext".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist defs symbol desc metadata annotation annotation-xml area base link meta param source track progress meter rp".split())
#: What an open head may hold; any other tag, and text, ends it.
HEAD = frozenset("head title style script noscript template base basefont bgsound link meta".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul xmp plaintext caption".split()
)
#: Blocks with a blank line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr fieldset listing xmp".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
#: A start tag closes these open elements, up to the nearest of the scope.
CLOSES = {
    "li": ({"li"}, LISTS | {"table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Blocks that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: Elements beyond which an end tag doesn't reach.
WALLS = frozenset(("td", "th", "table", "html", "caption", "template"))
#: Elements whose end tag leaves blocks inside them open; without anything that may hide them they have no effect.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Elements that the end tag of another kind of element inside them doesn't reach beyond.
SPECIAL = BLOCK | WALLS | frozenset("button select object marquee applet".split())
#: Types of input whose value is shown.
FIELDS = frozenset("button submit reset text search email url tel number date time month week datetime-local".split())


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "opened")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent, self.opened = tag, attrs or {}, [], parent, 0


class Rules:
    """The rules of style sheets that set display or visibility, by the tag, class or id of their selector."""

    def __init__(self):
        self.by: dict[str, list[tuple]] = {}
        self.n = 0

    def read(self, sheet: str) -> None:
        sheet, at = _CSS_COMMENT.sub(" ", sheet), 0
        while m := _BRACE.search(sheet, at):
            head, at, depth = sheet[at : m.start()].rpartition(";")[2].strip(), m.end(), 1
            start = at
            if m[0] == "}":
                continue
            while depth and (m := _BRACE.search(sheet, at)):
                depth, at = depth + (1 if m[0] == "{" else -1), m.end()
            body = sheet[start : m.start() if m else len(sheet)]
            if not m:
                at = len(sheet)
            if head.startswith("@") or not (found := _STYLE.findall(body)):
                continue
            for one in head.split(","):
                if (one := one.strip()) and (own := _SELECTOR.fullmatch(one)):
                    tag, rest = (own[1] or "*").lower(), re.findall(r"[.#][\w-]+", own[2])
                    ids, classes = {x[1:] for x in rest if x[0] == "#"}, {x[1:] for x in rest if x[0] == "."}
                    key = rest[-1] if rest else tag
                    self.n += 1
                    weight = (sum(x[0] == "#" for x in rest), sum(x[0] == "." for x in rest), tag != "*", self.n)
                    self.by.setdefault(key, []).append((tag, ids, classes, weight, found))

    def keys(self, tag: str, attrs: dict[str, str]) -> list[str]:
        """The keys under which rules for such an element may stand."""
        own_id, classes = attrs.get("id"), attrs.get("class", "").split()
        return [k for k in ("*", tag, *([f"#{own_id}"] if own_id else []), *(f".{c}" for c in dict.fromkeys(classes))) if k in self.by]

    def style(self, node: Node) -> tuple[str | None, str | None]:
        """The declared display and visibility of an element, by importance, place, weight and order."""
        attrs, best = node.attrs, {}
        inline = attrs.get("style")
        found = [((0, 1, 0, 0, 0, k), x) for k, x in enumerate(_STYLE.findall(inline))] if inline else []
        if self.by:
            own_id, own = {attrs.get("id")}, set(attrs.get("class", "").split())
            for key in self.keys(node.tag, attrs):
                for tag, ids, classes, weight, said in self.by[key]:
                    if tag in ("*", node.tag) and ids <= own_id and classes <= own:
                        found += [((0, 0, *weight), x) for x in said]
        for place, (name, value, important) in found:
            place = (bool(important), *place[1:])
            if name.lower() not in best or place >= best[name.lower()][0]:
                best[name.lower()] = (place, value.lower())
        return tuple(best[name][1] if name in best else None for name in ("display", "visibility"))


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(source):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


#: Open elements inside a formatting element that its end tag is carried into, as the HTML standard has it for blocks; it
#: then stays open inside the last of them. Formatting elements between it and a block that stay around the block, also by
#: the standard. Room between the numbers of two open elements, for those that are carried there.
CARRIED, AROUND, ROOM = 8, 3, 1 << 20


class Open:
    """The open elements by serial number from the root on, and those of each tag, so that nothing is searched for or moved."""

    def __init__(self, root: Node):
        self.open: dict[int, Node] = {}
        self.before: dict[int, int] = {}
        self.after: dict[int, int] = {0: 0}
        self.where: dict[str, list[int]] = {}
        self.special: list[int] = []
        self.serial = self.tail = 0
        self.push(root)

    @property
    def top(self) -> Node:
        return self.open[self.tail]

    def push(self, node: Node) -> None:
        self.serial += ROOM
        if node.tag in SPECIAL:
            self.special.append(self.serial)
        self._link(node, self.serial, self.tail, 0)
        self.tail = self.serial

    def insert(self, node: Node, left: int) -> None:
        """Opens a formatting element right inside the open element number left, around those that are open in it."""
        right = self.after[left]
        if right - left > 1:
            self._link(node, (left + right) // 2, left, right)
            self.before[right] = node.opened

    def _link(self, node: Node, serial: int, left: int, right: int) -> None:
        insort(self.where.setdefault(node.tag, []), serial)
        self.open[serial], node.opened = node, serial
        self.before[serial], self.after[left], self.after[serial] = left, serial, right

    def drop(self, serial: int) -> None:
        """Takes one element, which is not special or is the last, out of the open ones."""
        node = self.open.pop(serial)
        node.opened = 0
        own = self.where[node.tag]
        del own[bisect_left(own, serial)]
        if node.tag in SPECIAL:
            self.special.pop()
        left, right = self.before.pop(serial), self.after.pop(serial)
        self.after[left] = right
        if right:
            self.before[right] = left
        else:
            self.tail = left

    def cut(self, k: int) -> None:
        """Closes the elements from number k on."""
        while self.tail >= k:
            self.drop(self.tail)

    def last(self, tags) -> int:
        return max((own[-1] for t in tags if (own := self.where.get(t))), default=0)

    def close(self, tags, scope) -> bool:
        """Closes the innermost element of tags, unless one of scope is further in."""
        k = self.last(tags)
        if k > ROOM and k >= self.last(scope):
            self.cut(k)
            return True
        return False

    def end_formatting(self, tag: str) -> None:
        """Ends a formatting element; the blocks open inside it go on behind it, what they hold so far stays formatted."""
        k = self.last((tag,))
        if k <= ROOM or k < self.last(WALLS):
            return
        if k > self.special[-1]:
            self.cut(k)
            return
        inner = bisect_right(self.special, k)
        block, ended = self.open[self.special[inner]], self.open[k]
        between, serial = [], self.after[k]
        while serial != self.special[inner]:
            between.append(serial)
            serial = self.after[serial]
        kept = [x for x in between if self.open[x].tag in FORMATTING][-AROUND:]
        for serial in (k, *(x for x in between if x not in kept)):
            self.drop(serial)
        block.parent.children.pop()
        parent = ended.parent
        for serial in kept:  # what else stands around the block stays around it
            node = self.open[serial]
            copy = self.open[serial] = Node(node.tag, node.attrs, parent)
            copy.opened, node.opened = serial, 0
            parent.children.append(copy)
            parent = copy
        block.parent = parent
        parent.children.append(block)
        reached = block
        for step in range(1, CARRIED + 1):
            inside = reached.children[-1] if reached.children and isinstance(reached.children[-1], Node) and reached.children[-1].opened else None
            own = reached.children if inside is None or step == CARRIED else reached.children[:-1]
            if own:
                copy = Node(ended.tag, ended.attrs, reached)
                copy.children, reached.children = own, [copy, *reached.children[len(own) :]]
                for node in own:
                    if isinstance(node, Node):
                        node.parent = copy
                if inside is not None and step == CARRIED:
                    self.insert(copy, reached.opened)
            if inside is None:
                break
            reached = inside


def build(html: str) -> tuple[Node, Rules]:
    """The tree of a page, text children being strings, and the rules of its style elements."""
    root, rules, at, n = Node("html"), Rules(), 0, len(html)
    opened = Open(root)
    close = opened.close
    ahead = Rules()
    for sheet in _SHEET.findall(html):
        ahead.read(sheet)

    def leave_head() -> None:
        if opened.top.tag == "head":
            opened.cut(opened.tail)

    def add(text: str) -> None:
        if opened.top.tag == "head" and text.strip(" \t\r\n\f"):
            leave_head()
        opened.top.children.append(text)

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(unescape(html[at:]))
            break
        m = _TAG.match(html, lt)
        if not m:  # a lone "<"
            add(unescape(html[at : lt + 1]))
            at = lt + 1
            continue
        if lt > at:
            add(unescape(html[at:lt]))
        at = m.end()
        if end := m["end"]:
            end = end.lower()
            if end == "br":
                leave_head()
                opened.top.children.append(Node("br"))
            elif end in FORMATTING:
                opened.end_formatting(end)
            elif end in SPECIAL or end in ("head", "svg", "math"):
                if end not in ("html", "body"):
                    walls = WALLS - {end}
                    if end in ("table", "tr", "tbody", "thead", "tfoot"):
                        walls = walls - {"td", "th", "caption"}
                    close((end,), walls)
            elif (k := opened.last((end,))) > opened.special[-1]:
                opened.cut(k)
            continue
        tag = m["start"] or m["open"]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag, source = tag.lower(), m["attrs"] or m["rest"] or ""
        attrs = attributes(source) if source.strip(" \n\t\r/") else {}
        if tag == "html":
            root.attrs |= attrs
            continue
        if tag in ENDS_P:
            close(("p",), WALLS | {"button", "object"})
        if tag in CLOSES:
            while close(*CLOSES[tag]):  # a row ends its open cells too
                pass
        if tag not in HEAD:
            leave_head()
        if tag in FORMATTING and not ("hidden" in attrs or "style" in attrs or ahead.by and ahead.keys(tag, attrs)):
            continue
        node = Node(tag, attrs, opened.top)
        opened.top.children.append(node)
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at) if tag != "plaintext" else None
            inner = html[at : stop.start() if stop else n]
            node.children.append(unescape(inner) if tag in ("title", "textarea") else inner)
            if tag == "style" and re.fullmatch(r"\s*(all|screen)?\s*", attrs.get("media", ""), re.I):
                rules.read(inner)
            at = stop.start() if stop else n
            if stop:
                at = html.find(">", at) + 1 or n
        elif tag not in VOID and not (source.endswith("/") and tag in ("svg", "math", "path")):
            opened.push(node)
    return root, rules


def shown(node: Node, display: str | None) -> bool:
    """Whether an element has boxes at all; visibility is inherited and can be turned on again inside."""
    if node.tag in UNSEEN or display == "none":
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return display is not None or not ("hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs)


def parts_of(node: Node) -> list:
    """The children that are shown; of closed details the first summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
    return node.children


class Page:
    """Lines of text with collapsed white space."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.indents: list[str] = []
        self.mark: str | None = None  # a bullet that waits for its first line

    def text(self, text: str) -> None:
        first, last = text[0] in " \t\r\n\f", text[-1] in " \t\r\n\f"
        words = _SPACE.sub(" ", text).strip(" ")
        if not words:
            self.space = self.space or bool(self.line)
            return
        if (first or self.space) and self.line:
            self.line.append(" ")
        self.line.append(words)
        self.space = last

    def end(self) -> None:
        """Ends the open line, if it has text."""
        self.space = False
        if self.line:
            self.emit("".join(self.line))
            self.line = []

    def emit(self, line: str) -> None:
        indent = "".join(self.indents)
        if self.mark is not None:
            indent = "".join(self.indents[:-1]) + self.mark
            self.mark = None
        self.lines.append((indent + line).rstrip())

    def blank(self) -> None:
        self.end()
        if self.lines and self.lines[-1] and self.mark is None:
            self.lines.append("")

    def verbatim(self, text: str) -> None:
        for k, part in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.emit("".join(self.line))
                self.line = []
            if part:
                self.line.append(part.expandtabs(8))

    def result(self) -> str:
        self.end()
        return "\n".join(self.lines).strip("\n")


#: Column of a line up to which table cells are aligned; cells that would begin beyond it follow two spaces after the one before.
ALIGNED = 2000
#: Most rows that a cell spans; as many as HTML allows, and what a span of 0, up to the end of the row group, means.
MOST_ROWS, MOST_COLUMNS = 65534, 1000


def aligned(rows: list[list[tuple[str, int, int]]], starts: set[int] = frozenset()) -> list[str]:
    """Lines of a table whose rows are (text, columns spanned, rows spanned); rows in starts begin a row group."""
    placed, taken, end = [], {}, 0
    for k, row in enumerate(rows):
        if k in starts:
            taken = {}
        at, cells, spanned = 0, [], {}
        for text, span, down in row:
            while at in taken:
                at += 1
            cells.append((at, text.split("\n"), span))
            if down > 1:
                spanned |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        taken = {c: left - 1 for c, left in taken.items() if left > 1} | spanned
        end = max(end, at)
        if any(text for text, _, _ in row):
            placed.append(cells)
    width: dict[int, int] = {}
    for cells in placed:
        for at, lines, span in cells:
            if span == 1:
                width[at] = max(width.get(at, 0), max(map(len, lines)))
    wide = sorted((span, at, max(map(len, lines))) for cells in placed for at, lines, span in cells if span > 1 and at + span < end)
    for span, at, most in wide:  # what spans several columns widens the last of them
        if (short := most - sum(width.get(c, 0) for c in range(at, at + span)) - 2 * (span - 1)) > 0:
            width[at + span - 1] = width.get(at + span - 1, 0) + short
    edge = [0]
    for c in range(end):
        edge.append(edge[-1] + width.get(c, 0) + 2)
    out = []
    for cells in placed:
        for k in range(max(len(lines) for _, lines, _ in cells)):
            line = ""
            for at, lines, _ in cells:
                part = lines[k] if k < len(lines) else ""
                if at:
                    line = line.ljust(min(edge[at] - 2, ALIGNED)) + "  "
                line += part
            out.append(line.rstrip())
    return out


def _number(value: str | None, default: int, least: int, most: int) -> int:
    try:
        return max(least, min(most, int(value or "")))
    except ValueError:
        return default


def numeral(n: int, kind: str) -> str:
    """n as a list's type has it: letters (a, A), Roman numerals (i, I) or digits."""
    out = ""
    if kind in ("a", "A") and n > 0:
        while n:
            n, k = divmod(n - 1, 26)
            out = chr(97 + k) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        for value, letters in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out += letters * (n // value)
            n %= value
    return (out.upper() if kind.isupper() else out) or str(n)


def render(root: Node, rules: Rules) -> str:
    """The visible text of a tree."""
    page = Page()
    pages, tables, lists, pre = [], [], [], 0
    stack: list[tuple] = [("in", root, True)]
    while stack:
        step, node, seen = stack.pop()
        if isinstance(node, str):
            if node and seen:
                page.verbatim(node) if pre else page.text(node)
            continue
        tag = node.tag
        if step == "in":
            display, visibility = rules.style(node) if node.attrs or rules.by else (None, None)
            if not shown(node, display):
                continue
            if visibility in ("hidden", "collapse", "visible", "initial"):
                seen = visibility in ("visible", "initial")
            if tag == "br":
                page.emit("".join(page.line)) if page.line or pre else page.blank()
                page.line, page.space = [], False
                continue
            if tag == "img":
                if seen and (alt := node.attrs.get("alt")):
                    page.text(f" {alt} ")
                continue
            if tag == "input":
                kind = node.attrs.get("type", "text").lower()
                value = node.attrs.get("alt" if kind == "image" else "value") or (node.attrs.get("placeholder") if kind in FIELDS else "")
                if seen and value and (kind in FIELDS or kind == "image"):
                    page.text(f" {value} ")
                continue
            if tag in ("td", "th") and tables:
                pages.append(page)
                page = Page()
            elif tag in BLOCK:
                page.blank() if tag in SPACED and not (tag in LISTS and lists) else page.end()
            if tag == "table":
                tables.append(([], set()))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("tbody", "thead", "tfoot") and tables:
                tables[-1][1].add(len(tables[-1][0]))
            elif tag == "text":  # labels of a drawing stand apart
                page.text(" ")
            elif tag in LISTS:
                by = -1 if "reversed" in node.attrs else 1
                first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if by < 0 else 1
                lists.append([_number(node.attrs.get("start"), first, -(10**9), 10**9), by, node.attrs.get("type", "1")] if tag == "ol" else None)
            elif tag == "li":
                mark = "- "
                if lists and (now := lists[-1]) is not None:
                    now[0] = _number(node.attrs.get("value"), now[0], -(10**9), 10**9)
                    mark = f"{numeral(now[0], node.attrs.get('type', now[2]))}. "
                    now[0] += now[1]
                page.indents.append(" " * len(mark))
                page.mark = mark if seen else None
            elif tag in ("blockquote", "dd"):
                page.indents.append("    ")
            elif tag in ("pre", "listing", "xmp", "textarea", "plaintext"):
                pre += 1
            stack.append(("out", node, seen))
            stack.extend(("in", child, seen) for child in reversed(parts_of(node)))
            continue
        if tag in ("pre", "listing", "xmp", "textarea", "plaintext"):
            pre -= 1
        if tag in ("td", "th") and tables:
            cell = page.result()
            page = pages.pop()
            rows = tables[-1][0]
            if not rows:
                rows.append([])
            down = MOST_ROWS if node.attrs.get("rowspan", "").strip() == "0" else _number(node.attrs.get("rowspan"), 1, 1, MOST_ROWS)
            rows[-1].append((cell, _number(node.attrs.get("colspan"), 1, 1, MOST_COLUMNS), down))
            continue
        if tag in ("tbody", "thead", "tfoot") and tables:
            tables[-1][1].add(len(tables[-1][0]))
        elif tag == "text":
            page.text(" ")
        if tag == "table":
            page.end()
            for line in aligned(*tables.pop()):
                page.emit(line)
        if tag in BLOCK:
            page.end()
        if tag in LISTS:
            lists.pop()
        elif tag in ("li", "blockquote", "dd"):
            page.mark = None
            page.indents.pop()
        if tag in SPACED and not (tag in LISTS and lists):
            page.blank()
    return page.result()


def page_text(html: str | None) -> str:
    return render(*build(html)) if html else ""


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row."""

    def make():
        return lambda batch: [(i, url, page_text(html)) for i, url, html in batch]

    return map_rows(pages.select(F.col("page_id").cast("long"), "url", "html"), make, "page_id long, url string, text string", 256)
