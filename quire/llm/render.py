"""HTML extraction by layout-aware rendering.

A tolerant tree builder (implied end tags, void and raw-text elements) feeds a renderer that emits all
visible text much as a browser would place it: blocks on lines of their own, paragraphs with a blank line
between, markers and indents for lists, and table cells padded into aligned columns.  Visibility follows
``hidden``, ``display: none`` and ``visibility: hidden`` in style attributes and in simple style rules, closed
``details`` and elements that are never shown.

One scan of the pages, one page at a time; no shuffle.

Defined results: a null page has a null text, an empty one an empty text; broken markup never fails;
nesting beyond DEPTH levels is flattened with all its text kept; repeated rows give equal rows; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 120

# Element names by how they behave, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("script style title head template noscript iframe noembed noframes object audio video canvas datalist annotation annotation-xml".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
FOREIGN = frozenset("svg math".split())
SVG_UNSEEN = frozenset("defs desc metadata symbol clippath mask pattern marker lineargradient radialgradient filter".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr fieldset".split())
CLOSES_P = BLOCKS - frozenset("html body td th tr tbody thead tfoot caption option optgroup legend".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
SCOPE = frozenset("table td th caption html template".split())

TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>`]+)))?""")
SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)\Z")
DECLARED = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z|(?:^|\s)[^\s=\"']*/\Z")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    """The first of each attribute counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def build(source: str) -> Node:
    """The tree of a page."""
    root = Node("html", {})
    stack, at = [root], 0
    lowered = None

    def close(tags: set[str], bounds: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in tags:
                del stack[k:]
                if not tags - {"li", "dt", "dd", "p"}:
                    return
                close(tags, bounds)
                return

    while True:
        begin = source.find("<", at)
        m = TAG.match(source, begin) if begin >= 0 else None
        while begin >= 0 and m is None:
            begin = source.find("<", begin + 1)
            m = TAG.match(source, begin) if begin >= 0 else None
        text = source[at:begin] if begin >= 0 else source[at:]
        if text:
            if stack[-1].tag == "head" and text.strip(" \t\n\r\f"):
                stack.pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if begin < 0:
            return root
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag == "html":
            for k, v in attributes(m[3]).items():
                root.attrs.setdefault(k, v)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in CLOSES_P:
            close({"p"}, SCOPE | {"button"})
        node = Node(tag, attributes(m[3]) if m[3] and not m[3].isspace() else {})
        if len(stack) <= DEPTH:
            stack[-1].children.append(node)
        else:  # too deep: beside its parent, in order
            stack.pop()
            stack[-1].children.append(node)
        if (tag in FOREIGN or any(n.tag in FOREIGN for n in stack)) and SELF_CLOSED.search(m[3]):
            continue
        if tag in RAW:
            lowered = source.lower() if lowered is None else lowered
            end = lowered.find(f"</{tag}", at)
            inner = source[at : end if end >= 0 else len(source)]
            node.children.append(unescape(inner).removeprefix("\n") if tag == "textarea" else inner)
            if end < 0:
                return root
            at = (source.find(">", end) + 1) or len(source)
        elif tag not in VOID:
            stack.append(node)


def on_screen(prelude: str) -> bool:
    """Whether the rules inside a block with this prelude hold when a page is shown."""
    name, _, rest = prelude.partition(" ")
    if name.startswith("@media"):
        queries = [q.split() for q in prelude[len("@media") :].split(",")]
        media = [next((x for x in q if x != "only"), "") for q in queries]
        return any(x not in ("print", "speech") and not (x == "not" and q[1:2] in (["screen"], ["all"])) for x, q in zip(media, queries, strict=True))
    return name.startswith(("@supports", "@layer", "@container", "@scope"))


def rules(css: str) -> Iterator[tuple[str, str]]:
    """(selectors, declarations) of the rules that hold when a page is shown, in order."""
    css, at, held = COMMENT.sub(" ", css), 0, [True]
    for m in re.finditer(r"[{}]", css):
        before = css[at : m.start()]
        if m[0] == "{":
            at = m.end()
            prelude = before.rpartition(";")[2].strip()
            if prelude.startswith("@"):
                held.append(held[-1] and on_screen(prelude.lower()))
                continue
            stop = css.find("}", at)
            if held[-1]:
                yield prelude, css[at : stop if stop >= 0 else len(css)].lower()
            held.append(False)
        else:
            at = m.end()
            if len(held) > 1:
                held.pop()


def style_rules(node: Node) -> list[tuple[str, set[str], str, str]]:
    """(element, classes, id, declarations) of the simple rules in style elements that bear on visibility, the strongest last."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n.tag == "style":
            for selectors, body in rules(n.children[0] if n.children and isinstance(n.children[0], str) else ""):
                if DECLARED.search(body):
                    for s in selectors.split(","):
                        if (m := SIMPLE.match(s.strip())) and s.strip():
                            marks = re.findall(r"([.#])([\w-]+)", m[2])
                            out.append(((m[1] or "").lower(), {x for k, x in marks if k == "."}, next((x for k, x in marks if k == "#"), ""), body))
            continue
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return sorted(out, key=lambda r: (bool(r[2]), len(r[1]), bool(r[0])))


class Lines:
    """Text that is being laid out: lines, and what must stand before the next words."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False
        self.gap = 0  # blank lines that are due before the next line
        self.pending = ""  # a list marker that waits for its first line

    def words(self, text: str) -> None:
        squeezed = BLANKS.sub(" ", text)
        if squeezed == " " or not squeezed:
            self.space = self.space or bool(squeezed)
            return
        if self.now and (self.space or squeezed[0] == " "):
            self.now.append(" ")
        self.space = squeezed[-1] == " "
        self.now.append(squeezed.strip(" "))

    def exact(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in rest:
            self.end_line(keep=True)
            self.now.append(line)

    def end_line(self, keep: bool = False) -> None:
        if self.now or keep:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def apart(self) -> None:
        self.end_line()
        self.gap = 1

    def block(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.lines += lines

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def number(text: str | None, default: int, most: int = 1000) -> int:
    m = re.match(r"\s*([+-]?[0-9]{1,9})", text or "")
    return max(-most, min(most, int(m[1]))) if m else default


class Renderer:
    def __init__(self, root: Node) -> None:
        self.rules = style_rules(root)

    def shown(self, node: Node, visible: bool) -> bool | None:
        """None if the element takes no place; else whether its own text is visible."""
        attrs = node.attrs
        if node.tag in UNSEEN or (attrs and ("hidden" in attrs or (node.tag == "dialog" and "open" not in attrs))) or (node.tag == "dialog" and not attrs):
            return None
        styles = [body for tag, classes, ident, body in self.rules if tag in ("", node.tag) and (not ident or ident == attrs.get("id")) and (not classes or classes <= set(attrs.get("class", "").split()))]
        if "style" in attrs:
            styles.append(attrs["style"].lower())
        found: dict[str, tuple[bool, str]] = {}
        for body in styles:
            for name, value, important in DECLARED.findall(body):
                if important or not found.get(name, (False, ""))[0]:
                    found[name] = bool(important), value
        if found.get("display", (False, ""))[1] == "none":
            return None
        value = found.get("visibility", (False, ""))[1]
        return value == "visible" if value in ("hidden", "collapse", "visible") else visible

    def drawing(self, node: Node, out: Lines, visible: bool) -> None:
        """Of an svg element only its text elements and foreign objects show words."""
        for child in node.children:
            if isinstance(child, Node) and child.tag not in SVG_UNSEEN and (seen := self.shown(child, visible)) is not None:
                if child.tag in ("text", "foreignobject"):
                    out.space = True
                    self.inside(child, out, seen, False)
                    out.space = True
                else:
                    self.drawing(child, out, seen)

    def inside(self, node: Node, out: Lines, visible: bool, exact: bool) -> None:
        closed = node.tag == "details" and "open" not in node.attrs
        for child in node.children:
            if isinstance(child, str):
                if visible and not closed:
                    out.exact(child) if exact else out.words(child)
            elif not closed or child.tag == "summary":
                self.element(child, out, visible, exact)

    def lines(self, node: Node, visible: bool, exact: bool = False) -> list[str]:
        out = Lines()
        self.inside(node, out, visible, exact)
        return out.done()

    def element(self, node: Node, out: Lines, visible: bool, exact: bool) -> None:
        seen = self.shown(node, visible)
        if seen is None:
            return
        tag = node.tag
        if tag == "br":
            out.end_line(keep=not out.now)
        elif tag == "table":
            out.apart()
            out.block(self.table(node, seen))
            out.apart()
        elif tag == "svg":
            self.drawing(node, out, seen)
        elif tag == "textarea":
            self.inside(node, out, seen, True)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.items(node, out, seen, exact)
        elif tag == "blockquote":
            out.apart()
            out.block([f"    {line}".rstrip() for line in self.lines(node, seen, exact)])
            out.apart()
        elif tag == "dd":
            out.end_line()
            out.block([f"    {line}".rstrip() for line in self.lines(node, seen, exact)])
        elif tag in BLOCKS:
            out.apart() if tag in SPACED else out.end_line()
            if tag == "pre" and node.children and isinstance(node.children[0], str):
                node.children[0] = node.children[0].removeprefix("\n")
            self.inside(node, out, seen, exact or tag == "pre")
            out.apart() if tag in SPACED else out.end_line()
        else:
            self.inside(node, out, seen, exact)

    def items(self, node: Node, out: Lines, visible: bool, exact: bool) -> None:
        """A list: its items with markers, their further lines indented to the text of the first."""
        out.apart() if not getattr(out, "in_item", False) else out.end_line()
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li"]
        step = -1 if "reversed" in node.attrs else 1
        count = number(node.attrs.get("start"), len(items) if step < 0 else 1, 10**9)
        for child in node.children:
            if isinstance(child, str):
                if visible:
                    out.words(child)
                continue
            if child.tag != "li":
                self.element(child, out, visible, exact)
                continue
            seen = self.shown(child, visible)
            if node.tag == "ol":
                count = number(child.attrs.get("value"), count, 10**9)
            mark = f"{count}. " if node.tag == "ol" else "- "
            count += step
            if seen is None:
                continue
            own = Lines()
            own.in_item = True
            self.inside(child, own, seen, exact)
            lines = own.done()
            if lines:
                out.block([mark + lines[0], *((" " * len(mark) + line).rstrip() for line in lines[1:])])
        out.apart() if not getattr(out, "in_item", False) else out.end_line()

    def table(self, node: Node, visible: bool) -> list[str]:
        """Cells padded to the widths of their columns; a caption stands above."""
        above, rows = [], []

        def gather(parent: Node, seen: bool) -> None:
            for child in parent.children:
                if isinstance(child, str):
                    if seen and child.strip(" \t\n\r\f"):
                        above.append(BLANKS.sub(" ", child).strip())
                    continue
                inner = self.shown(child, seen)
                if inner is None or child.tag in ("col", "colgroup"):
                    continue
                if child.tag in ("tbody", "thead", "tfoot", "form"):
                    gather(child, inner)
                elif child.tag == "tr":
                    cells = []
                    for c in child.children:
                        if isinstance(c, str):
                            if inner and c.strip(" \t\n\r\f"):
                                above.append(BLANKS.sub(" ", c).strip())
                        elif (own := self.shown(c, inner)) is not None:
                            cells.append((c, self.lines(c, own) if c.tag in ("td", "th") else self.around(c, own)))
                    rows.append(cells)
                elif child.tag in ("td", "th"):
                    rows.append([(child, self.lines(child, inner))])
                else:
                    above.extend(self.around(child, inner))

        gather(node, visible)
        grid: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines)
        held: dict[int, int] = {}  # rows for which a column is still taken from above
        for cells in rows:
            line, column, fresh = [], 0, {}
            for cell, lines in cells:
                while held.get(column, 0) > 0:
                    column += 1
                span = max(1, number(cell.attrs.get("colspan"), 1))
                down = max(1, number(cell.attrs.get("rowspan"), 1, 65534))
                line.append((column, span, lines))
                if down > 1:
                    fresh |= {column + k: down - 1 for k in range(span)}
                column += span
            held = {c: n - 1 for c, n in held.items() if n > 1} | fresh
            grid.append(line)
        widths: dict[int, int] = {}
        for line in grid:
            for column, span, lines in line:
                if span == 1:
                    widths[column] = max(widths.get(column, 0), *map(len, lines or [""]))
        for line in grid:
            for column, span, lines in line:
                if span > 1:  # the last of its columns takes what the others leave
                    have = sum(widths.get(column + k, 0) for k in range(span)) + 2 * (span - 1)
                    lack = max(map(len, lines or [""])) - have
                    if lack > 0:
                        widths[column + span - 1] = widths.get(column + span - 1, 0) + lack
        columns = sorted(widths)
        start, x = {}, 0
        for c in columns:
            start[c] = x
            x += widths[c] + (2 if widths[c] else 0)
        out = []
        for line in grid:
            for k in range(max((len(lines) for _, _, lines in line), default=0)):
                text = ""
                for column, _, lines in line:
                    if k < len(lines) and lines[k]:
                        text = text.ljust(start.get(column, x)) if len(text) <= start.get(column, x) else f"{text}  "
                        text += lines[k]
                out.append(text.rstrip())
        return [line for a in above for line in a.split("\n")] + [line for line in out if line]

    def around(self, node: Node, visible: bool) -> list[str]:
        out = Lines()
        self.element(node, out, visible, False)
        return out.done()


def render(source: str) -> str:
    """The visible text of a page."""
    root = build(source)
    return "\n".join(Renderer(root).lines(root, True)).strip("\n").replace("\xa0", " ")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text, n_lines, n_chars) of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = [None if h is None else render(h) for h in part.column(1).to_pylist()]
                lines = [None if t is None else t.count("\n") + bool(t) for t in texts]
                chars = [None if t is None else len(t) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(chars, pa.int64())], [id_col, "text", "n_lines", "n_chars"])

    return pages.select(id_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, text string, n_lines long, n_chars long")
