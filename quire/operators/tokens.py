"""Pages as an ordered table of tokens: an element opens, text, an element closes.

A small helper in one scan finds tags and closes what a new one ends, so that every element has one row where it opens and one where it
closes, and numbers both; everything else about a page is said by columns, joins and windows over this table.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template xmp svg".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: an open element of these names ends where the key begins, if it is the innermost
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr")}

OPEN, TEXT, CLOSE = 0, 1, 2
ROWS = 4000
NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
REST = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")

ATTRS = "array<struct<name: string, value: string>>"
SCHEMA = f"place int, kind int, node int, parent int, tag string, attrs {ATTRS}, alone boolean, above array<struct<node: int, tag: string>>, level int, text string"
TYPES = {
    "place": pa.int32(), "kind": pa.int32(), "node": pa.int32(), "parent": pa.int32(), "tag": pa.string(),
    "attrs": pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), "alone": pa.bool_(),
    "above": pa.list_(pa.struct([("node", pa.int32()), ("tag", pa.string())])), "level": pa.int32(), "text": pa.string(),
}


class Outline:
    """The tokens of a page in order, as (kind, element, text), and its elements."""

    def __init__(self, page: str, raw: frozenset[str] = RAW) -> None:
        self.tags: list[str] = []
        self.attrs: list[dict[str, str]] = []
        self.up: list[int] = []
        self.tokens: list[tuple[int, int, str]] = []
        self.open: list[int] = []
        self.read(page, raw)
        self.close(0)

    def close(self, k: int) -> None:
        self.tokens += [(CLOSE, e, "") for e in reversed(self.open[k:])]
        del self.open[k:]

    def begin(self, tag: str, source: str) -> None:
        if tag in BLOCK and self.open and self.tags[self.open[-1]] == "p":
            self.close(-1)
        for ended in (ENDED_BY.get(tag, ()),) if tag != "tr" else (("td", "th"), ("tr",)):
            if self.open and self.tags[self.open[-1]] in ended:
                self.close(-1)
        attrs: dict[str, str] = {}
        for name, *values in ATTRIBUTE.findall(source):
            attrs.setdefault(name.lower(), references.unescape("".join(values)))
        self.up.append(self.open[-1] if self.open else -1)
        self.tags.append(tag)
        self.attrs.append(attrs)
        self.open.append(len(self.tags) - 1)
        self.tokens.append((OPEN, self.open[-1], ""))
        if tag in VOID or source.rstrip().endswith("/"):
            self.close(-1)

    def end(self, tag: str) -> None:
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.tags[self.open[k]] == tag), None)
        if k is not None:
            self.close(k)

    def say(self, text: str) -> None:
        if text:
            self.tokens.append((TEXT, self.open[-1] if self.open else -1, text))

    def read(self, page: str, raw: frozenset[str]) -> None:
        lower, at = page.lower(), 0
        while at < len(page):
            lt = page.find("<", at)
            if lt < 0:
                return self.say(page[at:])
            self.say(page[at:lt])
            stop = -1
            if page.startswith("<!--", lt):
                stop, size = page.find("-->", lt + 4), 3
            elif page[lt + 1 : lt + 2] in ("!", "?") and lt + 1 < len(page):
                stop, size = page.find(">", lt), 1
            else:
                name = NAME.match(page, lt)
                rest = REST.match(page, name.end()) if name else None
                if not rest:
                    self.say("<")
                    at = lt + 1
                    continue
                tag, at = name[2].lower(), rest.end()
                if name[1]:
                    self.end(tag)
                elif tag in raw:
                    stop = lower.find(f"</{tag}", at)
                    stop = page.find(">", stop) if stop >= 0 else -1
                    at = stop + 1 if stop >= 0 else len(page)
                else:
                    self.begin(tag, rest[0][:-1])
                continue
            at = stop + size if stop >= 0 else len(page)

    def rows(self, out: callable, in_body: bool = True) -> Iterator[tuple]:
        """Rows of all or only of the first body element's contents (if there is one), without the elements that ``out`` names and all in them."""
        body = self.tags.index("body") if in_body and "body" in self.tags else -1
        inside, skipped, place, level = body < 0, -1, 0, [0] * len(self.tags)
        alone = [True] * len(self.tags)
        for kind, e, text in self.tokens:
            if e == body and body >= 0:
                inside = kind == OPEN if kind != TEXT else inside
                if kind != TEXT:
                    continue
            if not inside:
                continue
            if skipped >= 0:
                skipped = -1 if kind == CLOSE and e == skipped else skipped
                continue
            if kind == TEXT:
                yield place, kind, None, e, None, None, None, None, None, text
                place += 1
                continue
            up = self.up[e]
            if kind == OPEN:
                if out(self.tags[e], self.attrs[e]):
                    skipped = e
                    continue
                above, a = [], up
                while a >= 0 and len(above) < 5:
                    above.append({"node": a, "tag": self.tags[a]})
                    a = self.up[a]
                if up >= 0:
                    level[e] = level[up] + (self.tags[up] == "a")
                    alone[up] &= self.tags[e] not in BLOCK
                shown = [{"name": k, "value": v} for k, v in self.attrs[e].items()]
                yield place, kind, e, up, self.tags[e], shown, None, above, level[e], None
            else:
                shown = [{"name": k, "value": v} for k, v in self.attrs[e].items()] if self.tags[e] == "a" else None
                yield place, kind, e, up, self.tags[e], shown, alone[e], None, level[e], None
            place += 1


def tokens(pages: DataFrame, id_col: str, html_col: str, out: callable, raw: frozenset[str] = RAW, in_body: bool = True) -> DataFrame:
    """The tokens of all pages: (id, place, kind, node, parent, tag, attrs, alone, above, level, text).

    alone: no block stands right in the element (said where it closes).  above: the five elements around it.  level: the links around it.
    """
    kind = pages.schema[id_col].dataType.simpleString()

    def packed(keys: list, rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES.values(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *columns], ["id", *TYPES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for key, page in zip(batch.column(0), batch.column(1), strict=True):
                for row in Outline(page.as_py() or "", raw).rows(out, in_body):
                    keys.append(key.as_py())
                    rows.append(row)
                    if len(rows) == ROWS:
                        yield packed(keys, rows, batch.column(0).type)
                        keys, rows = [], []
            if rows:
                yield packed(keys, rows, batch.column(0).type)

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, {SCHEMA}")
