"""Secret scans with one deterministic automaton for all rules.

A rule is a head, a class of bytes that its tail has, and the least length of the tail; it matches ``head tail+``.  The heads of all
rules, each with the first byte of its tail, are compiled into one minimal automaton (``automaton.py``), which reads every byte of every text
once.  After some bytes or pairs of bytes the automaton is in its first state whatever came before, so no head passes there: texts are
cut at these, and the pieces that are long enough to hold a head are read side by side, a byte of each at a time, by indexing the
arrays of the automaton.  A state in which a rule ends marks piece and rule; a marked piece is read again backwards for the starts of
its matches, and the text from these on for their ends.  Spans are leftmost, longest, without overlap for each rule; those with
too short a tail are dropped.

A null or empty text has no spans; texts are read whole, whatever their length; rows that repeat are scanned each; a null
id is an id like any other; an empty table gives an empty table; other columns stay, whatever their names (``found`` is lengthened if taken).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.automaton import Automaton, Pattern, backwards, compiled, either_case, shortest
from quire.llm.store import unused
from quire.llm.text import parts, spans

LANES = 24  # with fewer pieces left, they are read one by one
SPANS = "array<struct<kind: string, start: long, stop: long>>"


@dataclass(frozen=True)
class Rule:
    """``head`` then ``least`` or more bytes of ``tail`` (an empty tail: the head alone).

    counted: the least length is a part of the automaton, so that shorter runs mark nothing.  That may be said only of rules that find
    the same with ``{least,}`` as by dropping shorter matches: those where no match can begin inside a dropped one.
    """

    kind: str
    head: str
    tail: str = ""
    least: int = 1
    any_case: bool = False
    counted: bool = False

    @property
    def front(self) -> str:
        """The shortest beginnings of matches."""
        return self.head + (self.tail + (f"{{{self.least}}}" if self.counted else "") if self.tail else "")

    @property
    def whole(self) -> str:
        return self.front + (self.tail + "*" if self.tail else "")


# The formats of the keys.  The first three kinds are those that counts are made of.
BASE_KINDS = ("assign", "access", "hex")
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", 8, any_case=True),
    Rule("access", "AKIA", "[A-Z0-9]", 12),
    Rule("hex", "", "[0-9a-f]", 32, counted=True),
    Rule("github", "gh[oprsu]_", "[A-Za-z0-9]", 36),
    Rule("slack", "xox[abeprs]-", "[A-Za-z0-9-]", 10),
    Rule("google", "AIza", "[A-Za-z0-9_-]", 35),
    Rule("payment", "[rs]k_(live|test)_", "[A-Za-z0-9]", 16),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.", "[A-Za-z0-9_-]", 16),
    Rule("bearer", "Bearer\\x20+", "[A-Za-z0-9._~+/=-]", 20),
    Rule("private_key", "-----BEGIN\\x20([A-Z0-9]+\\x20)*PRIVATE\\x20KEY-----"),
    Rule("login", "://[A-Za-z0-9._%-]+:[A-Za-z0-9._%!*+-]+@"),
)


def tree(rule: Rule, text: str) -> tuple:
    made = Pattern(text).tree
    return either_case(made) if rule.any_case else made


class Scanner:
    """All rules as arrays; made once on the driver (its size depends on the rules alone) and sent to the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        trees = [tree(r, r.front) for r in rules]
        self.joint = compiled(trees, anywhere=True)
        self.starts = [compiled([backwards(t)], anywhere=True) for t in trees]
        self.whole = [compiled([tree(r, r.whole)], anywhere=False) for r in rules]
        self.heads = [compiled([tree(r, r.head)], anywhere=False) for r in rules]
        self.shortest = min(shortest(t) for t in trees)
        table = self.joint.table
        self.resets = (table == 0).all(0)
        # pairs of classes after which only the first state is possible
        after_first = [np.unique(table[:, c]) for c in range(table.shape[1])]
        self.pairs = np.array([(table[states] == 0).all(0) for states in after_first])

    @cached_property
    def flat(self) -> np.ndarray:
        return np.ascontiguousarray(self.joint.table).reshape(-1)

    def marked(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, start, stop, rules) of the pieces in which a match ends, rules as bits."""
        if len(data) < self.shortest:
            return
        codes = self.joint.classes[data]
        inside = ~self.resets[codes]
        inside[1:] &= ~self.pairs[codes[:-1], codes[1:]]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        inside[edges] = ~self.resets[codes[edges]]  # a pair does not pass from row to row
        begin, end, row = spans(inside, offsets)
        long = np.flatnonzero(end - begin >= self.shortest)
        size = (end - begin)[long]
        long = long[np.argsort(-size, kind="stable")]
        begin, end, row = begin[long], end[long], row[long]
        size = end - begin
        found, width = np.zeros(len(long), np.int64), self.joint.table.shape[1]
        state, at = np.zeros(len(long), np.int32), 0
        active = len(long)
        while active > LANES:
            state = self.flat[state[:active] * width + codes[begin[:active] + at]]
            ended = self.joint.ends[state]
            if ended.any():
                found[:active] |= ended
            at += 1
            active = int(np.searchsorted(-size, -at, "left"))
        table, ends = (self.listed, self.joint.final) if active else (None, None)
        for k in range(active):
            now, bits = int(state[k]), 0
            for code in codes[begin[k] + at : end[k]].tobytes():
                now = table[now][code]
                bits |= ends[now]
            found[k] |= bits
        for k in np.flatnonzero(found).tolist():
            yield int(row[k]), int(begin[k]), int(end[k]), int(found[k])

    @cached_property
    def listed(self) -> list[list[int]]:
        return self.joint.table.tolist()

    def matches(self, rule: int, text: bytes, pieces: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
        """Spans of a rule in a text, given the pieces that its matches begin in, in order."""
        done = 0
        for start, stop in pieces:
            for at in reversed(self.starts[rule].marks(text, start, stop)):
                if at < done:
                    continue
                done = self.whole[rule].ending(text, at, len(text))
                if not self.rules[rule].tail or done - self.heads[rule].ending(text, at, done) >= self.rules[rule].least:
                    yield at, done

    def find(self, column: pa.Array) -> list[list[tuple[str, int, int]]]:
        """(kind, start, stop) of all spans of each text, in code points, by start and then kind as listed."""
        out: list[list[tuple[str, int, int]]] = []
        for a, b, data, offsets in parts(column):
            pieces: dict[int, dict[int, list[tuple[int, int]]]] = {}
            for row, start, stop, bits in self.marked(data, offsets):
                for k in range(len(self.rules)):
                    if bits >> k & 1:
                        pieces.setdefault(row, {}).setdefault(k, []).append((start, stop))
            for row in range(b - a):
                if row not in pieces:
                    out.append([])
                    continue
                low, text = int(offsets[row]), data[offsets[row] : offsets[row + 1]]
                follow = np.flatnonzero((text & 0xC0) == 0x80)  # bytes that begin no code point
                place = lambda p, follow=follow: p - int(np.searchsorted(follow, p))
                got = [(s, k, e) for k, at in pieces[row].items() for s, e in self.matches(k, text.tobytes(), sorted((x - low, y - low) for x, y in at))]
                out.append([(self.rules[k].kind, place(s), place(e)) for s, k, e in sorted(got)])
        return out


def numbered(df: DataFrame) -> DataFrame:
    """The columns with plain names, so that any name (with dots, too) can go through Python and come back."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def find(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, column: str = "found") -> DataFrame:
    """The rows with their spans in one more column."""
    column = unused(column, docs)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    at = docs.columns.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[{"kind": k, "start": s, "stop": e} for k, s, e in x] for x in scanner.value.find(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], [*batch.schema.names, "found"])

    plain = numbered(docs)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, found {SPANS}").toDF(*docs.columns, column)


def listed(found: Column) -> Column:
    """kind:start:stop of each span, with commas between."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base spans by kind, their hash, all spans as text, and how many the other rules added."""
    found = find(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    spans_, base = F.col("found"), F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    counts = [F.size(F.expr(f"filter(found, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    added = (F.size(spans_) - F.size(base)).cast("long").alias("n_added")
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans_).alias("spans"), added)


def redact(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows with each stretch of secrets replaced by the kind of its first span in angle brackets; overlapping spans are one stretch."""
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(rules))
    at = docs.columns.index(text_col)

    def clean(text: str | None, found: list[tuple[str, int, int]]) -> str | None:
        if not found:
            return text
        out, done = [], 0
        for kind, a, b in found:
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            cleaned = [clean(t, f) for t, f in zip(texts.to_pylist(), scanner.value.find(texts), strict=True)]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(cleaned, pa.string()))

    plain = numbered(docs)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
