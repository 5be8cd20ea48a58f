"""Quality rules: repetition coverage.

Rolling hashes of several n-gram lengths, all in numpy over whole Arrow batches, measure how many
characters of a text lie inside n-grams that occur twice or more in it, and inside repeated lines.
One narrow pass, no shuffle: the plan is scan -> mapInArrow.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rules;
a text of any length is measured whole; repeated rows are measured alike; an empty table gives an
empty table.  Extra columns pass through ``keep_good`` untouched and are ignored by ``measure``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.text import SPACE, ngrams, parts, per_row, repeated, salted, span_hashes, spans

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BASE_WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits in percent of a text's word characters, and of its words for symbols."""

    min_words: int = 10
    repeat_words: int = 20
    # largest share of characters inside repeated n-grams, by n: one boilerplate line said twice in a short text may stay
    covered: tuple[tuple[int, int], ...] = ((5, 25), (7, 22), (10, 20))
    line_chars: int = 25
    symbols: int = 30


def columns(rules: Rules) -> str:
    """The measures: ``dup_<n>gram_chars`` are characters inside n-grams that occur twice or more."""
    grams = "".join(f", dup_{n}gram_chars long" for n, _ in sorted(rules.covered))
    return f"n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars long{grams}"


def duplicate_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: lines with a word that equal an earlier line, and their characters outside white space."""
    rows = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    # a row's first line starts at its offset and its last line ends at the next; empty rows give empty lines
    filled = ends > starts
    starts, ends = starts[filled], ends[filled]
    ink = (~SPACE[data]) & ((data & 0xC0) != 0x80)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(ink, out=sums[1:])
    chars = sums[ends] - sums[starts]
    starts, ends, chars = (x[chars > 0] for x in (starts, ends, chars))
    owner = np.searchsorted(offsets, starts, "right") - 1
    keys = salted(span_hashes(data, starts, ends), owner)
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return np.bincount(owner[again], minlength=rows), np.bincount(owner[again], chars[again], rows).astype(np.int64)


def measure_part(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict[str, np.ndarray]:
    rows = len(offsets) - 1
    inside = ~SPACE[data]
    lead = inside & ((data & 0xC0) != 0x80)
    starts, ends, owner = spans(inside, offsets)
    hashes = span_hashes(data, starts, ends)
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=sums[1:])
    chars = sums[ends] - sums[starts]
    out = {
        "n_words": np.bincount(owner, minlength=rows),
        "word_chars": sums[offsets[1:]] - sums[offsets[:-1]],
        "n_symbols": per_row(SYMBOLS[data], offsets),
    }
    out["n_dup_lines"], out["dup_line_chars"] = duplicate_lines(data, offsets)
    for n in sorted({BASE_WINDOW, *(n for n, _ in rules.covered)}):
        at, keys = ngrams(hashes, owner, n)
        at = at[repeated(salted(keys, owner[at]))]
        change = np.zeros(len(hashes) + 1, np.int64)
        change[at] += 1
        change[at + n] -= 1
        held = np.cumsum(change[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = np.bincount(owner[held], minlength=rows)
        if n in dict(rules.covered):
            out[f"dup_{n}gram_chars"] = np.bincount(owner[held], chars[held], rows).astype(np.int64)
    out["base_failed"] = (out["n_words"] < rules.min_words) | (100 * out["n_repeat_words"] > rules.repeat_words * out["n_words"])
    bad = out["base_failed"] | (100 * out["dup_line_chars"] > rules.line_chars * out["word_chars"])
    bad |= 100 * out["n_symbols"] > rules.symbols * out["n_words"]
    for n, limit in rules.covered:
        bad |= 100 * out[f"dup_{n}gram_chars"] > limit * out["word_chars"]
    out["kept"] = ~bad
    return out


def measured(column: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    found = [measure_part(data, offsets, rules) for _, _, data, offsets in parts(column)]
    if not found:
        return measure_part(np.zeros(0, np.uint8), np.zeros(1, np.int64), rules)
    return {k: np.concatenate([x[k] for x in found]) for k in found[0]}


def measure(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: its id, the counts, ``base_failed`` and the verdict ``kept``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in columns(rules).split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = measured(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k]) for k in names)], [id_col, *names])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {columns(rules)}")


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that pass, with all their columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(measured(batch.column(at), rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
