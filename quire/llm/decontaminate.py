"""Benchmark decontamination: spaced-seed hashing.

A fixed mask looks at five of up to eight consecutive tokens and ignores the positions between, so a
changed token there does not hide a match.  Masked hashes of the training texts join those of the
benchmark items; around each hit the tokens are aligned, and an overlap counts where a window of
WINDOW tokens has at most ALLOWED of them different.  The masks find every such overlap: for each way
to place that many changes in a window of 8 to 13 tokens some mask fits (a test tries them all).

Scale: training hashes pass a fixed-size bitmap of the benchmark's hashes inside numpy, so only likely
hits leave the scan; the exact join and the check follow in Spark, whose own size limit decides on a broadcast
and whose skew join splits a passage that many documents hold.  A hit carries its 25 tokens, so no
text is shuffled.

Defined results: an item of fewer than MIN_TOKENS tokens is never reported (too short to tell from
chance), one of fewer than WINDOW tokens must be covered whole, with changes in proportion; null and
empty texts match nothing; repeated documents are each reported, repeated items once an item id; empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import Tables, bitmap, present, unused
from quire.llm.text import STEP, mix, parts, tokens

WINDOW, ALLOWED, MIN_TOKENS = 13, 3, 8
MASKS = ((0, 1, 2, 4, 5), (0, 1, 4, 6, 7), (0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 2, 3, 6))
REACH = WINDOW - 1
AROUND = 2 * REACH + 1


def needed(n: int) -> int:
    """Equal tokens that an overlap with an item of n tokens needs."""
    return WINDOW - ALLOWED if n >= WINDOW else n - ALLOWED * n // WINDOW


def seeds(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, masked hash) of every mask at every position where it fits in its row."""
    at, out = [], []
    for k, mask in enumerate(MASKS):
        count = len(hashes) - mask[-1]
        if count <= 0:
            continue
        fits = np.flatnonzero(rows[:count] == rows[mask[-1] :])
        rolled = np.full(len(fits), k + 1, np.uint64)
        for m in mask:
            rolled = rolled * STEP + hashes[fits + m]
        at.append(fits)
        out.append(mix(rolled))
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(out)


def around(hashes: np.ndarray, rows: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """The AROUND tokens with each position in their middle, as 32-bit hashes; ``outside`` beyond the row."""
    where = at[:, None] + np.arange(-REACH, REACH + 1)
    inside = (where >= 0) & (where < len(hashes))
    where = np.where(inside, where, 0)
    inside &= rows[where] == rows[at][:, None]
    return np.where(inside, (hashes >> np.uint64(32)).astype(np.uint32)[where] | np.uint32(2), np.uint32(outside))


def _blobs(wide: np.ndarray) -> pa.Array:
    width = wide.shape[1] * wide.itemsize
    offsets = pa.array(np.arange(len(wide) + 1, dtype=np.int32) * width).buffers()[1]
    return pa.Array.from_buffers(pa.binary(), len(wide), [None, offsets, pa.py_buffer(np.ascontiguousarray(wide))])


def seed_table(df: DataFrame, id_col: str, text_col: str, *, items: bool, filter_by: np.ndarray | None = None) -> DataFrame:
    """(id, h, ctx): the seeds of all texts; of items also ``need``; of documents only those in the bitmap."""
    kind = df.schema[id_col].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(filter_by) if filter_by is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, last, data, offsets in parts(pc.utf8_lower(batch.column(1).cast(pa.large_string()))):
                hashes, rows = tokens(data, offsets)
                at, h = seeds(hashes, rows)
                if shared is not None:
                    some = present(shared.value, h)
                    at, h = at[some], h[some]
                need = None
                if items:
                    n = np.bincount(rows, minlength=last - first)[rows[at]]
                    some = n >= MIN_TOKENS
                    at, h, n = at[some], h[some], n[some]
                    need = pa.array(np.where(n >= WINDOW, WINDOW - ALLOWED, n - ALLOWED * n // WINDOW).astype(np.int32))
                for a in range(0, max(len(at), 1), 50_000):
                    cut = slice(a, a + 50_000)
                    columns = [
                        ids.slice(first, last - first).take(pa.array(rows[at[cut]])),
                        pa.array(h[cut].view(np.int64)),
                        _blobs(around(hashes, rows, at[cut], 0 if items else 1)),
                    ]
                    names = [id_col, "h", "item_ctx" if items else "ctx"]
                    if items:
                        columns.append(need[cut])
                        names.append("need")
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind}, h long, " + ("item_ctx binary, need int" if items else "ctx binary")
    return df.select(id_col, text_col).mapInArrow(run, schema)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The most equal tokens in any window of WINDOW that holds the middle position, by row."""
    equal = np.zeros((len(a), AROUND + 1), np.int16)
    np.cumsum(a == b, axis=1, out=equal[:, 1:])
    return (equal[:, WINDOW:] - equal[:, : AROUND + 1 - WINDOW]).max(axis=1)


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row a (document, item) that overlap: ``matched`` tokens of the best window, and ``n_hits``."""
    # written, so that Spark knows its true size when it chooses the join
    tables = Tables(docs.sparkSession, "seeds")
    item_seeds = seed_table(items.select(F.col(item_col).alias("item"), text_col), "item", text_col, items=True)
    item_seeds = tables.keep(item_seeds.withColumn("c", F.xxhash64("h", "item_ctx", "need")), "items")
    # what several items hold is compared once
    distinct = tables.keep(item_seeds.groupBy("c").agg(*[F.any_value(c).alias(c) for c in ("h", "item_ctx", "need")]), "contexts")
    words = bitmap(distinct.select("h"))
    doc_seeds = seed_table(docs.select(F.col(id_col).alias("doc"), text_col), "doc", text_col, items=False, filter_by=words)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, AROUND) for c in ("ctx", "item_ctx"))
            matched = overlap(a, b)
            some = pa.array(matched >= batch.column("need").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("c"), pa.array(matched.astype(np.int32))], ["doc", "c", "matched"]).filter(some)

    hits = doc_seeds.join(distinct, "h").select("doc", "c", "ctx", "item_ctx", "need")
    found = hits.mapInArrow(check, f"doc {docs.schema[id_col].dataType.simpleString()}, c long, matched int")
    found = found.groupBy("doc", "c").agg(F.max("matched").alias("matched"), F.count("*").alias("n"))
    named = found.join(item_seeds.groupBy("item", "c").agg(F.count("*").alias("times")), "c")
    return named.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_col)).agg(F.max("matched").alias("matched"), F.sum(F.col("n") * F.col("times")).alias("n_hits"))


def remove(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that overlap no item, with all their columns.  The text alone decides, whatever the id."""
    key = unused("h", docs)
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    hit = overlaps(keyed, items, key, text_col=text_col).select(key).distinct()
    return keyed.join(hit, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
