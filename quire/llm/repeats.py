"""Hashes that stand more than once in a table, found by shuffling four bytes of each."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEWEST_BUCKET_BITS, LOW_BITS = 12, 32  # of a hash its bucket's, and those after them that are compared before the exact join
BUCKET_BYTES = 64 << 20  # of text for which there is one bucket
HELD = 1 << 21  # hashes that are sorted at once


def bucket_bits(keyed: DataFrame) -> int:
    """Bits of a bucket's number: buckets follow the bytes of text, so that one stays small."""
    size = keyed.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(LOW_BITS - 1, max(FEWEST_BUCKET_BITS, int(np.ceil(np.log2(max(1.0, size / BUCKET_BYTES))))))


def short(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - LOW_BITS - bits)


def twice(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, marked: bool = False) -> DataFrame:
    """(token) of the gram keys that ``keys`` gives more than once over all rows.

    If ``marked``, the lowest bit is not part of a key but a mark, and one of a key's must have it.

    Keys are sorted in runs and shuffled in buckets, four bytes a key, at most two of a key from a run.
    """
    low = LOW_BITS

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        run = np.sort(np.concatenate(held))
        again = np.zeros(len(run), bool)
        again[2:] = run[2:] == run[:-2]
        run = run[~again]
        cuts = np.searchsorted(run, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low))
        blobs = pa.Array.from_buffers(pa.binary(), 1 << bits, [None, pa.py_buffer((4 * cuts).astype(np.int32)), pa.py_buffer(run.astype(np.uint32))])
        batch = pa.RecordBatch.from_arrays([pa.array(np.arange(1 << bits, dtype=np.int32)), blobs], ["bucket", "packed"])
        return batch.filter(pa.array(np.diff(cuts) > 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for some in keys(batch):
                held.append(some)
                n += len(some)
                if n >= HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def several(table: pa.Table) -> pa.Table:
        run = np.sort(np.frombuffer(b"".join(table["packed"].to_pylist()), np.uint32))
        if marked:
            token = run & ~np.uint32(1)
            last = np.append(token[1:] != token[:-1], True)
            run = token[last & (run & np.uint32(1) == 1) & np.append(False, token[1:] == token[:-1])].astype(np.int64)
        else:
            run = np.unique(run[1:][run[1:] == run[:-1]]).astype(np.int64)
        return pa.table({"token": pa.array(run + (table["bucket"][0].as_py() << low), pa.int64())})

    return df.mapInArrow(pack, "bucket int, packed binary").groupBy("bucket").applyInArrow(several, "token long")
