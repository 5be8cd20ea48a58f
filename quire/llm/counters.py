"""Counts over a whole corpus in a table of fixed size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.store import small_batches

PIECES, SHARES = 64, 64
NAMES = ["piece", "share", "counts"]


def row(piece: int, share: int, counts: np.ndarray) -> pa.RecordBatch:
    """One piece, in the smallest whole numbers that hold its counts."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if counts.max() <= np.iinfo(t).max)
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([share], pa.int32()), pa.array([counts.astype(kind).tobytes()], pa.binary())], NAMES)


def counters(df: DataFrame, indices: Callable[[pa.RecordBatch], Iterable[np.ndarray]], size: int) -> np.ndarray:
    """How often ``indices`` names each number below ``size``, over all rows.

    Each task counts in a table of its own and sends it in PIECES pieces.  Equal pieces are added as they stream in, on two
    levels: first those of a share of the tasks, then the sums.  What is shuffled follows the number of tasks, so the input; the
    driver gets one table of ``size`` numbers.
    """
    width = -(-size // PIECES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width * PIECES, np.uint64)
        share = TaskContext.get().partitionId() % SHARES
        for batch in batches:
            for at in indices(batch):
                numbers, times = np.unique(at, return_counts=True)
                total[numbers] += times.astype(np.uint64)
        if total.any():
            for k in range(PIECES):
                piece = total[k * width : (k + 1) * width]
                yield row(k, share, piece)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, share, blob in zip(*(batch.column(c).to_pylist() for c in (0, 1)), batch.column(2), strict=True):
                part = np.frombuffer(blob.as_buffer(), f"u{len(blob.as_buffer()) // width}")
                at = piece, share
                sums[at] = sums[at] + part if at in sums else part.astype(np.uint64)
        for (piece, share), x in sums.items():
            yield row(piece, share, x)

    schema = "piece int, share int, counts binary"
    with small_batches(df.sparkSession):
        parts = df.mapInArrow(count, schema).repartition("piece", "share").mapInArrow(add, schema).withColumn("share", F.lit(0))
        found = parts.repartition("piece").mapInArrow(add, schema).toArrow()
    blobs = {piece: np.frombuffer(blob.as_buffer(), f"u{len(blob.as_buffer()) // width}") for piece, blob in zip(found["piece"].to_pylist(), found["counts"], strict=True)}
    out = np.zeros(width * PIECES, max((x.dtype for x in blobs.values()), key=lambda t: t.itemsize, default=np.dtype(np.uint8)))
    for piece, x in blobs.items():
        out[piece * width : (piece + 1) * width] = x
    return out[:size]
