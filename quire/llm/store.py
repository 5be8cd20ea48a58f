"""Tables between the phases of an operator, and fixed-size bitmaps of keys."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.scratch import scratch

BITMAP_BITS = 24
SIEVE_SHIFTS = (23, 29, 35)  # above the bits that choose a word
BATCH_ROWS = 1_000


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """While a job runs, hand Python at most ``rows`` rows at once: Arrow's buffers are outside the heap of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Tables:
    """Parquet tables of one run of an operator; writing one cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, owner: str) -> None:
        self.spark, self.root = spark, f"{scratch(spark)}/{owner}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more, and let go of the shuffle files of queries that are over.

        Spark deletes a shuffle's files when the driver has collected its plan as garbage; a driver with memory to spare does so rarely.
        """
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        gc.collect()
        jvm.System.gc()


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, lengthened until no frame has a column of that name in upper or lower case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bitmap of the hashes in the single column of ``keys``: 2**bits bits whatever the row count.

    Spark builds it (at most 2**(bits - 6) words reach the driver).  A clear bit proves absence; a set
    one may be chance, so an exact join follows.  Full, it lets everything through and loses nothing.
    """
    column = F.col(keys.columns[0])
    at = column.bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.where(column.isNotNull())
        .select(F.shiftright(at, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast({keys.columns[0]} & 63 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def present(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the bitmap."""
    at = hashes & np.uint64(len(words) * 64 - 1)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sieve(keys: DataFrame, bits: int) -> np.ndarray:
    """Like ``bitmap``, but each key sets three bits of one word, so fewer others get through; keys are even and have 43 bits or more."""
    name = keys.columns[0]
    words = (
        keys.where(F.col(name).isNotNull())
        .select(
            F.expr(f"cast(shiftright({name}, 1) & {(1 << (bits - 6)) - 1} as int)").alias("word"),
            F.expr(" | ".join(f"shiftleft(1L, cast(shiftright({name}, {k}) & 63 as int))" for k in SIEVE_SHIFTS)).alias("bit"),
        )
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bit"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy().view(np.uint64)
    return out


def sifted(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (uint64) may be in the sieve."""
    found = words[hashes >> np.uint64(1) & np.uint64(len(words) - 1)]
    out = np.ones(len(hashes), bool)
    for k in SIEVE_SHIFTS:
        out &= found >> (hashes >> np.uint64(k) & np.uint64(63)) & np.uint64(1) == 1
    return out
