"""Sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a cost for a record from a hash of the record's key and the shard's number,
``-ln(u) / weight``, and the cheapest shard takes it.  Key and shard list alone decide, so one more
shard only takes records into itself, and a shard's share follows its weight.  All native columns.

``slots`` numbers the records of each shard without gaps: records are cut into buckets by a hash of
the whole row, so that a shard of any size is numbered by many tasks; counts per bucket are summed, and a
row's slot is its bucket's offset plus its rank in the bucket.

Defined results: a null key is a key like any other (all its records share a shard); a null or empty
text has 0 bytes; repeated rows get the same shard and slots of their own; an empty table gives an
empty table; columns of the input named like a new column are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.store import unused

ROWS_PER_BUCKET = 20_000


def cost(key: Column, shard: Column, weight: Column) -> Column:
    """The cost of a shard for a key; the hash's upper 52 bits make a number inside (0, 1)."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("null")), shard.cast("string")).cast("binary"))
    drawn = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / float(1 << 52)) / weight


def cheapest(key: Column, weights: Sequence[float]) -> Column:
    """struct(cost, shard) of the shard that takes the key; of equal costs the lower number wins."""
    every = F.array(*[F.lit(float(w)) for w in weights])
    return F.array_min(F.transform(every, lambda w, i: F.struct(cost(key, i, w).alias("cost"), i.cast("int").alias("shard"))))


def assign(df: DataFrame, weights: Sequence[float], key: str = "doc_id", grown: float | None = None) -> DataFrame:
    """Add ``shard``, and ``grown_shard`` if one more shard of weight ``grown`` were there.  No shuffle."""
    if not weights or min(weights) <= 0 or (grown is not None and grown <= 0):
        raise ValueError("shard weights must be positive")
    taken = unused("taken", df)
    out = df.withColumn(taken, cheapest(F.col(key), weights)).withColumn("shard", F.col(f"{taken}.shard"))
    if grown is not None:
        new = cost(F.col(key), F.lit(len(weights)), F.lit(float(grown)))
        out = out.withColumn("grown_shard", F.when(new < F.col(f"{taken}.cost"), F.lit(len(weights))).otherwise(F.col("shard")))
    return out.drop(taken)


def slots(df: DataFrame, order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``slot``: 0, 1, ... within each shard, by bucket and then by ``order``.

    The number of buckets follows the row count, so a task numbers about ``rows_per_bucket`` rows.
    """
    buckets = max(1, df.count() // rows_per_bucket)
    bucket, before, rank = (unused(c, df) for c in ("bucket", "before", "rank"))
    rows = df.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    place = F.row_number().over(Window.partitionBy("shard", bucket).orderBy(*order))
    numbered = rows.withColumn(rank, place).join(offsets, ["shard", bucket]).withColumn("slot", F.col(before) + F.col(rank) - 1)
    return numbered.drop(bucket, rank, before)


def digest(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard, slot and size of every record under equal weights, without its text."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law")
    )
    placed = slots(assign(rows, [1.0] * n_shards, id_col, grown=1.0), [id_col, "size", "text_crc32"])
    return placed.select(id_col, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def write(df: DataFrame, path: str, rows_per_file: int = 1_000_000, order: Sequence[str] = ("doc_id",)) -> None:
    """Write one folder a shard, cut into files of about ``rows_per_file`` rows by a hash of the key."""
    files = max(1, df.count() // rows_per_file)
    cut = F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(files))
    df.repartition(F.col("shard"), cut).write.partitionBy("shard").parquet(path)
