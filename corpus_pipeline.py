"""A corpus pipeline of five stages: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is written as
Parquet in the shared folder and read again, so a lost executor costs one stage at most.  All but the
last return the columns of documents.

In all stages: extra columns stay, whatever their names; texts are handled whole, of any length; an empty table gives an empty
table; a row without an id is a row like any other; rows that repeat an id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm import decontaminate, jaccard, mixing, repetition, shards
from quire.llm.store import Tables

N_SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: null and empty texts among them, as they have fewer than ten words.

    Each row is judged by its own text, so repeated rows go or stay together.
    """
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, a Jaccard similarity of 0.8 or more.

    It is the one with the smallest id (null after all, ties by a hash of the text); of rows with equal id and text one stays;
    texts without words stand alone.
    """
    return jaccard.keep_first(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go, by their text alone; null and empty texts overlap nothing and stay."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source has an equal share of the text; documents are repeated or left out by Poisson counts.

    A null source is one of its own, a source without any text stays as it is, rows of equal ids in a source are drawn alike.
    """
    return mixing.mix(docs).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each record, by its id alone: rows that repeat an id, or have none, share a shard; a column ``shard`` is replaced."""
    return shards.assign(docs, [1.0] * N_SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mixing", mixture),
    ("sharding", sharding),
]

# Rolling hashes, spaced seeds and adaptive prefixes have no SQL form; tests compare with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir), f"stage-{k}")
        if k > 1:
            tables.drop(f"stage-{k - 2}")
    return docs
