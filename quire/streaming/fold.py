"""Read state as a stream: the same fold as the batch one, kept up to date as events arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.jobs import final_states, joined_states, partial_states
from quire.plans.views import Views
from quire.sources.scratch import scratch


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events folder as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/event[s].parquet")


class StateLog:
    """States as the changes of each batch: a batch writes a row for each user and post in it, and nothing else.

    Partial states join in any order, so neither the stream nor a batch has to know what was there before: no state is held between batches, and
    reading joins the rows of all batches.  A batch that is run again writes its rows again in the same place.  ``compact`` joins what has come so far
    into one table; readers use the newest that is whole, and the batches after it.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _numbers(self, folder: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/{n}/_SUCCESS")))

    def add(self, actions: DataFrame, batch: int) -> None:
        partial_states(actions).write.mode("overwrite").parquet(f"{self.root}/batches/{batch}")

    def partials(self) -> DataFrame:
        upto = self._numbers("joined")[-1:]
        folders = [f"joined/{n}" for n in upto] + [f"batches/{n}" for n in self._numbers("batches") if not upto or n > upto[0]]
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def read(self) -> DataFrame:
        """The state of every user and post that any event so far was about."""
        return final_states(joined_states(self.partials()))

    def compact(self) -> None:
        newest = self._numbers("batches")[-1]
        joined_states(self.partials()).write.mode("overwrite").parquet(f"{self.root}/joined/{newest}")


def follow(spark: SparkSession, sf_dir: str, root: str) -> StateLog:
    """Take in all events that are there and were not taken in before."""
    n_docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    actions = event_stream(spark, sf_dir).select(
        "user_id", ((F.col("user_id") * 31 + F.col("event_id") % 20) % n_docs).alias("entry_id"), "event_type", F.col("ts").alias("stamp"), "event_id"
    )
    log = StateLog(spark, f"{root}/states")
    query = actions.writeStream.option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).foreachBatch(log.add).start()
    query.awaitTermination()
    return log


def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fold everything that is there and return the table of states."""
    return follow(spark, sf_dir, f"{scratch(spark)}/stream-{uuid.uuid4().hex}").read()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Reading sessions by user (an addition: the source has no windows): works on batch and stream alike."""
    marked = events.withWatermark("stamp", late) if events.isStreaming else events
    grouped = marked.groupBy("user_id", F.session_window("stamp", gap).alias("w"))
    return grouped.agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def views_sessions(v: Views) -> DataFrame:
    return sessions(v.raw("events").select("user_id", F.col("ts").cast("timestamp").alias("stamp"))).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "events")
