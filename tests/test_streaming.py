"""The stream gives what the batch gives, whatever the order of arrival."""

from pyspark.sql import functions as F

from quire.operators.jobs import fold_entry_state
from quire.plans.views import Views
from quire.streaming.fold import follow, sessions, stream_fold

FOLDER = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    v = Views(spark, FOLDER)
    assert sorted(stream_fold(spark, FOLDER).collect()) == sorted(fold_entry_state(v.actions).collect())


def test_any_arrival_order(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.orderBy(F.desc("ts")).repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    spark.read.parquet(f"{FOLDER}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(stream_fold(spark, str(tmp_path)).collect()) == sorted(stream_fold(spark, FOLDER).collect())


def test_triggers_restart_and_compaction(spark, tmp_path):
    """Five files, a trigger each, then a restart with three more: every batch writes a row a user and post in it, and nothing else."""
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    spark.read.parquet(f"{FOLDER}/documents.parquet").write.parquet(str(tmp_path / "documents.parquet"))
    target = str(tmp_path / "events.parquet")
    events.where("event_id % 8 < 5").repartition(5).write.parquet(target)
    log = follow(spark, str(tmp_path), str(tmp_path / "out"))
    assert log._numbers("batches") == [0, 1, 2, 3, 4]
    log.compact()
    events.where("event_id % 8 >= 5").repartition(3).write.mode("append").parquet(target)
    log = follow(spark, str(tmp_path), str(tmp_path / "out"))
    assert log._numbers("batches") == [*range(8)] and log._numbers("joined") == [4]
    v = Views(spark, str(tmp_path))
    assert sorted(log.read().collect()) == sorted(fold_entry_state(v.actions).collect())
    for n in range(8):
        rows = spark.read.parquet(str(tmp_path / f"out/states/batches/{n}"))
        assert 0 < rows.count() == rows.select("user_id", "entry_id").distinct().count() <= events.count() / 4
    before = sorted(log.read().collect())
    last = spark.read.parquet(str(tmp_path / "out/states/batches/7")).count()
    log.add(v.actions.where("event_id < 40"), 8)
    log.add(v.actions.where("false"), 8)  # a batch that is run again takes the place of what it wrote
    assert last and sorted(log.read().collect()) == before


def test_sessions_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("stamp"))
    events.orderBy("stamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {tuple(r) for r in spark.table("sessions_out").collect()}
    assert closed and closed <= {tuple(r) for r in sessions(events).collect()}
