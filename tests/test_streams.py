"""Stateful operators on streams against the same over tables, and the live log."""

import random

import pytest
from conftest import SF
from pyspark.sql import functions as F

from folio.operators import registry_ops as ops
from folio.streaming import ingest as streams
from folio.streaming import live_log
from folio.streaming.ordered import suppressed_stream, task_history_stream

EVENTS = "event_id long, ts timestamp, key string, type string"
KINDS = ("TASK_STARTED", "TASK_PROGRESS", "TASK_FINISHED", "TASK_FAILED", "SCAN_STARTED")


def events(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, 1_000_000 + rng.randrange(4_000), rng.choice("aaabcd"), rng.choice(KINDS)) for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, t long, key string, type string").select("event_id", F.timestamp_seconds("t").alias("ts"), "key", "type")


@pytest.fixture
def replay(spark, tmp_path):
    """Rows in files of 500 seconds of event time each, one a batch, not in order inside; then one row from far in the future."""

    def run(rows, plan):
        base = str(tmp_path / "in")
        for k in range(8):
            rows.where((F.unix_timestamp("ts") >= 1_000_000 + 500 * k) & (F.unix_timestamp("ts") < 1_000_500 + 500 * k)).coalesce(1).write.mode("append").parquet(base)
        last = spark.createDataFrame([(-1, "end", "TASK_STARTED")], "event_id long, key string, type string").withColumn("ts", F.timestamp_seconds(F.lit(2_000_000)))
        last.select("event_id", "ts", "key", "type").coalesce(1).write.mode("append").parquet(base)
        source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(base)
        out = str(tmp_path / "out")
        query = plan(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.parquet(out), query

    return run


def test_suppression_on_a_stream_equals_the_table(spark, replay):
    rows = events(spark)
    out, query = replay(rows, lambda s: suppressed_stream(s, 120, "10 seconds"))
    found = {(r["key"], r["shown_us"]) for r in out.where("key <> 'end'").collect()}
    plain = {(r["key"], r["us"]) for r in ops.suppressed(rows, 120).select("key", F.unix_micros("ts").alias("us")).collect()}
    assert found == plain and len(found) > 50
    progress = [p for p in query.recentProgress if p["stateOperators"]]
    assert len(progress) >= 8 and progress[-1]["stateOperators"][0]["numRowsTotal"] <= 1  # what could suppress nothing any more is gone


def test_task_history_on_a_stream_equals_the_table(spark, replay):
    rows = events(spark, seed=3).withColumnRenamed("key", "task")
    out, query = replay(rows.withColumnRenamed("task", "key"), lambda s: task_history_stream(s.withColumnRenamed("key", "task"), "10 seconds"))
    found = {(r["event_id"], r["task"], r["state"], r["at_us"], r["valid"]) for r in out.where("event_id >= 0").collect()}
    plain = {(r["event_id"], r["task"], r["state"], r["us"], r["valid"]) for r in streams.task_history(rows).withColumn("us", F.unix_micros("ts")).collect()}
    assert found == plain and {v for *_, v in found} == {True, False}


def test_a_live_log_begins_once_and_tells_every_row_once(spark, tmp_path):
    base, out, check = (str(tmp_path / n) for n in ("log", "frames", "check"))
    kind = "event_id long, ts timestamp"

    def log(ids):
        spark.createDataFrame([(i, i) for i in ids], "event_id long, t long").select("event_id", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.mode("append").parquet(base)

    def follow():
        live_log.follow(spark.readStream.schema(kind).parquet(base), out, check, 3, F.col("event_id") % 100 == 0).awaitTermination()

    log(range(1, 6))
    log(range(6, 9))
    follow()
    log((50, 100))
    follow()
    follow()
    log((51,))
    follow()
    told = [(r["frame"], r["event_id"]) for r in live_log.frames(spark, out).orderBy("batch", "event_id").collect()]
    assert told == [("INIT", 6), ("INIT", 7), ("INIT", 8), ("LOG", 50), ("RELOAD", 100), ("LOG", 51)]
    assert [r["event_id"] for r in live_log.frames(spark, out, 1).collect()] == [51]


def test_a_log_batch_that_is_done_again_tells_nothing_twice(spark, tmp_path, monkeypatch):
    base, out, check = (str(tmp_path / n) for n in ("log", "frames", "check"))
    spark.range(5).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(base)
    source = lambda: spark.readStream.schema("event_id long, ts timestamp").parquet(base)
    live_log.follow(source(), out, check).awaitTermination()
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    live_log.follow(source(), out, check).awaitTermination()
    assert live_log.frames(spark, out).groupBy("frame").count().collect() == [("INIT", 5)]


def test_streamed_events_of_the_tables(spark):
    from folio.plans import catalog_store

    assert catalog_store.streamed_suppression(spark, SF).count() > 0
