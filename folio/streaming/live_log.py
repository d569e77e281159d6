"""A log that is followed live: the newest rows so far at once, then every further row once, across restarts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.operators.registry_ops import recent
from folio.sources import storage

FRAMES = "frame string, event_id long, ts timestamp, batch long"


def follow(log: DataFrame, frames_path: str, checkpoint: str, n: int = 300, reload: Column | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append frames of a stream ``log(event_id, ts)`` to ``frames_path``: ``INIT`` for the newest ``n`` rows of the first batch, then ``LOG`` a row.

    The first batch is what the log holds when it is first followed, so its source must not bound a batch's files.
    Rows for which ``reload`` holds give ``RELOAD`` frames instead, which tell clients to load anew. A batch's
    frames lie under the stream's id and the batch's number: one that is done again after a restart replaces
    its own, so that no row is told twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        follower = json.loads(storage.read_text(spark, f"{checkpoint}/metadata"))["id"]
        kind = F.lit("LOG") if reload is None else F.when(reload, "RELOAD").otherwise("LOG")
        rows = recent(batch, n).withColumn("frame", F.lit("INIT")) if number == 0 else batch.withColumn("frame", kind)
        rows.select("frame", "event_id", "ts").write.mode("overwrite").parquet(f"{frames_path}/follower={follower}/batch={number}")

    return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def frames(spark: SparkSession, frames_path: str, after: int = -1) -> DataFrame:
    """Frames of batches after a number: what a client that has seen that one still has to be told."""
    return spark.read.schema(f"{FRAMES}, follower string").parquet(frames_path).where(F.col("batch") > after).drop("follower")
