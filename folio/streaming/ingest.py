"""Streaming ingest: new documents are gated, deduplicated against the registry and appended, batch by batch.

The registry is a table in versions (``folio.sources.versions``) bucketed by checksum. A batch reads the checksums
of its own buckets, and its rows become visible in one commit that carries the stream's id and the batch's number:
scans with other checkpoints add to the same history, and a batch that is tried again adds nothing.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folio.functions.text import clean_text
from folio.operators.registry_ops import first_of_batch, skip_or_retry
from folio.operators.rules import LICENSE_RULES, Rule, first_rule
from folio.sources import storage, versions
from folio.streaming.lease import COOLDOWN, SECONDS, Lease, LeaseLost, ScanInProgress, Stopped, cooling, note_stop, request_stop, stop_requested

# The types of event that clients listen for.
EVENT_TYPES = (
    "TASK_STARTED", "TASK_PROGRESS", "TASK_FINISHED", "TASK_FAILED", "SCAN_STARTED", "FILE_PROGRESS", "FILE_COMPLETED", "FILE_FAILED",
    "SCAN_COMPLETED", "OLLAMA_DOWN", "REPAIR_STARTED", "REPAIR_COMPLETED", "CLEAR_STARTED", "CATEGORIES_UPDATED", "REGISTRY_UPDATED",
    "DECISIONS_UPDATED", "DOCUMENTS_UPDATED",
)


#: states of a task, and the event that leads to each
TASK_EVENTS = {"TASK_STARTED": "started", "TASK_PROGRESS": "progress", "TASK_FINISHED": "finished", "TASK_FAILED": "failed"}
#: states that may follow each; a task starts from idle
TASK_NEXT = {"idle": ("started",), "started": ("progress", "finished", "failed"), "progress": ("progress", "finished", "failed"), "finished": ("started",), "failed": ("started",)}


def triage(batch: DataFrame, known: DataFrame, rules: tuple[Rule, ...] = LICENSE_RULES, blocked: DataFrame | None = None) -> DataFrame:
    """Each incoming row with ``status`` and its place.

    SKIPPED (in the cache of blocked files with the same time and size), BLOCKED (no text), DUPLICATE (in
    the registry or the batch) or MOVED. Every row comes out once, null texts as BLOCKED.
    """
    columns = [c for c in batch.columns if c != "checksum"]
    rows = batch if "checksum" in batch.columns else batch.withColumn("checksum", F.sha2("raw_text", 256))
    if blocked is not None:
        rows = skip_or_retry(rows, blocked)
    rows = rows if "skip" in rows.columns else rows.withColumn("skip", F.lit(False))
    # a skipped file is not read, so no other one copies it
    rows = first_of_batch(rows.withColumn("checksum", F.when(~F.col("skip"), F.col("checksum"))))
    here = rows.select("checksum").where("checksum is not null").distinct()
    met = known.join(here, "checksum", "left_semi").distinct().withColumn("__known", F.lit(True))
    rows = rows.join(met, "checksum", "left")
    rule = first_rule(F.col("raw_text"), F.col("filename"), rules)
    bare = F.coalesce(clean_text(F.col("raw_text")), F.lit("")) == ""
    status = (
        F.when(F.col("skip"), "SKIPPED").when(bare, "BLOCKED").when(F.col("__known") | F.col("copy_of").isNotNull(), "DUPLICATE").otherwise("MOVED")
    )
    return rows.select(
        *columns, "checksum", status.alias("status"), F.coalesce(rule["category"], F.lit("other")).alias("rule_category"), F.coalesce(rule["subcategory"], F.lit("general")).alias("rule_subcategory")
    )


#: ingests that this process started: registry path to query and lease
_owned: dict[str, tuple[StreamingQuery, Lease]] = {}


def lease_path(registry_path: str) -> str:
    return f"{registry_path}/_lease"


def running(spark: SparkSession, registry_path: str) -> StreamingQuery | None:
    """The active ingest of this application into a registry, if there is one; ``lease.held`` tells of other ones."""
    return next((q for q in spark.streams.active if q.name == f"ingest {registry_path}"), None)


def abort(spark: SparkSession, registry_path: str, clock: Callable[[], float] = time.time) -> bool:
    """Ask the ingest into a registry to stop, whichever application runs it; what is left waits for the next one. False if none runs.

    One of this application is stopped at once, and a batch that it was at is done again by the next scan.
    """
    query = running(spark, registry_path)
    if query is None:
        return request_stop(spark, lease_path(registry_path), clock)
    query.stop()
    note_stop(spark, lease_path(registry_path), clock)
    _release(registry_path)
    return True


def _release(registry_path: str) -> None:
    if registry_path in _owned:
        _owned.pop(registry_path)[1].release()


def _keep_alive(query: StreamingQuery, lease: Lease, registry_path: str, every: float) -> None:
    """Renew the lease while a query runs, stop it on request, and give the lease back at its end."""

    def run() -> None:
        try:
            while True:
                try:
                    if query.awaitTermination(every):
                        break
                except Exception:  # it failed; whoever awaits it is told
                    break
                lease.check()
        except (LeaseLost, Stopped):
            query.stop()
        finally:
            if _owned.get(registry_path, (None,))[0] is query:
                _release(registry_path)

    threading.Thread(target=run, daemon=True, name=f"lease {registry_path}").start()


def ingest(
    source: DataFrame,
    registry_path: str,
    events_path: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_batch: Callable[[DataFrame, int], None] | None = None,
    blocked_path: str | None = None,
    lease_seconds: float = SECONDS,
) -> StreamingQuery:
    """Append what is new to ``registry_path``, and events to ``events_path``: each file's, and those of the scan and its task.

    ``registry_rows`` reads the registry. With ``blocked_path`` files that were blocked before are skipped as long
    as their time and size are the same (columns ``path``, ``mtime_ms``, ``size`` of the source), and newly blocked
    ones are added there. Events and blocked files of a batch lie under the stream's id and the batch's number, so
    one that is tried again replaces its own. A second ingest into a registry, by this or another application, is
    refused with ``ScanInProgress`` while one holds the lease. Before each batch (``maxFilesPerTrigger`` of the
    source bounds its files) a stop request ends the query with ``Stopped``. For a watcher see ``watch``.
    """
    session = source.sparkSession
    if running(session, registry_path) is not None:
        raise ScanInProgress(registry_path)
    _release(registry_path)  # of a query of ours that has ended
    lease = Lease(session, lease_path(registry_path), lease_seconds).acquire()

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if stop_requested(spark, lease.path, lease.fence):
            raise Stopped(registry_path)
        writer = json.loads(storage.read_text(spark, f"{checkpoint}/metadata"))["id"]
        checked = batch.withColumn("checksum", F.sha2("raw_text", 256)).persist()
        cache = None if blocked_path is None else _earlier(spark, blocked_path, BLOCKED_CACHE, writer, number)
        try:
            rows = _committed(checked, registry_path, writer, number, cache, lease.fence)
            if blocked_path is not None:
                entries = rows.where("status = 'BLOCKED'").select(F.col("path").alias("original_path"), F.col("mtime_ms").cast("double").alias("mtime_ms"), F.col("size").cast("long").alias("size"))
                entries.write.mode("overwrite").parquet(f"{blocked_path}/writer={writer}/batch={number}")
            batch_events(rows, number).write.mode("overwrite").parquet(f"{events_path}/writer={writer}/batch={number}")
            if on_batch:
                on_batch(rows, number)
            rows.unpersist()
        finally:
            checked.unpersist()

    try:
        writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).queryName(f"ingest {registry_path}")
        query = writer.trigger(**(trigger or {"availableNow": True})).start()
    except Exception:
        lease.release()
        raise
    _owned[registry_path] = (query, lease)
    _keep_alive(query, lease, registry_path, min(1.0, lease_seconds / 4))
    return query


def _committed(checked: DataFrame, registry_path: str, writer: str, number: int, cache: DataFrame | None, fence: int) -> DataFrame:
    """Triage a batch against the registry and commit what is new; done again if another commit came into the same buckets."""
    spark = checked.sparkSession
    touched = {r["b"] for r in checked.where("checksum is not null").select(versions.bucket_of(F.col("checksum")).alias("b")).distinct().collect()}
    while True:
        state = versions.state_of(spark, registry_path)
        # the batch's own commit, if it is tried again, is no history
        mine = state.writers[writer][1] if state.has(writer, number) else None
        rows = triage(checked, known_checksums(spark, registry_path, state, touched, mine), blocked=cache).persist()
        if mine is not None:
            return rows
        name, buckets = versions.write_files(rows.where("status = 'MOVED'"), registry_path, "checksum")
        try:
            versions.commit(spark, registry_path, state, {(name, b) for b in buckets}, frozenset(), writer, number, touched, fence)
            return rows
        except versions.Conflict:
            rows.unpersist()
            storage.delete(spark, f"{registry_path}/commit={name}")


def watch(
    scan: Callable[[], StreamingQuery], spark: SparkSession, registry_path: str, every: float = 10.0, cooldown: float = COOLDOWN, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep
) -> Iterator[str]:
    """Scan every few seconds, for as long as the caller goes on: what each round did.

    ``scanned``, ``busy`` (another scan holds the lease), ``cooldown`` (a stop was asked for less than ``cooldown``
    seconds ago) or ``stopped`` (one was asked for during the scan).
    """
    while True:
        if cooling(spark, lease_path(registry_path), clock, cooldown):
            yield "cooldown"
        else:
            try:
                query = scan()
            except ScanInProgress:
                yield "busy"
            else:
                try:
                    query.awaitTermination()
                    yield "stopped" if cooling(spark, lease_path(registry_path), clock, cooldown) else "scanned"
                except Exception:
                    if not cooling(spark, lease_path(registry_path), clock, cooldown):
                        raise
                    yield "stopped"
        sleep(every)


BLOCKED_CACHE = "original_path string, mtime_ms double, size long"


def batch_events(rows: DataFrame, number: int) -> DataFrame:
    """``type, filename, id, status, task`` of one batch: its task and scan start and end, a file each, and a registry update if rows moved."""
    task = F.lit(f"scan-{number}").alias("task")
    none = lambda kind: F.lit(None).cast(kind)
    event = F.when(F.col("status") == "MOVED", "FILE_COMPLETED").otherwise("FILE_FAILED")
    files = rows.select(event.alias("type"), "filename", F.col("id").cast("long").alias("id"), "status", task)
    total = rows.agg(F.count_if(F.col("status") == "MOVED").alias("moved"))
    kinds = F.when(F.col("moved") > 0, F.array(*map(F.lit, (*SCAN_EVENTS, "REGISTRY_UPDATED", "DOCUMENTS_UPDATED")))).otherwise(F.array(*map(F.lit, SCAN_EVENTS)))
    scan = total.select(F.explode(kinds).alias("type"), none("string").alias("filename"), none("long").alias("id"), none("string").alias("status"), task)
    return files.unionByName(scan)


SCAN_EVENTS = ("TASK_STARTED", "SCAN_STARTED", "SCAN_COMPLETED", "TASK_FINISHED")


def mutation_events(kind: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """One event a changed row, of one of the known types, for the table that clients follow."""
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type: {kind}")
    return rows.select(F.lit(kind).alias("type"), F.col(key).cast("string").alias("key"))


def log_frames(earlier: DataFrame, later: DataFrame, n: int = 300) -> DataFrame:
    """``frame, event_id, ts``: the newest ``n`` of the log so far as ``INIT``, then every row of ``later`` (a table or a stream) as ``LOG``."""
    first = earlier.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n).select(F.lit("INIT").alias("frame"), "event_id", "ts")
    more = later.select(F.lit("LOG").alias("frame"), "event_id", "ts")
    return more if later.isStreaming else first.unionByName(more)


def _earlier(spark: SparkSession, path: str, columns: str, writer: str, before: int) -> DataFrame:
    """Rows of all batches but this writer's own from a number on; none if nothing was written yet. Any other failure is raised."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(f"{columns}, writer string, batch int").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)
    return rows.where((F.col("writer") != writer) | (F.col("batch") < before)).drop("writer", "batch")


def registry_rows(spark: SparkSession, registry_path: str, columns: str, state: versions.State | None = None) -> DataFrame:
    """The registry's rows, ``columns`` as a schema string, of its newest version or a given one."""
    return versions.rows_of(spark, registry_path, columns, state).drop("bucket")


def known_checksums(
    spark: SparkSession, registry_path: str, state: versions.State | None = None, buckets: set[int] | None = None, without: str | None = None
) -> DataFrame:
    """Checksums in the registry, of some buckets and without one commit's: only their folders and this column are read."""
    return versions.rows_of(spark, registry_path, "checksum string", state, buckets, without).drop("bucket")


def task_history(events: DataFrame) -> DataFrame:
    """``task, state, ts, valid``: each event's state and whether it may follow the one before it (the first follows idle)."""
    state = F.coalesce(*(F.when(F.col("type") == k, v) for k, v in TASK_EVENTS.items()))
    rows = events.withColumn("state", state).where("state is not null")
    before = F.lag("state", 1, "idle").over(Window.partitionBy("task").orderBy("ts", "event_id"))
    allowed = F.array(*(F.lit(f"{a}>{b}") for a, after in TASK_NEXT.items() for b in after))
    return rows.withColumn("valid", F.array_contains(allowed, F.concat_ws(">", before, "state"))).select("task", "state", "ts", "event_id", "valid")


def event_counts(events: DataFrame) -> DataFrame:
    """Running counts by type, for a stream or a table of events."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def task_states(events: DataFrame) -> DataFrame:
    """Last state a task, for a stream or a table of ``task, state, ts``."""
    return events.groupBy("task").agg(F.max_by("state", "ts").alias("state"))
