"""Tables in versions, the registry across scans, leases, stop requests and cooldowns."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from folio.operators import registry_store as store
from folio.sources import storage, versions
from folio.streaming import ingest as streams
from folio.streaming import lease as leases

FILES = "id long, path string, filename string, raw_text string, mtime_ms double, size long"
ROWS = "id long, checksum string, title string"


def test_a_name_is_put_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda i=i: won.append(i) if storage.put_once(spark, f"{tmp_path}/m/0", str(i)) else None) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and storage.read_text(spark, f"{tmp_path}/m/0") == str(won[0]) and storage.names_in(spark, f"{tmp_path}/m") == ["0"]


def send(spark, base, source, check, rows):
    spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(f"{base}/{source}")
    stream = spark.readStream.schema(FILES).parquet(f"{base}/{source}")
    streams.ingest(stream, f"{base}/registry", f"{base}/events", f"{base}/{check}", blocked_path=f"{base}/blocked").awaitTermination()


def statuses(spark, base):
    rows = spark.read.parquet(f"{base}/events").where("id is not null").collect()
    assert len(rows) == len({r["id"] for r in rows})
    return {r["id"]: r["status"] for r in rows}


def kept(spark, base):
    return sorted(r["id"] for r in streams.registry_rows(spark, f"{base}/registry", "id long").collect())


def test_scans_with_other_checkpoints_add_to_one_history(spark, tmp_path):
    base = str(tmp_path)
    send(spark, base, "a", "c1", [(i, f"/a{i}", f"a{i}", f"text number {i} of the first", 1.0, 9) for i in (1, 2, 3)])
    send(spark, base, "b", "c2", [(i, f"/b{i}", f"b{i}", f"text number {i} of the second", 1.0, 9) for i in (4, 5)] + [(6, "/b6", "b6", "text number 2 of the first", 1.0, 9)])
    send(spark, base, "c", "c3", [(7, "/c7", "c7", "text number 4 of the second", 1.0, 9), (8, "/c8", "c8", " ", 1.0, 1)])
    send(spark, base, "a", "c1", [(9, "/a9", "a9", "text number 5 of the second", 1.0, 9), (10, "/a10", "a10", "wholly new text", 1.0, 9)])
    assert kept(spark, base) == [1, 2, 3, 4, 5, 10]
    assert statuses(spark, base) == {1: "MOVED", 2: "MOVED", 3: "MOVED", 4: "MOVED", 5: "MOVED", 6: "DUPLICATE", 7: "DUPLICATE", 8: "BLOCKED", 9: "DUPLICATE", 10: "MOVED"}


def test_a_batch_that_is_tried_again_adds_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    plain = streams.batch_events

    def broken(rows, number):
        raise RuntimeError("after the commit, before the events")

    monkeypatch.setattr(streams, "batch_events", broken)
    with pytest.raises(Exception, match="after the commit"):
        send(spark, base, "a", "c1", [(1, "/a", "a", "one long text", 1.0, 9), (2, "/b", "b", "one long text", 1.0, 9), (3, "/c", "c", "another text", 1.0, 9)])
    assert kept(spark, base) == [1, 3]
    monkeypatch.setattr(streams, "batch_events", plain)
    stream = spark.readStream.schema(FILES).parquet(f"{base}/a")
    streams.ingest(stream, f"{base}/registry", f"{base}/events", f"{base}/c1", blocked_path=f"{base}/blocked").awaitTermination()
    assert kept(spark, base) == [1, 3] and statuses(spark, base) == {1: "MOVED", 2: "DUPLICATE", 3: "MOVED"}


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(500).select("id", F.col("id").cast("string").alias("checksum"), F.lit("t").alias("title"))
    versions.append(rows, path, "checksum")
    one = spark.createDataFrame([("7",)], "checksum string").select(versions.bucket_of(F.col("checksum")).alias("b")).first()["b"]
    part = streams.known_checksums(spark, path, buckets={one})
    assert {r["checksum"] for r in part.collect()} >= {"7"} and 0 < part.count() < 50
    assert {f.rsplit("/", 2)[-2] for f in part.inputFiles()} == {f"bucket={one}"}


def test_commits_into_other_buckets_do_not_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    base = versions.state_of(spark, path)
    versions.commit(spark, path, base, {("a", 1)})
    versions.commit(spark, path, base, {("b", 2)})
    with pytest.raises(versions.Conflict):
        versions.commit(spark, path, base, {("c", 2)})
    state = versions.state_of(spark, path)
    assert state.version == 1 and state.live == {("a", 1), ("b", 2)}
    again = versions.commit(spark, path, state, {("d", 3)}, writer="w", number=4)
    assert versions.commit(spark, path, state, {("e", 3)}, writer="w", number=4).version == again.version
    for k in range(40):
        state = versions.commit(spark, path, versions.state_of(spark, path), {(f"n{k}", k)}, writer="w", number=5 + k)
    assert versions.state_of(spark, path) == state and len(state.live) == 43 and state.has("w", 44) and not state.has("w", 45)
    assert len(versions.state_of(spark, path, 10).live) == 11
    with pytest.raises(ValueError):
        versions.state_of(spark, path, 99)


def test_an_owner_that_lost_its_lease_cannot_commit(spark, tmp_path):
    path = str(tmp_path / "t")
    state = versions.commit(spark, path, versions.state_of(spark, path), {("a", 1)}, fence=5)
    with pytest.raises(versions.Fenced):
        versions.commit(spark, path, state, {("b", 2)}, fence=4)
    with pytest.raises(versions.Fenced):
        versions.commit(spark, path, versions.State(), {("b", 2)}, touched=set(), fence=4)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([(i, f"c{i}", f"t{i}") for i in range(200)] + [(900, None, "n"), (901, None, "n")], ROWS)
    store.insert(rows, path, ROWS)
    return path


def read(spark, path, state=None):
    return {r["id"]: r["title"] for r in versions.rows_of(spark, path, ROWS, state).collect()}


def test_mutations_are_commits_and_tell_their_changes(spark, table):
    first = versions.state_of(spark, table)
    assert len(read(spark, table)) == 202
    store.insert(spark.createDataFrame([(300, "c5", "x"), (301, "d1", "x"), (302, "d1", "x"), (303, None, "x")], ROWS), table, ROWS)
    store.patch(spark.createDataFrame([(7, "seven"), (8, "t8")], "id long, title string"), table, ROWS)
    second = versions.state_of(spark, table)
    assert len({f for f in first.live - second.live}) <= 2
    store.delete(spark.createDataFrame([(9,), (301,), (12345,)], "id long"), table, ROWS)
    now = read(spark, table)
    assert len(now) == 202 and now[7] == "seven" and 9 not in now and 301 not in now and now[303] == "x"
    assert read(spark, table, first) == {**{i: f"t{i}" for i in range(200)}, 900: "n", 901: "n"}
    told = {(r["change"], r["key"], r["type"]) for r in store.events_between(spark, table, ROWS, first.version).collect()}
    assert told == {("insert", "303", "DOCUMENTS_UPDATED"), ("update", "7", "REGISTRY_UPDATED"), ("delete", "9", "DOCUMENTS_UPDATED")}
    assert store.events_between(spark, table, ROWS, versions.state_of(spark, table).version).count() == 0
    all_of_it = store.events_between(spark, table, ROWS, -1)
    assert all_of_it.count() == 202 and all_of_it.where("change <> 'insert'").count() == 0


def test_repeated_rows_are_counted_in_changes(spark, tmp_path):
    path = str(tmp_path / "t")
    twice = spark.createDataFrame([(1, "a", "t"), (1, "a", "t"), (2, None, None)], ROWS)
    versions.append(twice, path, "checksum")
    versions.append(twice.limit(1), path, "checksum")
    rows = versions.changes(spark, path, ROWS, -1).collect()
    assert {(r["change"], r["id"], r["times"]) for r in rows} == {("insert", 1, 3), ("insert", 2, 1)}


def test_compaction_and_vacuum_keep_all_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(5):
        versions.append(spark.createDataFrame([(k, "same", "t"), (k + 10, f"o{k}", "t")], ROWS), path, "checksum")
    before = read(spark, path)
    old = versions.state_of(spark, path)
    state = versions.compact(spark, path, ROWS, "checksum", most=2)
    assert read(spark, path) == before and len(state.live) < len(old.live)
    assert versions.changes(spark, path, ROWS, old.version).count() == 0
    assert versions.vacuum(spark, path, keep=1) >= 1
    assert read(spark, path) == before


def test_new_entries_reach_the_next_taxonomy(spark, tmp_path):
    path = str(tmp_path / "taxonomy")
    rows = [("bank", "Credit Neuf", "/a"), ("bank", "credit_neuf", "/b"), ("bank", "general", "/c"), ("tax", "impot", "/d")]
    resolved = spark.createDataFrame(rows, "category string, subcategory string, path string")
    first = store.add_entries(resolved, path)
    second = store.add_entries(resolved.union(spark.createDataFrame([("tax", "taxe_fonciere", "/e")], resolved.schema)), path)
    entries = lambda s: {r["entry"] for r in versions.rows_of(spark, path, store.TAXONOMY, s).collect()}
    assert entries(first) == {"bank/credit_neuf", "tax/impot"} and entries(second) == entries(first) | {"tax/taxe_fonciere"}
    told = store.events_between(spark, path, store.TAXONOMY, first.version, kinds=store.TAXONOMY_EVENTS, key="entry").collect()
    assert [tuple(r) for r in told] == [("CATEGORIES_UPDATED", "insert", "tax/taxe_fonciere")]


def test_readers_see_one_version_whole_during_replacements(spark, tmp_path):
    path = str(tmp_path / "mirror")
    assert versions.current(spark, path) is None
    write = lambda k: lambda to: spark.createDataFrame([(k, i) for i in range(3)], "k int, i int").coalesce(1).write.json(to)
    versions.publish(spark, path, write(0))
    seen, failed, done = set(), [], threading.Event()

    def look():
        while not done.is_set():
            try:
                rows = spark.read.schema("k int, i int").json(versions.current(spark, path)).collect()
                assert len(rows) == 3 and len({r["k"] for r in rows}) == 1
                seen.add(rows[0]["k"])
            except Exception as e:
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(1, 51):
        versions.publish(spark, path, write(k), keep=20)
    done.set()
    reader.join()
    assert not failed and len(seen) > 2
    assert spark.read.json(versions.current(spark, path)).first()["k"] == 50 and len(storage.names_in(spark, path)) == 20
    with pytest.raises(ValueError):
        versions.current(spark, path, 3)


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


def test_a_lease_has_one_owner_and_lapses(spark, tmp_path):
    clock, path = Clock(), str(tmp_path / "lease")
    one = leases.Lease(spark, path, 100, clock).acquire()
    with pytest.raises(leases.ScanInProgress):
        leases.Lease(spark, path, 100, clock).acquire()
    clock.now += 60
    one.check()  # renews past its half
    clock.now += 60
    assert leases.held(spark, path, clock)
    clock.now += 100
    two = leases.Lease(spark, path, 100, clock).acquire()
    assert two.fence > one.fence
    with pytest.raises(leases.LeaseLost):
        one.renew()
    one.release()
    assert leases.held(spark, path, clock)
    two.release()
    assert not leases.held(spark, path, clock)
    for _ in range(10):
        leases.Lease(spark, path, 100, clock).acquire().release()
    assert len(storage.names_in(spark, f"{path}/claims")) <= 3


def test_stop_requests_and_cooldown(spark, tmp_path):
    clock, path = Clock(), str(tmp_path / "lease")
    assert not leases.request_stop(spark, path, clock)
    one = leases.Lease(spark, path, 100, clock).acquire()
    one.check()
    assert leases.request_stop(spark, path, clock) and leases.cooling(spark, path, clock)
    with pytest.raises(leases.Stopped):
        one.check()
    one.release()
    two = leases.Lease(spark, path, 100, clock).acquire()
    two.check()  # the request was for the owner before
    clock.now += 61
    assert not leases.cooling(spark, path, clock)


def test_a_stopped_scan_leaves_the_rest_for_the_next(spark, tmp_path):
    base = str(tmp_path)
    for i in range(6):
        spark.createDataFrame([(i, f"/{i}", f"{i}", f"text of file {i}", 1.0, 9)], FILES).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def scan(**more):
        stream = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        return streams.ingest(stream, f"{base}/registry", f"{base}/events", f"{base}/check", **more)

    def stop_after_two(rows, number):
        if number == 1:  # as another application would
            assert leases.request_stop(spark, streams.lease_path(f"{base}/registry"))

    try:
        scan(on_batch=stop_after_two).awaitTermination()
    except Exception as e:
        assert "Stopped" in str(e)
    assert len(kept(spark, base)) == 2
    scan().awaitTermination()
    assert kept(spark, base) == list(range(6)) and set(statuses(spark, base).values()) == {"MOVED"}


def test_another_application_is_refused_and_the_watcher_waits(spark, tmp_path):
    base, clock = str(tmp_path), Clock()
    spark.createDataFrame([(1, "/1", "1", "text of a file", 1.0, 9)], FILES).write.parquet(f"{base}/in")
    registry = f"{base}/registry"

    def scan():
        return streams.ingest(spark.readStream.schema(FILES).parquet(f"{base}/in"), registry, f"{base}/events", f"{base}/check")

    other = leases.Lease(spark, streams.lease_path(registry)).acquire()  # what another application holds
    rounds = streams.watch(scan, spark, registry, clock=clock, sleep=lambda s: setattr(clock, "now", clock.now + s))
    assert next(rounds) == "busy"
    with pytest.raises(streams.ScanInProgress):
        scan()
    leases.request_stop(spark, streams.lease_path(registry), lambda: 0.0)
    storage.put_once(spark, f"{streams.lease_path(registry)}/stops/999999999998", json.dumps({"at": clock.now}))
    other.release()
    outcomes = [next(rounds) for _ in range(5)]
    assert outcomes == ["cooldown"] * 5
    # the request above bears a number of the future, so it would also stop the next owner
    storage.delete(spark, f"{streams.lease_path(registry)}/stops/999999999998")
    clock.now = time.time() + 1000
    assert next(rounds) == "scanned" and kept(spark, base) == [1]
