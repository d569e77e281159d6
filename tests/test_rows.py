"""No operator loses or multiplies rows: null contents, repeated keys, missing tables; and the stored search index."""

import pytest
from pyspark.sql import functions as F

from folio.operators import registry_ops as ops
from folio.operators import retrieval, search_index
from folio.plans.query import StructuredQuery
from folio.sources import versions
from folio.streaming import ingest as streams

FILES = "id long, path string, filename string, raw_text string"
ROWS = [(1, "/a", "a.pdf", "the mit license text"), (2, "/b", "b.pdf", None), (3, "/c", "c.pdf", None), (4, "/d", "d.pdf", "the mit license text"), (5, "/e", "e.pdf", "")]


def test_null_contents_copy_nothing(spark):
    rows = spark.createDataFrame([(1, "/b", "x"), (2, "/a", "x"), (3, "/c", None), (4, "/d", None)], "id long, path string, checksum string")
    assert {r["id"]: r["copy_of"] for r in ops.first_of_batch(rows).collect()} == {1: 2, 2: None, 3: None, 4: None}


def test_insert_and_upsert_keep_rows_without_a_key(spark):
    kind = "id long, checksum string"
    table = spark.createDataFrame([(1, None), (2, "x")], kind)
    rows = spark.createDataFrame([(3, "x"), (4, None), (5, None), (6, "y"), (7, "y")], kind)
    assert sorted(r["id"] for r in ops.insert(table, rows).collect()) == [1, 2, 4, 5, 6]
    assert sorted(r["id"] for r in ops.upsert(table, rows, "checksum", "id").collect()) == [1, 3, 4, 5, 7]


def test_repeated_keys_make_no_rows(spark):
    table = spark.createDataFrame([(1, "a", "u"), (2, "b", "v")], "id long, title string, category string")
    patches = spark.createDataFrame([(1, "x", None, 1), (1, "w", "z", 0), (1, None, None, 2)], "id long, title string, category string, n int")
    assert sorted(tuple(r) for r in ops.patch(table, patches, order="n").collect()) == [(1, "x", "z"), (2, "b", "v")]
    assert ops.patch(table, patches).count() == 2
    files = spark.createDataFrame([(1, "/a", 5.0, 9), (2, "/b", 5.0, 9)], "id long, path string, mtime_ms double, size long")
    cache = spark.createDataFrame([("/a", 5.0, 9), ("/a", 4.0, 9), ("/b", 6.0, 9), ("/b", 5.0, 9)], "original_path string, mtime_ms double, size long")
    assert {r["id"]: r["skip"] for r in ops.skip_or_retry(files, cache).collect()} == {1: True, 2: False} and ops.skip_or_retry(files, cache).count() == 2
    docs = spark.createDataFrame([(1, "a.pdf", "/n/a.pdf", "/o/a.pdf")], "id long, filename string, new_path string, original_path string")
    seen = spark.createDataFrame([("/n/a.pdf",), ("/n/a.pdf",), ("/o/a.pdf",), ("/o/a.pdf",), ("/input/a.pdf",)], "path string")
    assert [r["found_path"] for r in ops.locate(docs, seen).collect()] == ["/n/a.pdf"]


def test_every_file_gets_a_status(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, FILES)
    known = spark.createDataFrame([], "checksum string")
    assert {r["id"]: r["status"] for r in streams.triage(rows, known).collect()} == {1: "MOVED", 2: "BLOCKED", 3: "BLOCKED", 4: "DUPLICATE", 5: "BLOCKED"}


def scan(spark, base, **more):
    kind = f"{FILES}, mtime_ms double, size long"
    source = spark.readStream.schema(kind).parquet(f"{base}/in")
    return streams.ingest(source, f"{base}/registry", f"{base}/events", f"{base}/check", blocked_path=f"{base}/blocked", **more)


def test_blocked_files_are_skipped_until_they_change(spark, tmp_path):
    base = str(tmp_path)

    def send(rows):
        spark.createDataFrame(rows, f"{FILES}, mtime_ms double, size long").coalesce(1).write.mode("append").parquet(f"{base}/in")
        scan(spark, base).awaitTermination()

    send([(1, "/a", "a.pdf", " ", 1.0, 1), (2, "/b", "b.pdf", "some text of length", 1.0, 19)])
    send([(3, "/a", "a.pdf", "a text that is not read", 1.0, 1)])
    send([(4, "/a", "a.pdf", "now it has a text", 2.0, 17)])
    events = spark.read.parquet(f"{base}/events")
    assert {r["id"]: r["status"] for r in events.where("id is not null").collect()} == {1: "BLOCKED", 2: "MOVED", 3: "SKIPPED", 4: "MOVED"}
    assert events.where("type = 'REGISTRY_UPDATED'").count() == 2 and {r["type"] for r in events.collect()} <= set(streams.EVENT_TYPES)


def test_one_scan_at_a_time(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], f"{FILES}, mtime_ms double, size long").write.parquet(f"{base}/in")
    query = scan(spark, base, trigger={"processingTime": "10 seconds"})
    try:
        with pytest.raises(streams.ScanInProgress):
            scan(spark, base)
        assert streams.running(spark, f"{base}/registry") is not None
    finally:
        assert streams.abort(spark, f"{base}/registry")
    query.awaitTermination(30)
    assert not streams.abort(spark, f"{base}/registry")


def test_only_a_missing_registry_counts_as_empty(spark, tmp_path):
    assert streams.known_checksums(spark, str(tmp_path / "none")).count() == 0
    name, buckets = versions.write_files(spark.createDataFrame([("x",)], "checksum string"), str(tmp_path), "checksum")
    versions.commit(spark, str(tmp_path), versions.State(), {(name, b) for b in buckets})
    assert streams.known_checksums(spark, str(tmp_path)).count() == 1
    for part in tmp_path.glob("commit=*/*/part-*"):
        part.write_text("not parquet")
    for crc in tmp_path.glob("commit=*/*/.*.crc"):
        crc.unlink()
    with pytest.raises(Exception, match="not a Parquet file"):
        streams.known_checksums(spark, str(tmp_path)).collect()
    (tmp_path / "_manifest" / "0000000001").write_text("{")
    with pytest.raises(ValueError):
        streams.known_checksums(spark, str(tmp_path))


@pytest.mark.parametrize(
    "query,relax",
    [
        (StructuredQuery(keywords=("license", "src1")), False),
        (StructuredQuery(keywords=("all rights reserved",), not_terms=("apache",)), False),
        (StructuredQuery(doc_types=("license",), entities=("apache",), keywords=("zebrawood",), not_terms=("version",)), True),
        (StructuredQuery(keywords=("license",), category="src1", date_from="2023-02-01"), True),
        (StructuredQuery(keywords=("zebrawood",)), True),
        (StructuredQuery(), False),
    ],
)
def test_index_finds_what_a_scan_finds(spark, tmp_path_factory, query, relax):
    from conftest import SF

    from folio.plans import catalog

    docs = catalog.load(spark, SF)
    path = catalog.index(spark, SF)
    plain = lambda rows: sorted((r["id"], round(r["score"], 9), r["rung"]) for r in rows.collect())
    assert plain(search_index.search(spark, path, query, None, relax=relax)) == plain(retrieval.search(docs, query, None, relax=relax))


def test_index_drifts_with_its_documents(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "alpha beta", "t"), (2, "beta", None)], "id long, raw_text string, title string")
    assert search_index.drifted(docs, path) and search_index.ensure(docs, path) and not search_index.ensure(docs, path)
    found = lambda q: sorted(r["id"] for r in search_index.search(spark, path, StructuredQuery(keywords=(q,)), None).collect())
    assert found("beta") == [1, 2] and found("alpha beta") == [1] and found("gone") == []
    more = docs.union(spark.createDataFrame([(3, "gone", "beta")], docs.schema))
    assert search_index.ensure(more, path) and found("gone") == [3] and found("beta") == [1, 2, 3]
    plan = search_index.terms_of(spark, path, ["beta"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "In(term" in plan or "EqualTo(term" in plan


def test_bursts_of_messages(spark):
    rows = [("k", t) for t in (0, 10, 29, 30, 45, 59, 60, 200, 210, 229, 231)] + [("j", 5), ("j", 5), ("j", 34), ("j", 36)]
    shown = ops.suppressed(spark.createDataFrame(rows, "key string, t long").select("key", F.timestamp_seconds("t").alias("ts")), 30)
    got = sorted((r["key"], int(r["ts"].timestamp())) for r in shown.select("key", F.col("ts")).collect())
    assert got == [("j", 5), ("j", 36), ("k", 0), ("k", 30), ("k", 60), ("k", 200), ("k", 231)]


@pytest.fixture(scope="module")
def indexed_documents(spark, tmp_path_factory):
    from conftest import SF

    from folio.plans import catalog

    docs = catalog.load(spark, SF).select("id", "title", "tags", "category", "subcategory", "filename", "raw_text", "date")
    path = str(tmp_path_factory.mktemp("segments") / "index")
    search_index.build(docs, path)
    return docs, path


def rows_of(df):
    return sorted((r["id"], round(r["score"], 8), r["rung"]) for r in df.collect())


WORDS = [StructuredQuery(keywords=("license", "the")), StructuredQuery(keywords=("und",), category="src1"), StructuredQuery(entities=("de",), keywords=("la", "src2"), not_terms=("que",)), StructuredQuery(keywords=("the and",))]


@pytest.mark.parametrize("query", WORDS)
def test_an_updated_index_equals_a_rebuilt_one(spark, indexed_documents, query, tmp_path_factory):
    docs, path = indexed_documents
    before = search_index.state_of(spark, path)
    changed = docs.where("id % 100 = 3").withColumn("raw_text", F.concat(F.lit("the license und de la "), F.col("raw_text"))).withColumn("category", F.lit("src1"))
    added = docs.where("id % 100 = 4").withColumn("id", F.col("id") + 1_000_000)
    gone = docs.where("id % 100 = 5").select("id")
    after = search_index.update(changed.union(added), path, gone)
    if after["version"] == before["version"] + 1:  # else segments were merged
        assert after["segments"][-1]["postings"] < 0.2 * before["segments"][0]["postings"]
    now = docs.where("id % 100 not in (3, 5)").union(changed).union(added)
    assert rows_of(search_index.search(spark, path, query, None)) == rows_of(retrieval.search(now, query, None))
    assert rows_of(search_index.search(spark, path, query, 10)) == rows_of(retrieval.search(now, query, 10))
    found = search_index.figures(spark, path).first()
    assert found["n"] == now.count() and len(search_index.state_of(spark, path)["segments"]) < search_index.TIER + 1


def test_dead_documents_are_merged_away(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}", "t") for i in range(100)], "id long, raw_text string, title string")
    path = str(tmp_path / "index")
    search_index.build(docs, path)
    state = search_index.update(docs.where("id < 30").withColumn("raw_text", F.lit("beta")), path, docs.where("id >= 90").select("id"))
    assert len(state["segments"]) == 1 and not state["tombstones"] and state["segments"][0]["n"] == 90
    assert len(rows_of(search_index.search(spark, path, StructuredQuery(keywords=("alpha",)), None))) == 60
    empty = search_index.update(docs.limit(0), path, docs.select("id"))
    assert search_index.figures(spark, path).first()["n"] == 0 and empty["segments"][0]["n"] == 0
    assert rows_of(search_index.search(spark, path, StructuredQuery(keywords=("alpha",)), None)) == []


def test_the_best_rows_need_few_blocks(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows = [(i * 16, " ".join(rng.choices(["the", "of", f"x{rng.randrange(50)}", "rare"], [50, 30, 20, 0.2], k=rng.randrange(5, 60))), rng.choice("abc")) for i in range(8_000)]
    docs = spark.createDataFrame(rows, "id long, raw_text string, category string").repartition(4)
    path = str(tmp_path / "index")
    search_index.build(docs, path)
    state = search_index.state_of(spark, path)
    for query in (StructuredQuery(keywords=("the",)), StructuredQuery(keywords=("the", "rare")), StructuredQuery(entities=("of",), keywords=("the",), category="a"), StructuredQuery(keywords=("the",), not_terms=("of",))):
        plan = search_index.pruned(spark, path, state, query, 5)
        plain = retrieval.search(docs, query, 5)
        assert rows_of(search_index.search(spark, path, query, 5)) == rows_of(plain) == rows_of(search_index.search(spark, path, query, 5, prune=False))
        assert plan["read"] <= plan["all"]
    cost = search_index.pruned(spark, path, state, StructuredQuery(keywords=("rare",)), 5)
    assert cost is None or cost["read"] < 0.7 * cost["all"]
    text = {"raw_text": 0.5}
    assert rows_of(search_index.search(spark, path, StructuredQuery(keywords=("the",)), 5, text)) == rows_of(retrieval.search(docs, StructuredQuery(keywords=("the",)), 5, text))


def test_drift_is_told_by_files_where_there_are_files(spark, tmp_path, monkeypatch):
    base, path = str(tmp_path / "docs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "alpha", "t")], "id long, raw_text string, title string").write.parquet(base)
    search_index.build(spark.read.parquet(base), path)
    plain = search_index.seal
    monkeypatch.setattr(search_index, "seal", lambda *a: pytest.fail("all documents were read"))
    assert not search_index.drifted(spark.read.parquet(base), path)
    monkeypatch.setattr(search_index, "seal", plain)
    spark.createDataFrame([(2, "beta", "t")], "id long, raw_text string, title string").write.mode("append").parquet(base)
    assert search_index.drifted(spark.read.parquet(base), path)
