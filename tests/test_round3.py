"""Faults found by the third review."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.functions import dates, text
from folio.operators import retrieval, search_index
from folio.plans import catalog_more, catalog_store
from folio.plans.query import StructuredQuery
from folio.sources import files
from folio.streaming import ordered


def test_bytes_beyond_the_last_unit(value):
    sizes = (1023, 1024**3 - 1, 1024**3, 1024**4, 1536 * 1024**3)
    assert [value(dates.format_bytes(F.lit(n))) for n in sizes] == ["1023 B", "1024 MB", "1 GB", "1024 GB", "1536 GB"]


def test_short_after_cleaning(value):
    noisy = F.lit("\x00ab\r\ncd\r\nefg")  # nine characters once NUL and carriage returns are gone
    assert value(text.clean_text(noisy, after=True)) == "" and value(text.clean_text(noisy)) == "ab\ncd\nefg"
    assert value(text.clean_text(F.lit(None).cast("string"))) is None


def test_markdown_names_in_folders(spark, tmp_path):
    rows = [(1, "a b", "x"), (2, "A_b", "y"), (3, "a:b", "y"), (4, "t", "x"), (5, "T", "y"), (6, None, "x"), (7, "", "x")]
    df = spark.createDataFrame([(*r, f"body {r[0]}") for r in rows], "id long, title string, category string, raw_text string")
    files.write_markdown(df, str(tmp_path / "md"))
    out = {r["body"]: r["name"] for r in spark.read.parquet(str(tmp_path / "md")).collect()}
    assert out == {"body 1": "a_b.md", "body 2": "A_b.md", "body 3": "a_b_1.md", "body 4": "t_4.md", "body 5": "T_5.md", "body 6": None, "body 7": ".md"}


@pytest.mark.parametrize("name", ["quoted_charts", "handed_headers", "markdown_html", "gray_levels", "resolve_subcategories", "repaired_tables", "malformed_tables"])
def test_short_rows_with_much_work_use_all_cores(spark, name):
    rows = getattr(catalog_more, name)(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one file and one row group before


def test_no_row_works_through_a_large_dictionary(spark):
    found = catalog_more.entity_dictionary(spark, "/root/testdata/sf0.001")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    customers = spark.read.parquet("/root/testdata/sf0.001/customer.parquet").where("c_custkey < 2700")
    assert {r["id"]: r["slug"] for r in found.collect()} == {r["c_custkey"]: f"w{r['c_custkey']}" for r in customers.collect()}


def test_a_scan_is_not_written_by_one_task(spark, tmp_path, monkeypatch):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    source.write.parquet(str(tmp_path / "documents.parquet"))
    bases = []
    plain = catalog_more.scratch_folder
    monkeypatch.setattr(catalog_more, "scratch_folder", lambda *a: bases.append(plain(*a)) or bases[-1])
    rows = catalog_more.stream_events(spark, str(tmp_path)).collect()
    assert len(spark.read.parquet(f"{bases[0]}/in").inputFiles()) > 1
    assert sum(r["n"] for r in rows if r["status"]) == source.count()


@pytest.fixture(scope="module")
def dense_and_rare(spark, tmp_path_factory):
    """``the`` in every document, ``r<i // 40>`` in forty neighbours, ids in any order."""
    rows = [((i * 7919) % 2000, "the " * (i % 3 + 1) + f"r{(i * 7919) % 2000 // 40}", f"r{i % 50}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "id long, raw_text string, title string").repartition(3)
    path = str(tmp_path_factory.mktemp("rows") / "index")
    search_index.build(docs, path)
    return docs, path


def test_rare_terms_are_stored_together(spark, dense_and_rare):
    docs, path = dense_and_rare
    stored = spark.read.parquet(f"{path}/postings").groupBy("term", "column").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.max("wide").alias("wide")).collect()
    rows = {(r["term"], r["column"]): r for r in stored}
    assert not rows["the", "raw_text"]["wide"] and rows["the", "raw_text"]["rows"] <= 3 * 16  # a row a block and place; one a posting before
    assert rows["r7", "title"]["wide"] and rows["r7", "title"]["n"] == 40 and rows["r7", "title"]["rows"] <= 3
    assert not (Path(path) / "blocks").exists()  # no second pass over all postings


def test_rows_of_a_merged_index(spark, dense_and_rare, tmp_path):
    docs, _ = dense_and_rare
    path = str(tmp_path / "index")
    search_index.build(docs.where("id % 4 = 0"), path)
    for k in (1, 2, 3):
        state = search_index.update(docs.where(f"id % 4 = {k}"), path)
    assert len(state["segments"]) < 4
    now = docs
    for query in (StructuredQuery(keywords=("the", "r7")), StructuredQuery(keywords=("the r7",)), StructuredQuery(keywords=("r7",), not_terms=("r9",))):
        for limit in (None, 5):
            found, plain = search_index.search(spark, path, query, limit), retrieval.search(now, query, limit)
            assert sorted((r["id"], round(r["score"], 9)) for r in found.collect()) == sorted((r["id"], round(r["score"], 9)) for r in plain.collect())
    statistics = {r["term"]: (r["df"], r["cf"]) for r in search_index.term_statistics(spark, path, ["the", "r7"], ("raw_text",)).collect()}
    assert statistics == {"the": (2000, sum(i % 3 + 1 for i in range(2000))), "r7": (40, 40)}


def test_an_index_of_an_older_layout_is_built_anew(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(1, "alpha", "t")], "id long, raw_text string, title string")
    state = search_index.build(docs, path)
    assert not search_index.drifted(docs, path)
    old = {k: v for k, v in state.items() if k != "layout"}
    search_index._put(spark, path, state, old)
    assert search_index.drifted(docs, path)
    with pytest.raises(ValueError, match="layout"):
        search_index.update(docs, path)


def test_many_keys_share_a_call(spark, tmp_path):
    """5,000 keys, one of them null, in two runs: a group a call, and what a table gives."""
    rows = spark.range(15_000).select(F.when(F.col("id") % 5000 > 0, (F.col("id") % 5000).cast("string")).alias("key"), F.timestamp_seconds(1000 + F.floor(F.col("id") / 5000) * 20).alias("ts"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for part in (rows.where("unix_timestamp(ts) < 1040"), rows.where("unix_timestamp(ts) >= 1040"), spark.sql("SELECT 'end' AS key, timestamp_seconds(1000000) AS ts")):
        part.write.mode("append").parquet(str(tmp_path / "in"))
        out = ordered.suppressed_stream(stream(), 30, "1 second")
        run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        run.awaitTermination()
        states = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
        assert max(states) <= ordered.GROUPS  # a key each before
    got = {(r["key"], r["shown_us"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    keys = [None, *map(str, range(1, 5000))]
    assert got - {("end", 10**12)} == {(k, t) for k in keys for t in (1_000_000_000, 1_040_000_000)}


def test_a_replayed_part_is_written_by_all_its_readers(spark):
    rows = spark.range(0, 4000, 1, 4).select("id", F.timestamp_seconds("id").alias("ts"))
    seen = []
    catalog_store._replayed(spark, rows, "test", lambda stream, base: seen.append(len(list(Path(base.removeprefix("file:")).glob("in/part-*")))), files=1)
    assert seen[0] == 4  # one before
