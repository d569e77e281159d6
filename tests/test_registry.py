"""Tables: mutations, reconciliation, sources, sinks, streaming, and every registered query against its SQL."""

import json
from pathlib import Path

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

import __spark_entry__ as contract
from folio import schema
from folio.operators import registry_ops as ops
from folio.plans import catalog, catalog_more  # noqa: F401
from folio.sources import files, versions
from folio.streaming.ingest import ingest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows):
    def one(v):
        if v is None or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v).replace("+00:00", "")

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.SQL:
        assert name == "chunked_text"
        assert all(r["whole"] and 0 < r["longest"] <= 1400 for r in got.where("n > 0").collect()) and got.where("n > 1").count() > 0
        return
    want = duck.execute(catalog.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(want.fetchall()) == plain(got.select(*columns).collect())


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


def test_conform_and_validate(spark):
    df = spark.createDataFrame([(1, "a"), (2, " ")], "id int, title string")
    out = schema.conform(df, schema.DOCUMENTS)
    assert out.schema == schema.DOCUMENTS and out.where("checksum is null").count() == 2
    good, bad = schema.validate(df, ["title"])
    assert [r["id"] for r in good.collect()] == [1] and bad.first()["missing"] == ["title"]
    filled = schema.metadata_defaults(spark.createDataFrame([("t", None)], "titre string, tags array<string>")).first()
    assert filled["tags"] == [] and filled["other"] == {} and filled["summary"] == ""


def test_aliases_fold(spark):
    entries = spark.createDataFrame([("c", "win", ["w"]), ("c", "lose", ["l"])], "category string, slug string, aliases array<string>")
    merges = spark.createDataFrame([("c", "lose", "win")], "category string, loser string, winner string")
    assert [tuple(r) for r in ops.fold_aliases(entries, merges).collect()] == [("c", "win", ["l", "lose", "w"])]


def test_small_operators(spark):
    docs = spark.createDataFrame([(1, "sfr", ["rib"]), (2, "edf", ["sfr"]), (3, None, [])], "id long, subcategory string, tags array<string>")
    assert [r["id"] for r in ops.tag_filter(docs, "SFR").collect()] == [1] and [r["id"] for r in ops.tag_filter(docs, "rib").collect()] == [1]
    decisions = spark.createDataFrame([(1, "c", "sfr", ["a", "b"], 1, "2024-01-01"), (2, "c", "divers", ["x"], 1, "2024-01-02"), (3, "c", "edf", ["y"], 0, "2024-01-03")], "id long, new_category string, new_subcategory string, rule_keywords array<string>, enabled int, created_at string")
    assert sorted(r["keyword"] for r in ops.decision_rules(decisions).collect()) == ["a", "b"]
    proposed = spark.createDataFrame([("Bank", "New Co", "/b"), ("bank", "new_co", "/a"), ("bank", "divers", "/c")], "category string, subcategory string, path string")
    assert [tuple(r) for r in ops.new_entries(proposed).collect()] == [("bank", "new_co", "/a", "New Co")]
    counts = spark.createDataFrame([("a", 0), ("b", 2)], "category string, count int")
    assert ops.shown(counts, "a").count() == 2 and ops.shown(counts).count() == 1
    text = spark.createDataFrame([("", "a fresh text of some length", False), ("stored text by hand here", "fresh text of length", True)], "s string, f string, e boolean")
    assert [r[0] for r in text.select(ops.chosen_text(F.col("s"), F.col("f"), F.col("e"))).collect()] == ["a fresh text of some length", "stored text by hand here"]
    assert [r[0] for r in text.select(ops.needs_text(F.col("s"), F.col("f"))).collect()] == [True, False]


def test_files(spark, tmp_path):
    for name in ("a.pdf", "sub/b.PDF", ".hidden/c.pdf", "__duplicates/d.pdf", "out/e.pdf", "f.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("some text")
    got = files.list_files(spark, str(tmp_path), ignored=str(tmp_path / "out"))
    assert sorted(r["filename"] for r in got.collect()) == ["a.pdf", "b.PDF"]
    assert files.read_texts(spark, str(tmp_path)).first()["raw_text"] == "some text"
    tax = tmp_path / "tax.json"
    tax.write_text(json.dumps({"categories": [{"id": "bank", "name": "B", "aliases": [], "subcategories": [{"id": "x", "name": "X", "aliases": ["y"], "subcategories": [{"id": "z", "name": "Z"}]}]}]}))
    assert sorted(r["slug"] for r in files.read_taxonomy(spark, str(tax)).collect()) == ["x", "x/z"]
    ent = tmp_path / "ent.json"
    ent.write_text(json.dumps({"banks": [{"slug": "s", "name": "S", "aliases": ["T"]}]}))
    assert [r["surface"] for r in files.read_entities(spark, str(ent)).orderBy("ordinal").collect()] == ["S", "T"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "T", "c", "body"), (2, "t", "c", "b2")], "id long, title string, category string, raw_text string")
    files.write_csv(docs, str(tmp_path / "csv"))
    first = next(p for p in Path(tmp_path / "csv").glob("part-*") if p.stat().st_size).read_text("utf-8")
    assert first.startswith("﻿id,title")
    files.write_registry(docs, str(tmp_path / "json"), "2024-06-30")
    assert spark.read.json(f"{versions.current(spark, str(tmp_path / 'json'))}/envelope").first()["total_count"] == 2
    files.write_markdown(docs, str(tmp_path / "md"))
    assert sorted(r["name"] for r in spark.read.parquet(str(tmp_path / "md")).collect()) == ["T_1.md", "t_2.md"]


def test_stream_over_batches(spark, tmp_path):
    kind = "id long, path string, filename string, raw_text string"
    inbox, reg, events, check = (str(tmp_path / n) for n in ("in", "reg", "events", "check"))

    def send(rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(inbox)
        ingest(spark.readStream.schema(kind).parquet(inbox), reg, events, check).awaitTermination()

    send([(1, "/a", "a.pdf", "the mit license text"), (2, "/b", "b.pdf", "the mit license text"), (3, "/c", "c.pdf", " x ")])
    send([(4, "/d", "d.pdf", "the mit license text"), (5, "/e", "e.pdf", "something else entirely")])
    assert sorted(r["id"] for r in spark.read.parquet(reg).collect()) == [1, 5]
    assert {(r["id"], r["status"]) for r in spark.read.parquet(events).where("id is not null").collect()} == {(1, "MOVED"), (2, "DUPLICATE"), (3, "BLOCKED"), (4, "DUPLICATE"), (5, "MOVED")}
