"""Registered queries do their whole job, however large or long the input is."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from folio.plans import catalog


def documents(spark, base, rows):
    """A scale folder whose ``documents`` hold ``rows(id, text)``."""
    rows.selectExpr("id AS doc_id", "text", "'en' AS lang", "'src1' AS source", "length(text) AS n_chars").write.parquet(f"{base}/documents.parquet")
    return str(base)


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """More matches than a million."""
    return documents(spark, tmp_path_factory.mktemp("many"), spark.range(1_000_100).selectExpr("id", "'the license, all rights reserved' AS text"))


@pytest.mark.parametrize("name", ["fts_facets", "fts_not", "fts_phrase", "relax_ladder"])
def test_searches_return_every_match(spark, many, name):
    assert catalog.QUERIES[name](spark, many).count() == 1_000_100


def test_table_audit_reads_whole_texts(spark, tmp_path):
    wide = "|" + " h |" * 14
    late = "word \n" * 1000 + f"| a | b |\n| --- | --- |\n| x |\n\n{wide}\n| y |\n"
    d = documents(spark, tmp_path, spark.createDataFrame([(1, "word"), (2, late)], "id long, text string"))
    got = {r["id"]: (r["blocks"], r["rows"], r["ragged"], r["headerless"], r["wide"]) for r in catalog.QUERIES["table_audit"](spark, d).collect()}
    assert got == {1: (2, 3, 1, 1, 0), 2: (4, 7, 3, 2, 1)}


def test_every_order_has_a_skip_decision(spark):
    got = [r["id"] for r in catalog.QUERIES["skip_cache_all"](spark, SF).collect()]
    assert sorted(got) == sorted(r["o_orderkey"] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect())


def test_every_date_is_extracted(spark, monkeypatch):
    monkeypatch.setattr(catalog.dates, "extract_date", lambda text, today: F.lit("2050-01-02"))
    got = {r["date"] for r in catalog.QUERIES["date_extraction"](spark, SF).collect()}
    assert got == {"1950-01-02", "2050-01-02"}


def test_content_recall_compares_whole_texts(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(1000))
    d = documents(spark, tmp_path, spark.createDataFrame([(1, long), (2, "  short "), (3, "a b"), (4, "gone\x00word and more")], "id long, text string"))
    assert {r["id"]: r["recall"] for r in catalog.QUERIES["content_recall_clean"](spark, d).collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 0.333333}


def test_bm25_ranks_by_all_columns(spark):
    weights = catalog.retrieval.indexed(catalog.load(spark, SF))
    assert weights == {"title": 10.0, "tags": 6.0, "category": 2.0, "subcategory": 2.0, "filename": 1.0, "raw_text": 0.5}
    of_src1 = {r["id"] for r in catalog.load(spark, SF).where("category = 'src1'").collect()}
    assert {r["id"] for r in catalog.QUERIES["bm25_columns_topk"](spark, SF).collect()} & of_src1
