"""Requests, their compilation and ranked retrieval."""

import pytest
from pyspark.sql import functions as F

from folio.operators import retrieval
from folio.plans.query import StructuredQuery, ladder, limit_of, match_text, plan, plan_with, relaxed, requested_count


def q(**kw):
    return StructuredQuery.parse(kw)


@pytest.mark.parametrize(
    "request_,want",
    [
        (q(docTypes=["rib"], entities=["credit mutuel"]), '("rib") AND ("credit mutuel")'),
        (q(docTypes=["rib"], entities=["mutuel"], notTerms=["relevé de compte"]), '(("rib") AND ("mutuel")) NOT ("relevé de compte")'),
        (q(notTerms=["x"]), None),
        (q(keywords=['le "vrai" doc']), '("le ""vrai"" doc")'),
        (q(keywords=["???", "  ", "-", "rib"]), '("rib")'),
        (q(keywords=["  RIB  ", "rib", "Rib"]), '("RIB")'),
        *((q(keywords=[t]), f'("{t}")') for t in ("a NEAR/2 b", "col:value", "wild*card", "(paren)", "dash-term", "AND", "OR", "NOT", "^caret", "a AND b OR c")),
    ],
)
def test_match_text(request_, want):
    assert match_text(request_) == want


def test_validation():
    got = q(keywords=["a", 3, None], category=" bank ", subcategory="", limit="99", dateFrom=None)
    assert got.keywords == ("a",) and got.category == "bank" and got.subcategory is None and got.limit == 50
    assert q(limit=0).limit == 1 and q(limit="x").limit is None


def test_heuristic():
    assert plan("RIB de credit mutuel j'ai besoin").keywords == ("rib", "credit", "mutuel")
    got = plan("relevé de compte 2023")
    assert (got.date_from, got.date_to) == ("2023-01-01", "2023-12-31")
    assert plan("facture 9999").date_from is None
    assert plan("facture SFR", ("sfr",)).entities == ("sfr",)


def test_planner_falls_back():
    def broken(_):
        raise RuntimeError

    assert plan_with("facture edf", broken).keywords == ("facture", "edf")
    assert plan_with("facture edf", lambda _: {}).keywords == ("facture", "edf")
    assert plan_with("facture edf", lambda _: {"docTypes": ["facture"]}).doc_types == ("facture",)


def test_ladder():
    full = q(docTypes=["a"], entities=["b"], keywords=["c"], notTerms=["d"], category="x")
    rungs = ladder(full)
    assert [(r.keywords, r.not_terms, r.entities) for r in rungs] == [(("c",), ("d",), ("b",)), ((), ("d",), ("b",)), ((), (), ("b",)), ((), (), ())]
    assert all(r.category == "x" for r in rungs) and relaxed(rungs[-1]) is None


@pytest.mark.parametrize("message,want", [("les 3 derniers bulletins", 3), ("mon dernier bulletin", 1), ("les trois factures", 3), ("j'ai besoin d'un RIB", None)])
def test_count(message, want):
    assert requested_count(message) == want
    assert limit_of(message, q(limit=7)) == (want or 7)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "RIB Crédit Mutuel", ["rib"], "bank", "credit_mutuel", "2023-01-05", "relevé identité bancaire"),
        (2, "Relevé", ["releve"], "bank", "credit_mutuel", "2023-01-09", "rib rib rib relevé de compte"),
        (3, "Note", ["note"], "technical", "general", "", "nothing here"),
        (4, "RIB BNP", ["rib"], "bank", "bnp", "2022-02-01", "iban"),
    ]
    return spark.createDataFrame(rows, "id long, title string, tags array<string>, category string, subcategory string, date string, raw_text string")


def ids(df):
    return [r["id"] for r in df.collect()]


def test_ranking(docs):
    assert ids(retrieval.search(docs, q(keywords=["rib"]))) == [4, 1, 2]  # title and tag outweigh the text
    assert ids(retrieval.search(docs, q(docTypes=["rib"], entities=["mutuel"]))) == [1, 2]
    assert ids(retrieval.search(docs, q(keywords=["rib"], notTerms=["relevé de compte"]))) == [4, 1]
    assert ids(retrieval.search(docs, q(keywords=["rib"], category="bank", dateFrom="2023-01-01"))) == [1, 2]
    assert ids(retrieval.search(docs, q(keywords=["???"]))) == []


def test_relaxation_and_fallback(docs):
    hits = retrieval.search(docs, q(docTypes=["rib"], entities=["mutuel"], keywords=["absent"]), relax=True)
    assert [(r["id"], r["rung"]) for r in hits.collect()] == [(1, 1), (2, 1)]
    assert ids(retrieval.retrieve(docs, "rib 2022")) == [4]
    assert ids(retrieval.token_score(docs, "nothing relevant")) == [3]
    assert "#1 RIB" in retrieval.prompt_context(docs, retrieval.search(docs, q(keywords=["rib"]))).first()["context"]


def test_periods(docs):
    assert sorted(ids(retrieval.dedupe_by_period(docs))) == [2, 3, 4]
    assert retrieval.regressed({"mrr": 0.5}, {"mrr": 0.502}) == ["mrr"] and not retrieval.regressed({"mrr": 0.5}, {"mrr": 0.5005})


def test_a_failing_reranker_keeps_the_order(spark):
    hits = spark.createDataFrame([(i, 1.0 / i, i) for i in range(1, 41)], "id long, score double, rank int")
    ids = lambda reranker: [r["id"] for r in retrieval.rerank(hits, 5, reranker=reranker).collect()]

    def raises(h):
        raise RuntimeError("no answer")

    fails_later = lambda h: h.withColumn("relevance", F.raise_error(F.lit("no answer")).cast("double"))
    too_few = lambda h: h.where("id > 3").withColumn("relevance", F.lit(0.9))
    no_numbers = lambda h: h.withColumn("relevance", F.when(F.col("id") != 2, F.lit(0.5)))
    for broken in (raises, fails_later, too_few, no_numbers, lambda h: h):
        with pytest.warns(UserWarning, match="the order stays"):
            assert ids(broken) == [1, 2, 3, 4, 5]
    assert ids(lambda h: h.withColumn("relevance", F.col("id") / 100.0)) == [30, 29, 28, 27, 26]
    assert ids(lambda h: h.withColumn("relevance", F.lit(0.1))) == [] and ids(None) == [1, 2, 3, 4, 5]
