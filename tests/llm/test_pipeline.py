"""Each stage of the pipeline against a plain version on its own input."""

import corpus_pipeline
import pytest
from conftest import SF
from test_learned import plain_quality
from test_pairs import brute_classes
from test_tokens import check_packing

import __spark_entry__ as contract
from folio.llm import langid
from folio.llm.common import staged
from folio.llm.word_tokens import default_tokenizer


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        out.append(staged(f(spark, out[-1], SF), name))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "ngram_jaccard_join", "best_fit_packing"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_language_stage(stages):
    docs = stages[0].collect()
    _, cosine = langid.fit(stages[0]).predict([d["text"] for d in docs])
    kept = {r["doc_id"] for r in stages[1].collect()}
    near = {d["doc_id"] for d, c in zip(docs, cosine, strict=True) if c >= 0.15 or len(d["text"] or "") < 200}
    assert kept == {d["doc_id"] for d in docs if any(c.isalpha() for c in d["text"] or "")} & near


def test_quality_stage_equals_closed_forms(spark, stages):
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = stages[1].orderBy("doc_id").collect()
    score = plain_quality([d["text"] for d in docs], [labels.get(d["doc_id"]) for d in docs])
    kept = {r["doc_id"] for r in stages[2].collect()}
    clear = [(d["doc_id"], s) for d, s in zip(docs, score, strict=True) if abs(s - 0.3) > 1e-6]
    assert len(clear) > 0.9 * len(docs) and all((i in kept) == (s >= 0.3) for i, s in clear)


def test_quality_stage(spark, stages):
    kept = {r["doc_id"] for r in stages[2].collect()}
    labels = {x["doc_id"]: x["quality"] for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [d["doc_id"] for d in stages[1].collect() if d["doc_id"] in labels]
    assert sum((i in kept) == bool(labels[i]) for i in judged) >= 0.95 * len(judged)


def test_duplicate_stage(stages):
    rows = [(d["doc_id"], d["text"]) for d in stages[2].collect()]
    want = brute_classes(rows, 5, 80)
    assert {r["doc_id"] for r in stages[3].collect()} == set(want.values())


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    check_packing(stages[3].collect(), stages[4].collect(), Tokenizer.from_file(default_tokenizer()), 4096)
    assert {r["doc_id"] for r in stages[4].collect()} == {r["doc_id"] for r in stages[3].collect()}


def test_run_and_registration(spark, stages):
    found = contract.queries()
    assert found["pipeline"](spark, SF).count() == stages[4].count()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in found)] == []


@pytest.fixture(scope="module")
def unlabelled(spark, tmp_path_factory):
    """A folder whose labels are empty: every score is 0.5 and all documents stay."""
    base = tmp_path_factory.mktemp("unlabelled")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base)


def test_odd_rows(spark, odd, unlabelled):
    """Null ids and texts, empty and very long texts, repeated rows, extra and clashing columns."""
    docs = odd.selectExpr("*", "'q' AS lang_pred", "'q' AS quality_score", "1 AS n", "1 AS stats", "1 AS label")
    ids = lambda df: sorted(r["doc_id"] or 0 for r in df.collect())
    language, score, one, pack = (f for _, f in corpus_pipeline.STAGES)
    kept = staged(language(spark, docs, unlabelled), "odd")
    assert kept.columns == docs.columns and ids(kept) == [0, 1, 2, 2, 7, 8, 10, 11]  # 9 is one letter over and over
    good = staged(score(spark, kept, unlabelled), "odd")
    assert good.columns == docs.columns and ids(good) == ids(kept)
    once = staged(one(spark, good, unlabelled), "odd")
    assert once.columns == docs.columns and ids(once) == [0, 1, 7, 8, 10]
    pieces = pack(spark, once, unlabelled).collect()
    assert {r["doc_id"] or 0 for r in pieces} == {0, 1, 7, 8, 10} and sum(r["doc_id"] == 8 for r in pieces) > 1


def test_empty_tables(spark, empty, unlabelled):
    docs = empty
    for name, f in corpus_pipeline.STAGES:
        docs = staged(f(spark, docs, unlabelled), name)
        assert docs.count() == 0
    full = empty.union(spark.createDataFrame([(1, None, None, None, 0, 0.5, 1, "x")], empty.schema))
    for name, f in corpus_pipeline.STAGES:  # nothing is left after the first stage
        full = staged(f(spark, full, unlabelled), name)
        assert full.count() == 0
