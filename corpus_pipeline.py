"""Corpus pipeline: language, quality, near duplicates, packing. Part of the subpackage ``llm``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import langid, ngram_join, packing, quality
from folio.llm.common import read_table, staged
from folio.session import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones.

    Null texts, texts without a letter, and longer texts far from every learned language go (see ``langid.identified``).
    Texts are read whole; repeated rows and null ids stay; an empty table gives none; columns of any name are kept.
    """
    ship(spark)
    return langid.identified(docs, langid.fit(docs))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as good, learned from the labels of those at hand; the others go.

    Null and empty texts have a score like any other; texts are read whole; repeated rows and null ids stay; without
    labels every score is 0.5 and all stay; an empty table gives none; columns of any name are kept.
    """
    ship(spark)
    return quality.good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each class of similar ones: five-word shingles, similarity 0.8 or more.

    Null, empty and wordless texts link with nothing and stay; texts of any length count whole; of rows that share
    an id one stays, rows without an id all do; an empty table gives none; columns of any name are kept.
    """
    ship(spark)
    return ngram_join.one_of_each(docs, k=5, percent=80)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' pieces and their places in sequences of 4,096 ids.

    A null or empty text is its end id alone; longer texts are cut, none is dropped; repeated rows and null ids are
    packed each; an empty table gives none; only ``doc_id`` and ``text`` are looked at.
    """
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

#: A learned classifier and tokenizer ids have no SQL; tests/llm/test_pipeline.py holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: one row a packed piece."""
    docs = read_table(spark, sf_dir, "documents")
    *stages, (_, last) = STAGES
    for name, stage in stages:
        docs = staged(stage(spark, docs, sf_dir), name)
    return last(spark, docs, sf_dir)
