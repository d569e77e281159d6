import pytest

SF = "/root/testdata/sf0.001"

TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away", "en", "a"),
    (3, None, "en", None),
    (4, "", None, "b"),
    (5, "   \n\t ", "fr", "b"),
    (6, "12345 !!! ---", "fr", "c"),
    (None, "une phrase sans identifiant mais avec des mots", "fr", "c"),
    (7, "naïve ß ÀÉ 日本語 🎉 don't ²½ <|endoftext|> x<|startoftext|>y", "de", "d"),
    (8, "word " * 30_000, "en", "a"),
    (9, "x" * 40_000, None, "a"),
    (10, "two words", "en", "a"),
    (11, "Two Words", "en", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, extra and clashing column names."""
    rows = [(i, t, lang, s, len(t or ""), 0.5, 1, "x") for i, t, lang, s in TEXTS]
    kind = "doc_id long, text string, lang string, source string, n_chars long, score double, size int, shard string"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
