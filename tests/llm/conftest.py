import pytest

#: Nulls, empty and blank texts, repeated rows, one id with two texts, ties.
ODD = [
    (1, "The quick brown fox jumps over the lazy dog. " * 12),
    (1, "The quick brown fox jumps over the lazy dog. " * 12),
    (2, "The quick brown fox jumps over the lazy dog. " * 12),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "short text"),
    (6, "another text of one id"),
    (None, "no id here"),
    (None, None),
    (7, "Größe ÀÉÎ 日本語 🙂 " * 40),
    (8, "a" * 70_000),
    (9, "line one of some length\n" * 30 + "end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with extra columns whose names clash with results."""
    rows = [(i, t, "x", False, 3, None) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, held_out boolean, n_words int, `TEXT.copy` string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")
