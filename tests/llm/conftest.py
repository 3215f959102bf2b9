import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SMALL


@pytest.fixture(scope="session")
def small(spark):
    """Tables of the smallest test data by name."""
    return lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")


CLASHES = ("id", "size", "key", "hash", "n", "label", "row", "range", "drops", "source_size", "component", "hub", "vector")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, ties, and extra columns with clashing names."""
    long_text = " ".join(f"word{i % 977} and more of it" for i in range(30_000))
    rows = [
        (1, "The same line of text, long enough to count\nSecond line here", "en", "a", 1),
        (1, "The same line of text, long enough to count\nSecond line here", "en", "a", 1),
        (2, "the same line of text, long enough to count  \nother words follow here", "en", "a", 2),
        (3, "  THE SAME LINE OF TEXT, LONG ENOUGH TO COUNT", "en", None, 3),
        (4, None, "en", "b", None), (5, "", None, "b", 0), (6, " \t\n\n ", "de", "b", 3), (7, "1234 5678 !!", None, None, 1),
        (8, long_text, "en", "b", len(long_text)), (9, long_text, "fr", "c", len(long_text)), (None, "a text without an id", "en", "a", 1),
        (None, None, None, None, None), (10, "é", "fr", "c", 1), (11, "one", "en", "c", 3),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(c) for c in CLASHES})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("false")
