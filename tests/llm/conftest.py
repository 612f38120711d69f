from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"
#: Columns whose names the operators use themselves.
CLASHES = ("key", "size", "score", "n", "rep", "hub", "part", "host", "_doc", "taken", "h", "grp", "length", "rank", "vector", "rule", "path")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat and then it slept for a long while.", "en", "a"), (2, None, "en", "a"), (3, "", None, "b"), (4, " \t\n ", "de", None),
        (5, long, "en", None), (6, "x" * 300_000, None, "b"), (7, "The cat sat on the mat and then it slept for a long while.", None, "a"),
        (7, "The cat sat on the mat and then it slept for a long while.", None, "a"), (None, "no id at all in this row here", "fr", "c"), (8, "12345 678 !!!", "es", "c"),
        (9, "Ünï çödé <|endoftext|> | don't | bars\u00a0here \u2003", "fr", "d"), (10, "two words", "en", "d"), (11, "Two  WORDS", "en", "d"), (12, "nul\0byte and\u0085next", "en", "e"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASHES:
        df = df.withColumn(c, __import__("pyspark").sql.functions.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
