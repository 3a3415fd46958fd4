"""Fixtures of awkward documents, and helpers that compare with brute force."""

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empties, ties, repeated rows, a very long text, and columns named like results."""
    long = "alpha beta gamma delta " * 20_000
    rows = [
        (1, "The cat sat on the mat and the dog ran to the house of the man.", "en", "s1", 1), (1, "The cat sat on the mat and the dog ran to the house of the man.", "en", "s1", 1),
        (2, None, "en", "s1", None), (3, "", None, None, 0), (None, "no id here but some words", "en", "s2", 5), (None, None, None, None, None),
        (4, long, "en", "s3", len(long)), (5, "12 34 !!", "fr", "s1", 8), (6, "été où ça va très bien", "fr", "s2", 3), (7, "été où ça va très bien", "fr", "s3", 3),
        (8, "emoji 😀 and\ttabs\r\n  double  spaces ", "en", "s4", 3), (-9, "x", "en", "s4", 1),
    ]
    df = spark.createDataFrame(rows, DOCUMENTS)
    for clash in ("fingerprint", "component_id", "shard", "size", "n_tokens", "ids", "spans", "score", "lang_pred", "held_out", "fp", "start", "_text", "_row", "key"):
        df = df.selectExpr("*", f"'clash' as {clash}")
    return df


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)
