"""What a change of an indexed library costs, and the word functions that it counts with."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.model import STOPWORDS
from foliospark.operators.indexes import IndexedLibrary
from foliospark.operators.store import scratch


def test_deleting_chunks_counts_the_deleted_alone(spark, monkeypatch):
    texts = ["Alpha beta beta the", None, "beta Gamma  ab", "", "Alpha alpha gamma, delta", "delta"]
    rows = [(f"c{i}", i, f"B{i % 2}", "one", t) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "chunk_id string, corpus_pos long, book_title string, chapter string, text string")
    ids = chunks.where("corpus_pos in (1, 2, 4)").select("chunk_id")
    library, other = (IndexedLibrary(spark, scratch(spark, "library")) for _ in range(2))
    library.rebuild(chunks)
    other.rebuild(chunks.join(ids, "chunk_id", "left_anti").select(*chunks.columns))
    with monkeypatch.context() as m:
        m.setattr(IndexedLibrary, "_held", lambda *_: pytest.fail("all statistics of the books are read again"))
        library.delete_ids(ids)
    read = lambda x: sorted(map(tuple, x.statistics().collect()))
    assert read(library) == read(other)
    assert library.size() == (3, 5)


def test_white_space_is_that_of_unicode(spark):
    points = [(i, chr(i)) for i in range(0x10000) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame(points, "id int, c string").withColumn("text", F.concat(F.lit("A"), "c", F.lit("b")))
    slow = F.filter(F.split(F.lower("text"), r"(?U)\s+"), lambda w: w != "")
    assert rows.where(~X.whitespace_tokens("text").eqNullSafe(slow)).count() == 0
    assert rows.where(F.size(X.whitespace_tokens("text")) == 2).count() == 25


def test_long_words_are_the_words_and_the_stopwords(spark):
    texts = [(None,), ("",), ("The an ab abc ABCD x1yz2abc the-cat it's whole",), ("éabcé ab",)]
    rows = spark.createDataFrame(texts, "text string")
    for r in rows.select(X.long_words("text").alias("a"), X.word_tokens("text").alias("b")).collect():
        assert (r["a"] and [w for w in r["a"] if w not in STOPWORDS]) == r["b"]
