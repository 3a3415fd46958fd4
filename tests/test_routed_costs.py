"""Questions that are routed: texts are cut once, and profiles and chapter vectors are read once for all that follows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import bm25, dense, fusion, postings, query, routing, store
from foliospark.operators.indexes import ChunkIndex

from .test_index_passes import CHUNKS, corpus


@pytest.fixture(scope="module")
def chunks(spark):
    vector = F.array(*(F.cos(F.col("page_number") * i).cast("float") for i in (1, 2)))
    out = spark.createDataFrame(corpus(120), CHUNKS).where("corpus_pos is not null").withColumn("section", F.lit("s")).withColumn("embedding", vector)
    return store.stored(out.withColumn("chapter", F.concat(F.lit("x"), F.col("page_number") % 2)), "chunks")


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(0, "alpha epsilon", [1.0, 0.0]), (1, "theta", [0.0, 1.0]), (2, "nothing here", [0.6, 0.8]), (3, "zeta theta eta alpha", [-1.0, 0.0])]
    return store.stored(spark.createDataFrame(rows, "query_id long, question string, embedding array<float>"), "questions")


def counted(df, column):
    """``df`` and an accumulator of how often its rows' ``column`` is computed."""
    n = df.sparkSession.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    return df.withColumn(column, F.udf(seen, df.schema[column].dataType).asNondeterministic()(column)), n


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_profiles_are_read_once_for_a_debug_query(spark, chunks, questions):
    profiles = store.stored(routing.book_profiles(chunks), "profiles")
    seen, n = counted(profiles, "word")
    got = query.debug_queries(chunks, questions, seen)
    assert {r["query_id"] for r in got.select("query_id", "pos").collect()} == {0, 1, 2, 3}
    assert n.value == profiles.count()


def test_profiles_and_chapters_are_read_once_to_ask(spark, chunks, questions):
    profiles = store.stored(routing.book_profiles(chunks), "profiles")
    chapters = routing.chapters_in_order(chunks).withColumn("embedding", F.array(F.col("chapter_pos").cast("float"), F.lit(0.5).cast("float")))
    vectors = store.stored(chapters, "chapters")
    want = rows(query.ask(chunks, questions, profiles, vectors))
    (seen, n), (near, m) = counted(profiles, "word"), counted(vectors, "chapter")
    index = ChunkIndex(chunks.drop("embedding"), chunks)
    got = query.ask(chunks, questions, seen, near, index=index)
    index.release()
    assert rows(got) == want and {r[0] for r in want} == {0, 1, 2, 3}
    assert n.value == profiles.count() and m.value == vectors.count()


def test_one_cut_of_texts_for_postings_and_profiles(spark, chunks, questions):
    seen, n = counted(chunks.drop("embedding"), "text")
    index = ChunkIndex(seen, chunks)
    got = query.debug_queries(chunks, questions, index.profiles, index=index)
    assert n.value == chunks.count()
    assert rows(got) == rows(query.debug_queries(chunks, questions, routing.book_profiles(chunks)))
    assert rows(index.search(questions)) == rows(bm25.top_k(chunks, questions))
    assert rows(fusion.search(chunks, questions, index=index)) == rows(fusion.search(chunks, questions))
    index.release()


@pytest.mark.parametrize("size", [40, 1_000_000])
def test_profiles_of_an_index_are_those_of_texts(spark, monkeypatch, size):
    """Segments of several books, chunks without a book, a place or a text; few and many pairs of a book and a word."""
    chunks = spark.createDataFrame(corpus(120), CHUNKS).withColumn("book_title", F.when(F.col("page_number") % 7 > 0, F.col("book_title")))
    index = postings.index_chunks(chunks.coalesce(1), booked=True, words=size)
    places = lambda df: df.select("book_title", "word", "n", F.col("first").isNull())  # noqa: E731  places count stopwords, which word_tokens leaves out
    word = F.posexplode(X.word_tokens("text")).alias("at", "word")
    plain = chunks.select("book_title", "corpus_pos", word).groupBy("book_title", "word").agg(F.count("*").alias("n"), F.min("corpus_pos").alias("first"))
    assert rows(places(postings.book_words(index))) == rows(places(plain))
    assert rows(routing.profiles_of(postings.book_words(index))) == rows(routing.book_profiles(chunks))
    store.dropped(index)


def test_filters_that_no_row_of_a_task_passes(spark, chunks, questions):
    """A worker failed that had rows, but none for its queries."""
    asked = questions.withColumn("book_filter", F.when(F.col("query_id") > 0, "no book"))
    assert {r["query_id"] for r in dense.top_k(chunks, asked).collect()} == {0}
    assert dense.top_k(chunks, asked.where("query_id > 0")).count() == 0


def test_numbers_of_few_and_many_keys():
    for below in (10, 10_000_000):
        found, at = postings._numbered(np.array([7, 3, 7, 9, 3]), below)
        assert (found.tolist(), at.tolist()) == ([3, 7, 9], [1, 0, 1, 2, 0])
    assert [len(a) for a in postings._numbered(np.empty(0, np.int64), 0)] == [0, 0]
