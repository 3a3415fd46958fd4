"""The index of a write comes of one cut of its texts; a deletion moves no text."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X
from foliospark.operators import postings, store
from foliospark.operators.indexes import IndexedLibrary

CHUNKS = "chunk_id string, corpus_pos long, book_title string, chapter string, page_number int, text string"


def corpus(n: int) -> list[tuple]:
    random.seed(7)
    parts = ["alpha", "beta-gamma", "the", "alpha,alpha", "x1yzw2abc", "ab", "É", "éabcé", "Delta\x1cepsilon", "zeta eta", "\x85", "it's", "İstanbul", "ΟΔΟΣ", "a\x1f", "theta"]
    text = lambda i: None if i % 13 == 0 else "" if i % 17 == 0 else "".join(random.choice(parts) + random.choice([" ", "  ", "\n", " ", "\t"]) for _ in range(random.randrange(1, 30)))
    return [(f"c{i}", None if i % 19 == 0 else n - i, f"B{i % 3}", "x", i, text(i)) for i in range(n)]


def test_words_of_segments_are_those_of_texts(spark):
    chunks = spark.createDataFrame(corpus(120), CHUNKS)
    for size in (40, 1_000_000):
        one = postings.segments(chunks.coalesce(1), words=size, counted=True)
        got = one.select(F.explode(F.arrays_zip("words", "word_ns", "word_firsts")).alias("w")).groupBy("w.words").agg(F.sum("w.word_ns"), F.min("w.word_firsts"))
        want = chunks.select("corpus_pos", F.posexplode(X.word_tokens("text")).alias("i", "word")).groupBy("word").agg(F.count("*").alias("n"))
        # places count stopwords, which word_tokens leaves out
        places = chunks.select("corpus_pos", F.posexplode(X.long_words("text")).alias("at", "word")).groupBy("word").agg(F.min(F.shiftleft("corpus_pos", 24) + F.col("at")).alias("first"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.join(places, "word").collect()))
        plain = chunks.select(F.explode(F.array_distinct(X.whitespace_tokens("text"))).alias("term")).groupBy("term").count()
        assert sorted(map(tuple, postings.frequencies(one).collect())) == sorted(map(tuple, plain.collect()))


def test_places_past_the_last_that_fits(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(postings, "_AT", 3)
    terms, code = pa.array(["aaa", "bbb-ccc"]), np.array([0, 0, 1, 1, 0])
    words, ns, firsts = postings._words(terms, code, np.array([0, 4, 1], "<i4"), pa.array([1, 2, None], pa.int64()))
    assert (words.to_pylist(), ns.to_pylist()) == (["aaa", "bbb", "ccc"], [3, 2, 2])
    assert [x & 3 for x in firsts.to_pylist()] == [0, 2, 3]


@pytest.mark.parametrize("few", [True, False])
def test_deleting_chunks_shuffles_no_text(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(store, "DELETED", 3)
    rows = corpus(90)
    library = IndexedLibrary(spark, store.scratch(spark, "library"))
    library.rebuild(spark.createDataFrame(rows, CHUNKS))
    plans, write = [], library._write
    monkeypatch.setattr(library, "_write", lambda chunks, **more: plans.append(chunks._jdf.queryExecution().executedPlan().toString()) or write(chunks, **more))
    gone = {f"c{i}" for i in range(0, 90, 11)}
    library.delete_ids(spark.createDataFrame([(c,) for c in sorted(gone)], "chunk_id string"))
    assert not few or plans and "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    kept = [r for r in rows if r[0] not in gone]
    assert sorted(r["chunk_id"] for r in library.read().collect()) == sorted(r[0] for r in kept)
    again = IndexedLibrary(spark, store.scratch(spark, "library"))
    again.rebuild(spark.createDataFrame(kept, CHUNKS))
    for f in (IndexedLibrary.statistics, IndexedLibrary.profiles):
        assert sorted(map(tuple, f(library).collect())) == sorted(map(tuple, f(again).collect()))


def test_a_large_book_is_read_by_several_tasks(spark, tmp_path):
    """Six files of a large book and many small ones: by Spark's bounds one task had the large book."""
    path = f"file://{tmp_path}/files"
    big, small = spark.range(800_000).repartition(6), spark.range(10).repartition(10)
    big.select("id", F.lit(0).alias("book")).unionByName(small.select("id", F.lit(1).alias("book"))).write.partitionBy("book").parquet(path)
    most = lambda: max(len(p) for p in spark.read.parquet(path).rdd.glom().map(lambda rows: [None] * len(rows)).collect())
    before = most()
    with store.small_tasks(spark):
        assert most() < before
    assert not {*store.TASK_BYTES} & {*spark.conf.getAll}
    with store.small_tasks(spark):
        assert {*store.TASK_BYTES} <= {*spark.conf.getAll}
    assert store.FILE_ROWS <= 10_000  # 18,703 documents of one book were one file
