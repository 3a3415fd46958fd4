"""What a reader, a writer and a worker hold at once does not grow with a task's rows."""

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from foliospark.operators import postings, store


def row_groups(table) -> list[int]:
    """Rows of each row group of a stored table."""
    metas = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in table.inputFiles()]
    return [m.row_group(i).num_rows for m in metas for i in range(m.num_row_groups)]


def chunks(spark, n: int):
    return spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("chunk_id"), F.col("id").alias("corpus_pos"), F.lit("A").alias("book_title"), F.lit("x").alias("chapter"),
        F.concat_ws(" ", F.lit("a"), "id", F.col("id") % 7).alias("text"),
    )


def test_segments_are_row_groups(spark):
    """A task's segments in one row group were held at once by the writer, and by every reader."""
    index = postings.index_chunks(chunks(spark, 400), words=30)
    sizes = row_groups(index)
    assert set(sizes) == {1} and len(sizes) == index.count() >= 40
    store.dropped(index)


def test_workers_are_given_bounded_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        postings.segments(chunks(spark, 4))
        assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").removesuffix("b")) <= 4 << 20
    finally:
        if before is not None:
            spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_segments_of_a_ranked_index_are_row_groups(spark):
    from foliospark.llm import lexical

    docs = chunks(spark, 400).select(F.col("corpus_pos").alias("doc_id"), "text")
    index = lexical.build_index(docs, segment_terms=30)
    sizes = row_groups(index.segments)
    assert set(sizes) == {1} and len(sizes) >= 40
    index.release()


def test_filters_gather_before_they_merge(monkeypatch):
    """Every text cost a merge of all that its file had before."""
    import numpy as np
    import pyarrow as pa

    from foliospark.operators import indexes

    texts = [f"text {i} of words {i * i}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["b"] * 300), pa.array(["f"] * 200 + ["g"] * 100), pa.array(texts)], names=["book_key", "file", "text"])
    merges, unique = [], np.unique
    want = [indexes.bloom(unique(np.concatenate([indexes.trigrams(t) for t in some]))) for some in (texts[:200], texts[200:])]
    monkeypatch.setattr(np, "union1d", lambda a, b: merges.append(1) or unique(np.concatenate([a, b])))
    assert [x for b in indexes._filters(iter([batch])) for x in b.column("bits").to_pylist()] == want
    assert len(merges) < 10
    monkeypatch.setattr(indexes, "MERGED", 64)  # merged many times: the same
    assert [x for b in indexes._filters(iter([batch])) for x in b.column("bits").to_pylist()] == want


def test_large_books_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "FILE_ROWS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        library = store.Library(spark, f"file://{tmp_path}/lib")
        library.rebuild(chunks(spark, 100).coalesce(1))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r["file"] for r in library.manifest().where("file is not null").collect()]
    assert len({f.split("-")[1] for f in files}) > 1
    assert library.read().count() == 100


def test_dense_search_holds_few_scores(spark, monkeypatch):
    """All queries' scores with a piece of the rows were held at once."""
    import numpy as np
    import pyarrow as pa

    from foliospark.operators import dense

    rng = np.random.default_rng(3)
    block = [(i, rng.normal(size=4), None, None) for i in range(1000)]
    rows = pa.RecordBatch.from_arrays(
        [pa.array([f"c{i}" for i in range(50)]), pa.array(range(50), pa.int64()), pa.array(["A"] * 50), pa.array(["x"] * 50), pa.array([rng.normal(size=4).tolist() for _ in range(50)], pa.list_(pa.float64()))],
        names=["chunk_id", "corpus_pos", "book_title", "chapter", "embedding"],
    )
    sizes, rounded = [], np.round
    monkeypatch.setattr(dense.np, "round", lambda a, *args, **more: sizes.append(len(a)) or rounded(a, *args, **more))
    kept: dict = {}
    dense._keep_best(kept, dense._by_length(block, range(len(block))), rows, 3, 6)
    assert max(sizes) <= 256 and len(kept) == 1000
    m = np.array(rows.column("embedding").to_pylist())
    for i, v, _, _ in block:
        assert [c for _, _, c in kept[i]] == [f"c{k}" for k in np.argsort(-rounded(m @ v, 6), kind="stable")[:3]]


def test_splitting_is_given_bounded_batches(spark):
    from foliospark.operators import chunking

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    try:
        chunking.split_groups(chunks(spark, 2).select("chunk_id", "text"))
        assert 0 < int(spark.conf.get(name).removesuffix("b")) <= 4 << 20
    finally:
        if before is not None:
            spark.conf.set(name, before)
