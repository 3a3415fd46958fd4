"""Structure building on hand-made books."""


from foliospark.operators import chunking, structure


def lines(spark, rows, book="b"):
    return spark.createDataFrame([(book, i, page, text, float(size)) for i, (page, text, size) in enumerate(rows)], "book_title string, line_no long, page_number int, text string, size double")


def test_body_size_ties_go_to_the_first_seen(spark):
    rows = [(1, "a", 12), (1, "b", 10), (1, "c", 10), (1, "d", 12)]
    assert structure.body_size(lines(spark, rows)).first()["body_size"] == 12
    assert structure.body_size(lines(spark, [])).count() == 0


def test_heading_bounds_are_inclusive(spark):
    rows = [(1, "t", 15), (1, "s", 12), (1, "n", 11.9), *[(1, "x", 10)] * 5]
    levels = [r["level"] for r in structure.heading_levels(lines(spark, rows), page_offset=2).orderBy("line_no").collect()]
    assert levels == ["chapter", "section", None] + [None] * 5
    assert structure.heading_levels(lines(spark, rows), page_offset=2).first()["page_number"] == 3


def test_groups(spark):
    rows = [
        (1, "before", 10), (1, "One", 20), (1, "Two", 20), (1, "A", 12), (2, "a1", 10), (3, "a2", 10),
        (3, "A", 12), (3, "a3", 10), (4, "Three", 20), (4, "c1", 10), (4, "Empty", 12),
    ]
    got = [tuple(r) for r in structure.heading_groups(structure.heading_levels(lines(spark, rows))).orderBy("group_index").collect()]
    assert got == [
        ("b", 0, "Unknown", "Unknown", 1, "before"),
        ("b", 1, "Two", "A", 2, "a1 a2"),
        ("b", 2, "Two", "A", 3, "a3"),
        ("b", 3, "Three", "Unknown", 4, "c1"),
    ]


def test_toc_ranges_nest_and_clamp(spark):
    toc = spark.createDataFrame(
        [("b", 0, 1, "1", 1), ("b", 1, 2, "1.1", 2), ("b", 2, 2, "1.2", 2), ("b", 3, 1, "2", 9), ("c", 0, 1, "x", 5)],
        "book_title string, pos int, level int, title string, start_page int",
    )
    pages = spark.createDataFrame([("b", 12), ("c", 3)], "book_title string, n_pages int")
    got = {(r["book_title"], r["pos"]): r["end_page"] for r in structure.toc_ranges(toc, pages).collect()}
    assert got == {("b", 0): 8, ("b", 1): 2, ("b", 2): 8, ("b", 3): 12, ("c", 0): 5}
    assert {r["content_start"] for r in structure.content_start(toc, toc).collect()} == {1, 5}
    books = spark.createDataFrame([("none",)], "book_title string")
    assert structure.content_start(toc, books).first()["content_start"] == 1


def test_heading_ranges_are_not_clamped(spark):
    rows = [(3, "A", 20), (3, "B", 20), *[(4, "x", 10)] * 4]
    pages = spark.createDataFrame([("b", 9)], "book_title string, n_pages int")
    got = structure.heading_ranges(structure.heading_levels(lines(spark, rows)), pages).orderBy("pos").collect()
    assert [(r["title"], r["start_page"], r["end_page"]) for r in got] == [("A", 3, 2), ("B", 3, 9)]


def test_numbered_groups_merge(spark):
    ranges = spark.createDataFrame(
        [("b", 0, "3.1 Conv", 5, 8, 1), ("b", 1, "σ", 6, 6, 1), ("b", 2, "1 Intro", 1, 4, 1), ("b", 3, "3.2 Pool", 9, 11, 1), ("b", 4, "4 Index", 12, 13, 1)],
        "book_title string, pos int, title string, start_page int, end_page int, level int",
    )
    got = [(r["title"], r["start_page"], r["end_page"]) for r in structure.leading_number_groups(ranges).orderBy("pos").collect()]
    assert got == [("Chapter 3", 5, 11), ("Chapter 1", 1, 4)]


def test_reassign_takes_the_first_range(spark):
    chunks = spark.createDataFrame([("b", "A", 1), ("b", "A", 3), ("b", None, 9), ("other", "Z", 50)], "book_title string, chapter string, page_number int")
    ranges = spark.createDataFrame([("b", 0, "A", 1, 2), ("b", 1, "B", 2, 5)], "book_title string, pos int, title string, start_page int, end_page int")
    got = sorted((r["page_number"], r["action"], r["new_chapter"]) for r in structure.reassign(chunks, ranges).collect())
    assert got == [(1, "kept", "A"), (3, "relabelled", "B"), (9, "removed", None), (50, "kept", "Z")]
    assert structure.reassign_chapters(chunks, ranges).columns == chunks.columns
    assert structure.reassign_chapters(chunks, ranges.limit(0)).count() == 4


def test_validation(spark):
    rows = spark.createDataFrame(
        [("c", "t", "b", "3", "0"), ("c", "t", "b", "iv", "0"), (None, "t", "b", "1", "0"), ("c", "t", None, "1", "0")],
        "chunk_id string, text string, book_title string, page_number string, chunk_index_on_page string",
    )
    got = [(r["valid"], r["reason"], r["chapter"]) for r in chunking.validated(rows).collect()]
    assert got == [(True, None, "Unknown"), (False, "page_number", "Unknown"), (False, "chunk_id", "Unknown"), (False, "book_title", "Unknown")]
    assert chunking.require_valid(rows.limit(1)).count() == 1


def test_wire_round_trip_and_collisions(spark):
    groups = spark.createDataFrame([("My Book", 0, "C", "S", 1, "word " * 400), ("my_book", 0, "C", "S", 1, "x")], "book_title string, group_index int, chapter string, section string, page_number int, text string")
    chunks = chunking.build_chunks(groups)
    wire = chunking.to_wire(chunks)
    assert chunking.from_wire(wire).select("chunk_id", "page_number").count() == chunks.count()
    assert [r["chunk_id"] for r in chunking.id_collisions(chunks).collect()] == ["my_book_p1_g0_c0"]
    first = chunks.where("book_title = 'My Book'").orderBy("corpus_pos").collect()
    assert [r["chunk_index_on_page"] for r in first] == list(range(len(first)))
