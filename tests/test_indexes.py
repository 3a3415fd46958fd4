"""Postings with block maxima, and a library that keeps its indexes, against plain versions and recounts."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import bm25, dense, indexes, postings, query, routing
from foliospark.operators.indexes import IndexedLibrary
from foliospark.operators.store import dropped, stored

from .test_retrieval import plain_bm25

CHUNKS = "chunk_id string, corpus_pos long, book_title string, chapter string, page_number int, text string, embedding array<float>"


def corpus(n, seed=1, books=6):
    """Chunks whose words follow their book; some are empty, null, repeated or of one common word."""
    random.seed(seed)
    rows = []
    for i in range(n):
        book = i * books // n
        words = [f"t{book}w{random.randrange(30)}" if random.random() < 0.5 else f"c{int(random.paretovariate(0.7)) % 40}" for _ in range(random.randrange(3, 40))]
        text = None if i % 41 == 0 else "" if i % 43 == 0 else "the the" if i % 17 == 0 else " ".join(words)
        v = [math.cos(i * 0.37), math.sin(i * 0.37), math.cos(i * 1.1), book / 3]
        rows.append((f"k{i:04}", i, f"Book {book}", "even" if i % 2 == 0 else None, i // 5, text, None if i % 29 == 0 else v if i % 31 else v[:2]))
    return rows


def questions():
    random.seed(9)
    out = [" ".join(random.choice([f"t{b}w{random.randrange(30)}", f"c{random.randrange(9)}"]) for _ in range(random.randrange(1, 9))) for b in range(6) for _ in range(4)]
    return out + ["the", "nothing known", "", None, "t1w1 t1w1 T1W1 c1", "the the t2w3"]


@pytest.mark.parametrize("words", [150, 100_000])
def test_postings_against_plain_scores(spark, words):
    """Many segments or one, ranges of 8, filters, blocks of a few questions, with and without chunks of score zero."""
    rows = corpus(400)
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(i, q, f"Book {i % 6}" if i % 3 == 0 else None, "even" if i % 4 == 1 else None) for i, q in enumerate(questions())]
    q = spark.createDataFrame(asked, "query_id long, question string, book_filter string, chapter_filter string")
    index = postings.index_chunks(chunks, words=words, width=8)
    if words < 1000:
        assert index.count() > 20
    texts = [r[5] for r in rows]
    for drop_zero in (False, True):
        got = collections.defaultdict(list)
        for r in postings.top_k(index, q, depth=7, drop_zero=drop_zero, block_bytes=300).orderBy("query_id", "rank0").collect():
            got[r["query_id"]].append((r["chunk_id"], r["score"]))
        for i, question, book, chapter in asked:
            scores = [round(s, 6) + 0.0 for s in plain_bm25(texts, question or "")]
            own = set((question or "").lower().split())
            mine = [k for k, r in enumerate(rows) if book in (None, r[2]) and chapter in (None, r[3]) and (not drop_zero or own & set((r[5] or "").lower().split()))]
            want = sorted(mine, key=lambda k: (-scores[k], k))[:7]
            assert [c for c, _ in got[i]] == [rows[k][0] for k in want], (question, book, chapter)
            assert [s for _, s in got[i]] == pytest.approx([scores[k] for k in want], abs=2e-6)
    dropped(index)


def test_blocks_are_skipped_and_few_rows_are_sent(spark):
    chunks = spark.createDataFrame(corpus(3000), CHUNKS)
    q = spark.createDataFrame([(i, f"t{i}w{i} t{i}w9 c1") for i in range(6)], "query_id long, question string")
    q = bm25.with_filters(q)
    index = stored(postings.segments(chunks.coalesce(1), width=16), "one")
    blocks, skipped = postings.skipped_blocks(index, q, depth=5)
    assert blocks > 200 and skipped > 0.5 * blocks
    assert postings.skipped_blocks(index, q.limit(0)) == (0, 0)
    # what a task sends is its best five a question, of some thousand chunks with a common word
    shared = postings._sent(postings.weighted(postings.frequencies(index), 3000), next(postings.question_blocks(q)))
    sent = index.mapInArrow(postings._search(shared, 15.0, 5, True, 6), postings._FOUND).where("number is not null")
    assert sent.count() == 30
    plan = postings.top_k(index, q, depth=5)
    assert plan.count() == 30


def test_segments_of_one_book(spark):
    chunks = spark.createDataFrame(corpus(300), CHUNKS).repartition(1, "book_title").sortWithinPartitions("book_title")
    titles = [r["book_title"] for r in postings.segments(chunks, by_book=True, words=200).collect()]
    assert all(len(set(t)) == 1 for t in titles) and len(titles) > 12 and sum(map(len, titles)) == 300
    assert postings.segments(chunks.limit(0)).count() == 0


# --- the library -----------------------------------------------------------------------------


def recount(rows):
    """Statistics of chunks ``(id, pos, book, chapter, page, text, vector)``, as a library keeps them."""
    out = collections.Counter()
    for r in rows:
        words = (r[5] or "").lower().split()
        out["size", "n_chunks"] += 1
        out["size", "n_words"] += len(words)
        for w in set(words):
            out["df", w] += 1
    return {k: v for k, v in out.items() if v}


def kept(library, version=None):
    rows = library.statistics(version).where("kind != 'word'").collect()
    return {(r["kind"], r["term"]): r["value"] for r in rows}


@pytest.fixture(scope="module")
def changed(spark, tmp_path_factory):
    """A library after changes in random order, and what it should hold at each version; deltas are added up after three."""
    monkeypatch = pytest.MonkeyPatch()
    monkeypatch.setattr(indexes, "COMPACT", 3)
    library = IndexedLibrary(spark, f"file://{tmp_path_factory.mktemp('lib')}/lib")
    random.seed(4)
    rows, history = corpus(240), {}
    now = {r[2]: [x for x in rows if x[2] == r[2]] for r in rows}
    library.rebuild(spark.createDataFrame(rows, CHUNKS))
    history[1] = [r for own in now.values() for r in own]
    for step in range(2, 9):
        book = f"Book {random.randrange(7)}"
        kind = random.choice(["upsert", "upsert", "delete", "ids"])
        if kind == "upsert":
            now[book] = [(f"{r[0]}-{step}", r[1], book, r[3], r[4], f"{r[5] or ''} step{step} c1", r[6]) for r in random.sample(rows, 9)]
            library.upsert(spark.createDataFrame(now[book], CHUNKS))
        elif kind == "delete":
            now.pop(book, None)
            library.delete_book(book)
        else:
            gone = {r[0] for own in now.values() for r in own if random.random() < 0.05}
            now = {b: [r for r in own if r[0] not in gone] for b, own in now.items()}
            library.delete_ids(spark.createDataFrame([(c,) for c in sorted(gone)] or [("none",)], "chunk_id string"))
        history[step] = [r for own in now.values() for r in own]
    yield library, history
    monkeypatch.undo()


def test_statistics_by_deltas_equal_a_recount(spark, changed):
    library, history = changed
    for version, rows in history.items():
        assert sorted(r["chunk_id"] for r in library.read(version=version).collect()) == sorted(r[0] for r in rows)
        if version in (1, 2, 5, 8):  # past the version at which deltas are added up
            assert kept(library, version) == recount(rows)
    assert kept(library) == recount(history[8]) and library.size() == (len(history[8]), recount(history[8]).get(("size", "n_words"), 0))
    words = lambda c, *by: c.where("word is not null").select("book_title", "word", F.round("score", 6), "rank")
    assert sorted(map(tuple, words(library.profiles()).collect())) == sorted(map(tuple, words(routing.book_profiles(library.read())).collect()))


def test_a_commit_counts_what_changed_only(spark, changed, monkeypatch):
    library, history = changed
    opened = []
    part = library._part
    monkeypatch.setattr(library, "_part", lambda name, schema, pairs: opened.append((name, len(pairs))) or part(name, schema, pairs))
    book = history[8][0][2]
    library.upsert(spark.createDataFrame([r for r in history[8] if r[2] == book], CHUNKS))
    assert opened and all(n <= 1 for _, n in opened)  # the book as it was, and as it is
    assert kept(library) == recount(history[8])


def test_search_from_stored_postings(spark, changed):
    library, history = changed
    q = bm25.with_filters(spark.createDataFrame([(i, w) for i, w in enumerate(questions())], "query_id long, question string"))
    for version in (5, 8):
        rows = lambda df: sorted(map(tuple, df.select("query_id", "rank0", "chunk_id", "score").collect()))
        assert rows(library.search(q, depth=6, version=version)) == rows(bm25.top_k(library.read(version=version), q, depth=6))


def test_changes_between_versions(spark, changed):
    library, history = changed
    for old, new in ((1, 2), (3, 8), (8, 3), (4, 4)):
        a, b = ({(r[0], r[2], r[5]) for r in history[v]} for v in (old, new))
        got = library.changes(old, new).collect()
        assert sorted((r["change"], r["chunk_id"], r["book_title"]) for r in got) == sorted([("delete", *x[:2]) for x in a - b] + [("insert", *x[:2]) for x in b - a])
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(library.read(pages=(3, 9), version=5)) == sorted(r[0] for r in history[5] if 3 <= r[4] <= 9)
    assert ids(library.read(chapter="even", version=5)) == sorted(r[0] for r in history[5] if r[3] == "even")


def files(df):
    return set(df.inputFiles())


def test_files_read_do_not_grow_with_versions(spark, tmp_path):
    library = IndexedLibrary(spark, f"file://{tmp_path}/lib")
    rows = [r for r in corpus(60, books=3)]
    one = spark.createDataFrame(rows, CHUNKS).coalesce(1)
    library.rebuild(one)
    first = len(files(library.read()))
    for _ in range(3):
        library.upsert(one.where("book_title = 'Book 1'"))
    assert len(files(library.read())) == first == library.manifest().where("file is not null").count() == 3
    assert len(files(library.read("Book 1"))) == 1 and len(files(library.read(pages=(0, 2)))) == 1
    listed = library.manifest().where("file is not null").orderBy("first_page").collect()
    assert [(r["n_rows"], r["first_page"], r["last_page"], r["chapters"]) for r in listed] == [(20, 0, 3, ["even"]), (20, 4, 7, ["even"]), (20, 8, 11, ["even"])]
    with pytest.raises(ValueError):
        library.upsert(one.drop("page_number"))
    library.delete_book("Book 0")
    library.vacuum()
    assert library.read().count() == 40 and kept(library) == recount([r for r in rows if r[2] != "Book 0"])
    folders = {p.name for part in ("data", "postings", "words", "trigrams") for p in (tmp_path / "lib" / part).iterdir()}
    assert len(folders) == 2 and len(list((tmp_path / "lib" / "statistics").iterdir())) == 1
    assert library.nearest(spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id int, embedding array<float>"), exact=True).count() == 20


def test_nearest_lists(spark, tmp_path):
    """Lists that are not probed are filtered out as partitions; recall; exact search; learning anew; other lengths, nulls."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    rows = []
    for i in range(1200):
        v = centres[i % 20] + 0.3 * rng.normal(size=16)
        rows.append((f"v{i:04}", i, f"B{i % 4}", None, i, "x", (v / np.linalg.norm(v)).tolist() if i % 100 else None if i % 200 else [1.0, 2.0]))
    library = IndexedLibrary(spark, f"file://{tmp_path}/lib")
    library.rebuild(spark.createDataFrame(rows[:600], CHUNKS))
    library.upsert(spark.createDataFrame([(*r[:2], "late", *r[3:]) for r in rows[600:]], CHUNKS))
    q = spark.createDataFrame([(f"q{i}", r[6]) for i, r in enumerate(rows) if i % 50 == 7], "query_id string, embedding array<float>")
    found = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = found(library.nearest(q, depth=10, exact=True))
    assert exact == found(dense.top_k(library.read(), q, depth=10)) and len(exact) == 240
    for learned in (False, True):
        some = library.nearest(q, depth=10, probes=6)
        recall = len(found(some) & exact) / len(exact)
        assert recall >= 0.9, recall
        plan = some._jdf.queryExecution().executedPlan().toString()
        pruned = [line for line in plan.split("\n") if "PartitionFilters" in line and "list" in line.split("PartitionFilters")[1]]
        assert pruned
        if not learned:
            library.relearn()
            assert found(library.nearest(q, depth=10, exact=True)) == exact
    short = spark.createDataFrame([(1, [0.6, 0.8])], "query_id int, embedding array<float>")
    assert found(library.nearest(short, depth=3, probes=1)) == found(library.nearest(short, depth=3, exact=True)) != set()
    library.vacuum()
    assert len(list((tmp_path / "lib" / "vectors").iterdir())) == 1


@pytest.mark.parametrize("kind, ids", [("int", [1, 2]), ("smallint", [1, 2]), ("string", ["a", "b"]), ("long", [1, None])])
def test_dense_ids_of_any_type(spark, kind, ids):
    chunks = spark.createDataFrame([("c0", None, "A", None, [1.0, 0.0]), ("c1", 5, "A", None, [1.0, 0.0]), (None, 1, "A", None, [0.0, 1.0])], "chunk_id string, corpus_pos int, book_title string, chapter string, embedding array<double>")
    q = spark.createDataFrame([(i, [1.0, 0.5]) for i in ids], f"query_id {kind}, embedding array<double>")
    got = dense.top_k(chunks, q, depth=3)
    assert got.schema["query_id"].dataType.simpleString() == {"long": "bigint"}.get(kind, kind)
    assert [r["chunk_id"] for r in got.where("query_id is not null").orderBy("query_id", "rank0").collect()][:3] == ["c0", "c1", None]
    assert got.count() == 6


# --- substrings ------------------------------------------------------------------------------


def test_keyword_opens_few_files(spark, tmp_path):
    library = IndexedLibrary(spark, f"file://{tmp_path}/lib")
    rows = [(f"c{i}", i, f"B{i % 20}", None, i, f"words of book {i % 20} ÉTÉ{i} " + "abc " * (i % 20 == 7) + ("İstanbul 😀x" if i == 33 else ""), None) for i in range(200)] + [("n", 999, "B3", None, 1, None, None), ("e", 1000, "B3", None, 1, "", None)]
    library.rebuild(spark.createDataFrame(rows, CHUNKS).coalesce(2))
    total = library.manifest().where("file is not null").count()
    chunks = library.read()
    for keyword, most in (("ABC ABC", 1), ("été77", 3), ("abc", 2), ("not there at all", 2), ("of book 1", total), ("é", total), ("İSTANBUL", 2), ("l 😀X", 2), ("😀X", total), ("b", total)):
        assert library.holding(keyword).count() <= most, keyword
        got, want = (sorted(map(tuple, f(keyword).select("chunk_id", "book_title", "snippet").collect())) for f in (library.keyword_search, lambda k: query.keyword_search(chunks, k)))
        assert got == want, keyword
    assert [r["chunk_id"] for r in library.keyword_search("of BOOK 7", book="B7", limit=2).collect()] == ["c7", "c27"]
    assert library.holding("abc", book="B7").count() == 1


def test_filters_have_no_false_negatives():
    random.seed(6)
    texts = ["".join(random.choice("abcdeé😀 ") for _ in range(random.randrange(0, 60))) for _ in range(300)]
    raw = np.frombuffer(indexes.bloom(np.unique(np.concatenate([indexes.trigrams(t) for t in texts]))), np.uint8)
    assert all(indexes.may_hold(raw, indexes.trigrams(t)) for t in texts)
    false = sum(indexes.may_hold(raw, indexes.trigrams("".join(random.choice("fghijklm") for _ in range(8)))) for _ in range(500))
    assert false < 5 and len(indexes.trigrams("ab")) == 0
