"""Ranking, fusion, routing and metrics on small tables, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from foliospark.operators import bm25, dense, evaluate, fusion, query, routing

CHUNKS = "chunk_id string, corpus_pos long, book_title string, chapter string, section string, page_number int, text string, embedding array<float>"


@pytest.fixture(scope="module")
def chunks(spark):
    texts = ["red fox red", "blue fox", "green frog", "blue blue sky", "", None, "fox frog sky red", "unrelated words here"]
    rows = [(f"c{i}", i, "B1" if i % 2 else "B2", "en" if i < 4 else "fr", "s", i, t, [math.cos(i), math.sin(i)]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, CHUNKS)


def plain_bm25(texts, question):
    docs = [(t or "").lower().split() for t in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    vocabulary = {w for d in docs for w in d}
    df = {w: sum(w in d for d in docs) for w in vocabulary}
    raw = {w: math.log(n - df[w] + 0.5) - math.log(df[w] + 0.5) for w in vocabulary}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    return [sum(idf.get(w, 0) * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in question.lower().split()) for d in docs]


@pytest.mark.parametrize("question", ["red fox", "Fox fox", "sky unknown", "unknown"])
def test_bm25(spark, chunks, question):
    q = spark.createDataFrame([(1, question)], "query_id long, question string")
    texts = [r["text"] for r in chunks.orderBy("corpus_pos").collect()]
    want = [round(s, 6) for s in plain_bm25(texts, question)]
    order = sorted(range(len(texts)), key=lambda i: (-want[i], i))
    got = bm25.top_k(chunks, q, depth=6).orderBy("rank0").collect()
    assert [r["chunk_id"] for r in got] == [f"c{i}" for i in order[:6]]
    assert [r["score"] for r in got] == pytest.approx([want[i] for i in order[:6]], abs=2e-6)
    kept = bm25.top_k(chunks, q, depth=6, drop_zero=True).count()
    assert kept == min(6, sum(s != 0 for s in want))


@pytest.mark.parametrize("n_rare", [1, 4])
def test_bm25_weights_below_zero(spark, n_rare):
    """A corpus whose words nearly all stand in over half of its chunks: the zero fill outranks what matches."""
    texts = ["the end of the day"] * 9 + ["the day", "of"] + [f"rare{i}" for i in range(n_rare)] + ["", "the", "of the", None]
    df = spark.createDataFrame([(f"c{i:02}", i, "A" if i % 3 else "B", "en", t) for i, t in enumerate(texts)], "chunk_id string, corpus_pos long, book_title string, chapter string, text string")
    questions = ["the day", "the", "rare0 the", "of end", "day rare0 end of", "none"]
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    booked = q.selectExpr("query_id + 100 as query_id", "question", "'B' as book_filter")
    got = bm25.top_k(df, q.withColumn("book_filter", F.lit(None).cast("string")).unionByName(booked), depth=5).collect()
    some = False
    for i, question in enumerate(questions):
        scores = [round(s, 6) for s in plain_bm25(texts, question)]
        some |= min(scores) < 0
        for base, mine in ((0, range(len(texts))), (100, range(0, len(texts), 3))):
            want = sorted(mine, key=lambda k: (-scores[k], k))[:5]
            found = sorted((r["rank0"], r["chunk_id"], r["score"]) for r in got if r["query_id"] == base + i)
            assert [c for _, c, _ in found] == [f"c{k:02}" for k in want], question
            assert [s for *_, s in found] == pytest.approx([scores[k] for k in want], abs=2e-6)
    assert some or n_rare > 1


def test_filters_act_after_scoring(spark, chunks):
    q = spark.createDataFrame([(1, "fox", "B2", None), (2, "fox", "", "fr"), (3, "fox", "none", None)], "query_id long, question string, book_filter string, chapter_filter string")
    got = bm25.top_k(chunks, q, depth=3)
    by = {i: [r["chunk_id"] for r in got.where(F.col("query_id") == i).orderBy("rank0").collect()] for i in (1, 2, 3)}
    assert by[1][:2] == ["c0", "c6"] or by[1][:2] == ["c6", "c0"]
    assert by[2] == ["c6", "c4", "c5"] and by[3] == []
    everything = bm25.top_k(chunks, q.limit(1).withColumn("book_filter", F.lit(None).cast("string")), depth=9)
    score = {r["chunk_id"]: r["score"] for r in everything.collect()}
    assert all(score[r["chunk_id"]] == r["score"] for r in got.where("query_id = 1").collect())


def test_dense_in_blocks(spark, chunks):
    q = spark.createDataFrame([(i, [math.cos(i), math.sin(i)], "B1" if i == 2 else None) for i in range(4)] + [(9, None, None), (10, [1.0], None)], "query_id long, embedding array<float>, book_filter string")
    whole = {(r["query_id"], r["rank0"]): r["chunk_id"] for r in dense.top_k(chunks, q, depth=3).collect()}
    small = {(r["query_id"], r["rank0"]): r["chunk_id"] for r in dense.top_k(chunks, q, depth=3, block_numbers=2).collect()}
    assert whole == small and len(whole) == 12
    assert [whole[i, 0] for i in (0, 1, 3)] == ["c0", "c1", "c3"]
    assert all(int(whole[2, k][1:]) % 2 for k in range(3))
    assert dense.top_k(chunks, q.limit(0)).count() == 0


def test_fusion_and_orphans(spark):
    ranking = lambda ids: spark.createDataFrame([(1, c, i) for i, c in enumerate(ids)], "query_id long, chunk_id string, rank0 int")
    got = [(r["chunk_id"], r["rrf_score"]) for r in fusion.fuse(ranking("ab"), ranking("bc")).orderBy("pos").collect()]
    assert got == [("b", 0.03306), ("a", 0.01667), ("c", 0.01639)]
    tied = [r["chunk_id"] for r in fusion.fuse(ranking("ab"), ranking("cd"), top_k=3).orderBy("pos").collect()]
    assert tied == ["a", "c", "b"]  # equal sums: the dense list first
    library = spark.createDataFrame([("b",), ("c",)], "chunk_id string")
    fused = fusion.fuse(ranking("ab"), ranking("bc"))
    assert [(r["pos"], r["found_pos"]) for r in fusion.hydrate(fused, library).orderBy("pos").collect()] == [(1, 1), (3, 2)]
    assert fusion.orphans(fused, library).first()["n_skipped"] == 1


def test_book_routing(spark):
    profiles = spark.createDataFrame([("A", w, 1.0, 1) for w in ("index", "query", "join")] + [("B", w, 1.0, 1) for w in ("neuron", "query", "layer")], "book_title string, word string, score double, rank int")
    questions = ["index join query", "query", "neuron layer query index", "the of", "nothing here", "index index"]
    q = spark.createDataFrame(list(enumerate(questions)), "query_id long, question string")
    got = {r["query_id"]: r["book_filter"] for r in routing.route_books(q, profiles).collect()}
    # 3 to 1; a tie; 3 to 2 is exactly the margin; no usable words; no hits; one book alone
    assert got == {0: "A", 1: None, 2: "B", 3: None, 4: None, 5: "A"}


def test_chapter_routing_margins(spark):
    v = spark.createDataFrame([("b", "one", 1, [1.0, 0.0]), ("b", "two", 2, [0.0, 1.0]), ("lone", "x", 1, [1.0, 0.0])], "book_title string, chapter string, chapter_pos int, embedding array<double>")
    rows = [(0, "b", [0.9, 0.1]), (1, "b", [0.6, 0.55]), (2, "b", [0.2, 0.1]), (3, "lone", [0.25, 0.0]), (4, None, [1.0, 0.0]), (5, "b", [0.25, -0.3])]
    q = spark.createDataFrame(rows, "query_id long, book_filter string, embedding array<double>")
    got = {r["query_id"]: r["chapter_filter"] for r in routing.route_chapters(q, v).collect()}
    assert got == {0: "one", 1: None, 2: None, 3: "x", 4: None, 5: "one"}


def test_metrics(spark):
    results = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 3, 2), (2, "x", 4, 4)], "query_id long, chunk_id string, pos int, found_pos int")
    truth = spark.createDataFrame([(1, "b"), (2, "x"), (3, "y")], "query_id long, chunk_id string")
    m = evaluate.metrics(truth, results).first()
    assert (m["hit_rate_1"], m["hit_rate_3"], m["hit_rate_5"]) == pytest.approx((0, 1 / 3, 2 / 3))
    assert m["mrr"] == pytest.approx((1 / 2 + 1 / 4) / 3)
    assert evaluate.metrics(truth.limit(0), results).first()["mrr"] is None
    assert "| hit_rate_3 | 33.33% |" in evaluate.report(m.asDict(), when="today")


def test_judge_and_retry(spark):
    items = spark.createDataFrame([("c", "a {x}", "q"), ("c", "bad", "q")], "context string, answer string, question string")

    def model(prompt):
        if "bad" in prompt:
            raise ValueError("no")
        return "Score: 0.75"

    got = [(r["score"], r["judged_error"]) for r in evaluate.judge(items, model, kind="faithfulness").collect()]
    assert got == [(0.75, None), (None, "ValueError: no")]
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert query.with_retry(flaky, retriable=lambda e: True, sleep=waits.append)("p") == "ok" and waits == [5, 10]
    with pytest.raises(ConnectionError):
        query.with_retry(lambda p: (_ for _ in ()).throw(ConnectionError()), retriable=lambda e: False)("p")


def test_image_model(spark):
    rows = spark.createDataFrame([("what", bytearray(b"ab"), None), ("what", None, "image/gif"), ("fail", bytearray(b""), "image/gif")], "prompt string, image binary, mime_type string")

    def model(prompt, image, mime):
        if prompt == "fail":
            raise OSError("no")
        return f"{prompt} {len(image)} {mime}"

    got = {(r["prompt"], r["answer"], r["answer_error"]) for r in query.call_image_model(rows, model).collect()}
    assert got == {("what", "what 2 image/png", None), ("what", None, None), ("fail", None, "OSError: no")}
    assert query.call_image_model(rows.drop("mime_type").limit(1), model).first()["answer"] == "what 2 image/png"


def test_sample_and_prompts(spark):
    rows = spark.createDataFrame([("b", f"c{i}", i, i) for i in range(25)] + [("s", "only", 1, 0)], "book_title string, chunk_id string, page_number int, corpus_pos long")
    got = evaluate.sample_spread(rows, n=10)
    assert [r["page_number"] for r in got.where("book_title = 'b'").orderBy("nth").collect()] == list(range(0, 20, 2))
    assert got.where("book_title = 's'").count() == 1 and evaluate.sample_spread(rows, n=0).count() == 0
    found = spark.createDataFrame([(1, 2, "C", None, 7, "two"), (1, 1, "C", "S", 3, "one")], "query_id long, pos int, chapter string, section string, page_number int, text string")
    assert query.contexts(found).first()["context"] == "[C | S | p.3]\none\n\n---\n\n[C | None | p.7]\ntwo"
    q = spark.createDataFrame([(1, "why?")], "query_id long, question string")
    assert query.prompts(q, found).first()["prompt"].endswith("QUESTION: why?\n\nANSWER:")
