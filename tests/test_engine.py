"""The engine from lines to answers, and its command line."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark import engine
from foliospark.operators import concepts
from foliospark.sources import readers

LINES = "book_title string, line_no long, page_number int, text string, size double"


def lines(spark):
    rows = []
    for book, topic in (("Databases", "index query join table"), ("Networks", "neuron layer gradient weight")):
        rows.append((book, 0, 1, "Preface", 20.0))
        rows += [(book, 1, 1, "thanks to all", 10.0), (book, 2, 2, f"{topic.split()[0].title()} Chapter", 20.0)]
        rows += [(book, 3 + i, 2 + i, f"The {topic} part {i} of {topic}.", 10.0) for i in range(6)]
    return spark.createDataFrame(rows, LINES)


def test_round(spark, tmp_path, capsys):
    e = engine.Engine(spark, f"file://{tmp_path}/e")
    toc = spark.createDataFrame([("Databases", 0, 1, "Index Chapter", 2)], "book_title string, pos int, level int, title string, start_page int")
    e.ingest(lines(spark), toc=toc)
    books = {r["book_title"]: r["n"] for r in e.library.read().groupBy("book_title").agg({"chunk_id": "count"}).toDF("book_title", "n").collect()}
    assert books == {"Databases": 1, "Networks": 2}  # the preface page is trimmed where there is a TOC
    q = spark.createDataFrame([(0, "how does a query use an index and a join")], "query_id long, question string")
    got = e.ask(q).orderBy("pos").collect()
    assert got and {r["book_title"] for r in got} == {"Databases"} and got[0]["book_filter"] == "Databases"
    assert {r["book_title"] for r in e.ask(q, force_all_books=True).collect()} == {"Databases", "Networks"}
    assert {r["book_title"] for r in e.ask(q, book="Networks").collect()} == {"Networks"}
    assert e.answer(q, lambda p: "yes" if "EXCERPTS" in p else "no").first()["answer"] == "yes"
    chapters = spark.createDataFrame([("Networks", 0, "All", 2, 9)], "book_title string, pos int, title string, start_page int, end_page int")
    counts = {r["book_title"]: (r["relabelled"], r["removed"]) for r in e.fix_chapters(chapters).collect()}
    assert counts == {"Databases": (0, 0), "Networks": (1, 1)}
    assert {(r["book_title"], r["chapter"]) for r in e.library.read().collect()} == {("Databases", "Index Chapter"), ("Networks", "All")}
    reply = '{"terms": [{"term": "Index", "definition": "d"}], "relations": []}'
    calls = [r["extraction"]["terms"][0]["term"] for r in e.extract_concepts("Databases", lambda p: reply).collect()]
    assert calls == ["Index"]

    def never(p):
        raise AssertionError

    assert e.extract_concepts("Databases", never).count() == 1  # from the cache
    nodes, edges = e.concept_graph()
    assert [r["label"] for r in nodes.collect()] == ["Index"] and "Index" in e.concept_map(nodes, edges, "Map")
    engine.main([e.root, "list-books"])
    engine.main([e.root, "ask", "query index join", "--book", "Databases"])
    assert "Databases" in capsys.readouterr().out
    e.reset()
    assert not any((tmp_path / "e").iterdir())


def test_asking_prepares_once_for_a_version(spark, tmp_path):
    encoded = []

    def encode(c):
        encoded.append(str(c))
        return engine.hashed_embedding(c)

    e = engine.Engine(spark, f"file://{tmp_path}/e", encode=encode)
    e.ingest(lines(spark))
    q = spark.createDataFrame([(0, "query index join table")], "query_id long, question string")
    assert e.ask(q).count()
    held = e._held
    vectors = lambda: e.spark.read.parquet(f"{e.root}/chapter_vectors")
    n, files = vectors().count(), len(list((tmp_path / "e" / "profiles").iterdir()))
    assert e.ask(q).count() and e._held is held and vectors().count() == n == 4
    e.ingest(lines(spark).where("book_title = 'Networks' and page_number > 1"))  # other chapters: a new version
    assert e.ask(q).count() and e._held[0] == held[0] + 1 and len(list((tmp_path / "e" / "profiles").iterdir())) == files + 1
    assert {r["book_title"]: r["count"] for r in vectors().groupBy("book_title").count().collect()} == {"Databases": 2, "Networks": 3}
    again = engine.Engine(spark, e.root, encode=encode, encoder="another")
    assert again.ask(q).count() and vectors().count() == 5 + 3
    e.forget()
    assert e._held is None


def test_upload(spark, tmp_path):
    e = engine.Engine(spark, f"file://{tmp_path}/e")
    pages = {1: ["Preface|20", "thanks|10"], 2: ["Index Chapter|20", "the index of a query|10"], 3: ["more of it|10"], 4: ["Bibliography|20", "names|10"]}
    parser = lambda content: [(int(n), [(x.split("|")[0], float(x.split("|")[1])) for x in t]) for n, t in json.loads(content).items()]
    content = json.dumps(pages).encode()
    assert e.ingest_upload(content, "Up — load", parser) == (3, 0)
    real = lambda content: [(1, "Preface", 1), (1, "Queries", 2), (1, "Bibliography", 4)]
    assert e.ingest_upload(content, "Up — load", parser, contents=real) == (1, 2)
    assert [(r["book_title"], r["chapter"]) for r in e.library.read().collect()] == [("Up — load", "Queries")]
    assert not list((tmp_path / "e" / "uploads").iterdir())
    with pytest.raises(Exception):  # noqa: B017  whatever a parser raises
        e.ingest_upload(b"no JSON", "Other", parser)
    assert not list((tmp_path / "e" / "uploads").iterdir()) and e.library.read().count() == 1


def test_extraction_stops_and_resumes_by_book(spark, tmp_path):
    """Each answer is stored when it comes; a failure ends its book only."""
    e = engine.Engine(spark, f"file://{tmp_path}/e")
    rows = [r for b in ("A", "B") for i in range(40) for r in ((b, 2 * i, i + 1, f"Head {i}", 20.0), (b, 2 * i + 1, i + 1, f"text {b}{i} " * 3, 10.0), (b, 1000 + i, i + 1, "more body", 10.0))]
    e.ingest(spark.createDataFrame(rows, LINES))
    prompts = e._prompts(e.library.read())
    assert {r["book_title"]: r["count"] for r in prompts.groupBy("book_title").count().collect()} == {"A": 3, "B": 3}

    def model(p):
        if "A20 " in p:
            raise TimeoutError("late")
        return '{"terms": [{"term": "T", "definition": "d"}, {"term": "U"}], "relations": [{"source": "t", "relation": "is", "target": "U"}]}'

    asked = concepts.extract(prompts, e.cache, model).collect()
    assert sorted((r["book_title"], r["batch_id"], r["error"]) for r in asked if r["error"]) == [("A", 1, "TimeoutError: late")]
    assert len(asked) == 5 and len(list((tmp_path / "e" / "extractions").glob("*.json"))) == 4
    nodes, edges = e.concept_graph(["B", "A"])
    assert {r["label"]: r["books"] for r in nodes.collect()} == {"T": ["A", "B"], "U": ["A", "B"]} and [(r["src"], r["dst"], r["book"]) for r in edges.collect()] == [("t", "u", "A")]
    assert e.extract_concepts("A", model).count() == 1
    bad = concepts.extract(prompts, e.cache, lambda p: "not JSON").collect()
    assert [(r["batch_id"], r["error"]) for r in bad] == [(1, "no JSON object")]
    assert e.extract_concepts("A", lambda p: '```json\n{"terms": []}\n```').count() == 3
    assert concepts.extract(prompts, e.cache, model).count() == 0


def test_evaluation(spark, tmp_path):
    e = engine.Engine(spark, f"file://{tmp_path}/e")
    e.ingest(lines(spark))
    ids = {r["book_title"]: r["chunk_id"] for r in e.library.read().where("chapter like '%Chapter'").collect()}
    items = spark.createDataFrame([("q1", "index query join", "an index", ids["Databases"]), ("q2", "neuron layer", "a layer", "gone")], "id string, question string, ground_truth_answer string, ground_truth_chunk_id string")
    text = e.evaluate(items, path=f"file://{tmp_path}/report.md")
    assert "| hit_rate_1 | 50.00% |" in text and "Skipped: no text model was given" in text and (tmp_path / "report.md").read_text() == text
    assert "Questions: 2" in text
    judged = e.evaluate(items, lambda p: "0.5" if "from 0 to 1" in p else "an answer")
    assert "| faithfulness | 0.50 |" in judged and "| recall | 0.50 |" in judged

    def failing(p):
        raise KeyError("key")

    assert "Skipped: KeyError" in e.evaluate(items, failing)
    assert "Questions: 5" in e.evaluate()


def test_commands(spark, tmp_path, capsys):
    lines(spark).write.parquet(f"{tmp_path}/lines")
    root = f"file://{tmp_path}/e"
    engine.main([root, "list-chapters", f"{tmp_path}/lines"])
    assert "Neuron Chapter (pages 2-7)" in capsys.readouterr().out
    engine.main([root, "ingest-chapter", f"{tmp_path}/lines", "Networks", "1"])
    engine.main([root, "list-books"])
    assert "Networks — Neuron Chapter" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        engine.main([root, "ingest-chapter", f"{tmp_path}/lines", "Networks", "9"])
    engine.main([root, "evaluate", "--report", f"{tmp_path}/r.md"])
    assert "Evaluation report" in capsys.readouterr().out and (tmp_path / "r.md").exists()


def test_chapters(spark, tmp_path):
    e = engine.Engine(spark, f"file://{tmp_path}/e")
    toc = spark.createDataFrame([("Databases", 0, 1, "Index Chapter", 2)], "book_title string, pos int, level int, title string, start_page int")
    listed = e.list_chapters(toc, lines(spark))
    assert sorted((r["book_title"], r["title"]) for r in listed.collect()) == [("Databases", "Index Chapter"), ("Networks", "Neuron Chapter"), ("Networks", "Preface")]
    e.ingest_chapters(lines(spark), listed.where("title = 'Index Chapter'"))
    assert {r["book_title"] for r in e.library.read().collect()} == {"Databases — Index Chapter"}
    assert e.sample_chunks(3).count() >= 1


def reply(prompt):
    """A text model for the command line."""
    return '{"terms": [{"term": "Index", "definition": "d"}], "relations": []}'


def test_more_commands(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/e"
    e = engine.Engine(spark, root)
    long = lines(spark).withColumn("text", F.when(F.col("size") == 10, F.repeat(F.concat("text", F.lit(" ")), 6)).otherwise(F.col("text")))
    e.ingest(long)
    engine.main([root, "search", "NEURON layer", "--limit", "2"])
    assert "Networks" in capsys.readouterr().out
    engine.main([root, "debug-query", "query index join"])
    assert "polluted" in capsys.readouterr().out
    engine.main([root, "generate-eval-set", f"file://{tmp_path}/real.json", "-n", "2"])
    items = readers.eval_set(spark, f"file://{tmp_path}/real.json")
    assert items.count() == 2 and items.join(e.library.read(), F.col("ground_truth_chunk_id") == F.col("chunk_id")).count() >= 2
    engine.main([root, "create-eval-set", f"file://{tmp_path}/todo.json", "-n", "1"])
    assert len(json.loads((tmp_path / "todo.json").read_text())) == 1
    engine.main([root, "extract-concepts", "Databases", "--model", "tests.test_engine:reply"])
    engine.main([root, "concept-map", f"file://{tmp_path}/map.html"])
    assert "Index" in (tmp_path / "map.html").read_text()


def test_a_busy_model_is_asked_again(spark, tmp_path):
    e = engine.Engine(spark, f"file://{tmp_path}/e", waits=(0.0, 0.0, 0.0))
    e.ingest(lines(spark))
    q = spark.createDataFrame([(0, "query index")], "query_id long, question string").coalesce(1)
    mark = tmp_path / "asked"

    def busy(prompt):
        with open(mark, "a") as f:
            f.write("x")
        if len(mark.read_text()) < 2:
            raise RuntimeError("503 service unavailable")
        return "yes"

    assert e.answer(q, busy).first()["answer"] == "yes" and mark.read_text() == "xx"
    mark.unlink()
    never = engine.Engine(spark, e.root, retriable=None).answer(q, busy).first()
    assert never["answer"] is None and "503" in never["answer_error"]
