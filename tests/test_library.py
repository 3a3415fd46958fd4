"""The stored library, concepts, sources, streaming and pages."""

import json
import os
import random
import subprocess
import sys
import time
import uuid

import pytest
from pyspark.sql import functions as F

from foliospark.operators import concepts, render, store
from foliospark.sources import documents, readers
from foliospark.streaming import ingest, sentences
from foliospark.streaming import sql as sentences_sql

CHUNKS = "chunk_id string, text string, book_title string, corpus_pos long"


def ids(lib, **options):
    return sorted(r["chunk_id"] for r in lib.read(**options).collect())


def test_upsert_is_idempotent_and_changes_touch_one_book(spark, tmp_path):
    lib = store.Library(spark, f"file://{tmp_path}/lib")
    two = spark.createDataFrame([("a0", "x", "A B", 0), ("a1", "y", "A B", 1), ("b0", "z", "B", 0)], CHUNKS)
    lib.rebuild(two)
    files = lambda: sorted((tmp_path / "lib" / "data").rglob("*.parquet"))
    before = files()
    new = spark.createDataFrame([("a9", "new", "A B", 0)], CHUNKS)
    lib.upsert(new)
    lib.upsert(new)
    assert ids(lib) == ["a9", "b0"] and ids(lib, version=1) == ["a0", "a1", "b0"] and lib.version() == 3
    assert set(before) <= set(files())
    assert ids(lib, book="A B") == ["a9"] and lib.read().columns == two.columns
    lib.delete_ids(spark.createDataFrame([("a9",)], "chunk_id string"))
    assert ids(lib) == ["b0"]
    lib.upsert(new.limit(0))
    assert ids(lib) == ["b0"]
    lib.vacuum()
    assert ids(lib) == ["b0"] and len(files()) == 1 and len(list((tmp_path / "lib" / "versions").iterdir())) == 1
    lib.reset()
    assert not (tmp_path / "lib").exists() and lib.version() == 0


TITLES = ["007", "1e5", "Book — One", "A (2nd, ed.)", "a=b/c%20d", "[x] {y}", "été: \"q\" 'r' #?*", "", None, "NULL", "A", "a"]


def test_titles_of_any_characters_are_kept_and_deleted(spark, tmp_path):
    lib = store.Library(spark, f"file://{tmp_path}/lib")
    lib.rebuild(spark.createDataFrame([(f"c{i}", "x", t, i) for i, t in enumerate(TITLES)], CHUNKS))
    read = lambda: {r["chunk_id"]: r["book_title"] for r in lib.read().collect()}
    assert read() == {f"c{i}": t for i, t in enumerate(TITLES)}
    lib.delete_ids(spark.createDataFrame([("c2",), ("c8",)], "chunk_id string"))
    for t in ("007", "A (2nd, ed.)", "a=b/c%20d"):
        assert [r["book_title"] for r in lib.read(t).collect()] == [t]
        lib.delete_book(t)
    assert read() == {f"c{i}": t for i, t in enumerate(TITLES) if i not in (0, 2, 3, 4, 8)}


def test_a_change_that_breaks_off_leaves_the_version_before(spark, tmp_path):
    lib = store.Library(spark, f"file://{tmp_path}/lib")
    rows = spark.createDataFrame([("a0", "x", "A", 0), ("b0", "y", "B", 0)], CHUNKS)
    lib.rebuild(rows)
    with pytest.raises(Exception):  # noqa: B017  whatever a task raises
        lib.upsert(rows.withColumn("text", F.when(F.col("book_title") == "B", F.raise_error(F.lit("lost"))).otherwise(F.col("text"))))
    assert ids(lib) == ["a0", "b0"]
    stale = store.Library(spark, lib.path)
    stale.version = lambda: 0  # another writer that has not seen the first version
    with pytest.raises(RuntimeError):
        stale._commit(lib._listed())
    assert ids(lib) == ["a0", "b0"] and not list((tmp_path / "lib").glob("pending*"))
    lib.rebuild(lib.read().where("book_title = 'B'"))  # reads what it replaces
    assert ids(lib) == ["b0"]


def test_upserted_puts_new_rows_last(spark):
    old = spark.createDataFrame([("a", "x", "A", 0), ("b", "y", "B", 1)], CHUNKS)
    got = store.upserted(old, spark.createDataFrame([("c", "z", "A", 0)], CHUNKS))
    assert sorted((r["chunk_id"], r["corpus_pos"]) for r in got.collect()) == [("b", 1), ("c", 2)]


@pytest.fixture(scope="module")
def graph(spark):
    terms = [
        ("A", 0, 0, "Backpropagation", "d1"), ("A", 0, 1, "Gradient Descent", "d2"), ("A", 0, 2, "Vanishing Gradients", "d3"), ("A", 0, 3, "Perceptron", "d4"),
        ("B", 1, 0, "Foreign Key", "d5"), ("B", 1, 1, "Primary Key", "d6"), ("B", 1, 2, " gradient descent ", "other"), ("B", 1, 3, "Normalization", "d7"),
    ]
    relations = [
        ("A", 0, 0, "Backpropagation", "uses", "Gradient Descent"), ("A", 0, 1, "Backpropagation", "causes", "Vanishing Gradients"),
        ("B", 1, 0, "Foreign Key", "names", "Primary Key"), ("B", 1, 1, "foreign key", "points to", "primary key"), ("B", 1, 2, "Foreign Key", "x", "Nothing"),
    ]
    t = spark.createDataFrame(terms, "book_title string, book_pos int, term_pos int, term string, definition string")
    r = spark.createDataFrame(relations, "book_title string, book_pos int, rel_pos int, source string, relation string, target string")
    nodes = concepts.nodes(t)
    return nodes, concepts.edges(r, nodes)


def test_graph(spark, graph):
    nodes, edges = graph
    s = concepts.summary(nodes, edges).first()
    assert (s["n_nodes"], s["n_edges"], s["n_shared"]) == (7, 3, 1)
    shared = nodes.where("cross_referenced_in is not null").first()
    assert (shared["label"], shared["definition"], shared["books"]) == ("Gradient Descent", "d2", ["A", "B"])
    assert edges.where("src = 'foreign key'").first()["relation"] == "points to"
    d = {r["term_id"]: (r["degree"], r["is_hub"]) for r in concepts.degrees(nodes, edges).collect()}
    assert d["backpropagation"] == (2, True) and d["perceptron"] == (0, False) and sum(hub for _, hub in d.values()) == 1
    r = {x["term_id"]: (x["n_related"], [tuple(y) for y in x["related"]]) for x in concepts.related(nodes, edges).collect()}
    assert r["backpropagation"] == (2, [("Gradient Descent", "uses"), ("Vanishing Gradients", "causes")])
    assert r["normalization"] == (0, [])
    hops = concepts.two_hops(edges, spark.createDataFrame([("gradient descent",)], "term_id string"))
    assert {x["term_id"]: x["level"] for x in hops.collect()} == {"gradient descent": 0, "backpropagation": 1, "vanishing gradients": 2}


def test_loop_and_cap(spark):
    terms = spark.createDataFrame([("A", 0, i, f"t{i}", "") for i in range(12)], "book_title string, book_pos int, term_pos int, term string, definition string")
    nodes = concepts.nodes(terms)
    r = [("A", 0, 0, "t0", "self", "t0")] + [("A", 0, i, "t0", "r", f"t{i}") for i in range(1, 12)]
    edges = concepts.edges(spark.createDataFrame(r, "book_title string, book_pos int, rel_pos int, source string, relation string, target string"), nodes)
    assert concepts.degrees(nodes, edges).where("term_id = 't0'").first()["degree"] == 13
    got = concepts.related(nodes, edges).where("term_id = 't0'").first()
    assert got["n_related"] == 13 and len(got["related"]) == 8


def test_page_escapes_what_it_inlines(graph):
    nodes, edges = graph
    evil = nodes.withColumn("definition", F.lit("</script><b>"))
    page = concepts_page = render.concept_map(evil, edges, title="<Map>")
    assert "</script><b>" not in page and "&lt;Map&gt;" in page
    body = page.split('type="application/json">')[1].split("</script>")[0]
    assert json.loads(body)[0]["definition"] == "</script><b>" and concepts_page
    books = render.legend(nodes.withColumn("books", F.array(F.lit("<A>"))))
    assert "&lt;A&gt;</li>" in books and "<A>" not in books and "shared by several books" in page and '<dialog id="term">' in page


def test_page_of_a_large_graph_is_an_error(graph, monkeypatch):
    monkeypatch.setattr(render, "MOST_NODES", 6)
    with pytest.raises(ValueError):
        render.concept_map(*graph)


def test_extractions_become_rows(spark):
    kind = "book_title string, batch_id int, answer string"
    answers = [
        ("B", 0, '{"terms": [{"term": "x", "definition": "1"}, {"term": null}, {"term": "x"}], "relations": [{"source": "x", "relation": "r", "target": "y"}, {"source": "x"}]}'),
        ("A", 1, '```json\n{"terms": [{"term": " X ", "definition": "2"}]}\n```'), ("A", 0, "bad"), (None, 0, '{"terms": [{"term": "y", "definition": "3"}], "relations": null}'),
    ]
    found = concepts.parse(spark.createDataFrame(answers, kind))
    assert sorted(tuple(r) for r in concepts.terms(found).select("book_pos", "term_pos", "term").collect()) == [(0, 0, "y"), (1, 1 << 32, " X "), (2, 0, "x"), (2, 2, "x")]
    assert [(r["book_title"], r["source"], r["target"], r["rel_pos"]) for r in concepts.relations(found).collect()] == [("B", "x", "y", 0)]
    nodes, edges = concepts.graph(found)
    assert {r["term_id"]: (r["label"], r["definition"]) for r in nodes.collect()} == {"x": (" X ", "2"), "y": ("y", "3")} and edges.count() == 1
    turned = concepts.graph(found.withColumn("book_pos", F.when(F.col("book_title") == "B", 0).otherwise(1)))[0]
    assert turned.where("term_id = 'x'").first()["label"] == "x"
    assert concepts.terms(found.limit(0)).count() == 0


def test_sources(spark, tmp_path):
    page = spark.createDataFrame([("u", 1, "<h1>Top <i>x</i></h1>\n<p>one</p><p></p><h2 class='a'>Sub</h2>")], "url string, page_id long, html string")
    assert [(r["text"], r["size"]) for r in readers.html_lines(page).orderBy("line_no").collect()] == [("Top x", 18.0), ("one", 10.0), ("Sub", 15.0)]
    assert [(r["title"], r["level"]) for r in readers.html_toc(page).orderBy("pos").collect()] == [("Top x", 1), ("Sub", 2)]
    (tmp_path / "My Book.bin").write_bytes(b"Head|18\n body |10.04\n\n")

    def parser(content):
        return [(1, [(x.split("|")[0], float(x.split("|")[1])) for x in content.decode().split("\n") if "|" in x])]

    got = [tuple(r) for r in readers.document_lines(spark, f"file://{tmp_path}/*.bin", parser).collect()]
    assert [(g[2], g[3], g[4]) for g in got] == [(1, "Head", 18.0), (1, "body", 10.0)]
    wire = [{"chunk_id": "c", "text": "t", "metadata": {"book_title": "b", "chapter": None, "section": "s", "page_number": 1, "chunk_index_on_page": 0}}]
    (tmp_path / "lib.json").write_text(json.dumps(wire))
    assert readers.library_json(spark, f"file://{tmp_path}/lib.json").first()["section"] == "s"
    assert readers.eval_set(spark, None).count() == 5
    v = spark.createDataFrame([("a b",)], "text string").select(readers.hashed_embedding(F.col("text")).alias("v")).first()["v"]
    assert len(v) == 64 and sum(x * x for x in v) == pytest.approx(1, abs=1e-5)
    e = readers.encoded(spark.createDataFrame([("aa",), (None,)], "text string"), lambda ts: [[len(t), 1.0] for t in ts])
    assert [len(r["embedding"]) for r in e.collect()] == [2, 2]


PIECES = ["The chain rule is use", "d here (see p.", "3 for details). Many net", "works, e.g.", " those with 50+ layers. And sig", "moid activ", "ations."]


def test_segmentation():
    assert sentences.segment(PIECES) == ["The chain rule is used here (see p.3 for details).", "Many networks, e.g. those with 50+ layers.", "And sigmoid activations."]
    assert sentences.segment(["Hi.", " there"]) == ["Hi.", "there"] and sentences.segment([" ", ""]) == []
    assert sentences.segment(["It is 3. and 4. so all stays. Yes."]) == ["It is 3. and 4. so all stays. Yes."]


def test_stream_agrees_with_batch_whatever_the_order(spark, tmp_path):
    schema = "stream_id long, seq int, piece string, is_last boolean"
    rows = [(s, i, p, i == len(PIECES) - 1) for s in (1, 2) for i, p in enumerate(PIECES)]
    late = sorted(rows, key=lambda r: (r[1] * 3) % 7)
    for n, part in enumerate([late[:5], late[5:9], late[9:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"file://{tmp_path}/in/{n}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in/*")
    q = sentences.stream_sentences(stream).writeStream.format("memory").queryName("out").outputMode("append")
    q = q.option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table("out").orderBy("stream_id", "sentence_no").collect()
    assert [r["sentence"] for r in got if r["stream_id"] == 1] == sentences.segment(PIECES)
    assert [r["sentence_no"] for r in got if r["stream_id"] == 2] == [0, 1, 2]


def run_stream(spark, tmp_path, name, parts, *, idle_ms=3_600_000, wait=0.0):
    """Feed parts of ``(stream_id, seq, piece, is_last)`` one after another, the query starting anew from its checkpoint for each."""
    schema = "stream_id long, seq int, piece string, is_last boolean"
    out = []
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # timers would keep the query running
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(f"file://{tmp_path}/{name}")
        stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/{name}")
        q = sentences.stream_sentences(stream, idle_ms=idle_ms).writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect()))
        q.option("checkpointLocation", f"file://{tmp_path}/{name}-check").trigger(availableNow=True).start().awaitTermination(240)
        time.sleep(wait)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return out


def test_stream_early_late_and_repeated_pieces(spark, tmp_path):
    """Early pieces wait in a map, across restarts; repeated pieces and those after the last are passed over."""
    early = [(1, i, f"piece {i} more. ", False) for i in range(60, 0, -1)]
    got = run_stream(spark, tmp_path, "early", [early, [(1, 0, "Begin. ", False), (1, 61, "end", True)], [(1, 3, "again. ", False), (1, 99, "after. ", False), (2, 0, "Other", True)]])
    assert [(n, t) for s, n, t in got if s == 1] == list(enumerate(["Begin.", *(f"piece {i} more." for i in range(1, 61)), "end"]))
    assert [(n, t) for s, n, t in got if s == 2] == [(0, "Other")]


def test_stream_that_is_left_off_ends(spark, tmp_path):
    """After its time-out a stream gives what it holds up to the gap and is forgotten; a later piece begins anew."""
    got = run_stream(spark, tmp_path, "idle", [[(7, 0, "One. Two", False), (7, 2, "lost. ", False)], [(8, 0, "x", True)], [(7, 0, "New. ", True)]], idle_ms=1, wait=0.2)
    assert [t for s, _, t in got if s == 7] == ["One.", "Two", "New."]
    assert [n for s, n, _ in got if s == 7] == [0, 1, 0]
    forever = run_stream(spark, tmp_path, "kept", [[(7, 0, "One. Two", False)], [(7, 1, " end.", True)], [(7, 0, "Anew", True)]], idle_ms=None)
    assert [(n, t) for _, n, t in forever] == [(0, "One."), (1, "Two end."), (0, "Anew")]


def parse_pages(folder):
    """A parser of files with a page a line, words as lines; it notes which pages it parsed."""

    def parser(content, first, last):
        pages = content.decode().split("\n")
        out = [(i + 1, [(w, 10 + len(w) / 3) for w in p.split(" ")]) for i, p in enumerate(pages) if first <= i + 1 <= last]
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(str(p) for p, _ in out))
        return out

    return parser


def test_documents_by_pages(spark, tmp_path, monkeypatch):
    """A filter on pages parses these pages only; large files are split; a stream gives the lines of a batch."""
    notes = tmp_path / "notes"
    notes.mkdir()
    (tmp_path / "in").mkdir()
    for name, n in (("a", 9), ("b", 3), ("empty", 0), ("_hidden", 4)):
        (tmp_path / "in" / f"{name}.bin").write_text("\n".join(f"{name}{p} x  é{p}" for p in range(1, n + 1)))
    folder = f"file://{tmp_path}/in"
    documents.register(spark, parse_pages(notes), name="paged", count=lambda content: content.count(b"\n") + 1)
    parsed = lambda: sorted(int(x) for f in notes.iterdir() for x in [*f.read_text().split(), *([] if f.unlink() else [])])
    rows = lambda df: sorted((r["book_title"], r["page_number"], r["line_no"] % documents.PAGE_LINES, r["text"], r["size"]) for r in df.collect())
    read = lambda: spark.read.format("paged").load(folder)
    everything = rows(read())
    assert len(everything) == 36 and everything[0] == ("a", 1, 0, "a1", 10.7) and {r[2] for r in everything} == {0, 1, 3}
    parsed()
    some = rows(read().where("page_number between 3 and 4 and text != 'x'"))
    assert some == [r for r in everything if 3 <= r[1] <= 4 and r[3] != "x"] and parsed() == [3, 3, 4]
    assert rows(read().where("page_number in (2, 5)")) == [r for r in everything if r[1] in (2, 5)] and set(parsed()) == {2, 3, 4, 5}
    assert rows(read().where("page_number = 2 or text = 'a9'")) == [r for r in everything if r[1] == 2 or r[3] == "a9"]
    assert rows(read().where("page_number > 100")) == []
    lines = spark.readStream.format("paged").load(folder)
    got = []
    for more in (None, "c"):
        if more:
            (tmp_path / "in" / "c.bin").write_text("c1 late")
        q = lines.writeStream.foreachBatch(lambda df, _: got.extend(rows(df))).option("checkpointLocation", f"file://{tmp_path}/check-paged")
        q.trigger(availableNow=True).start().awaitTermination(240)
    assert sorted(got) == sorted(everything + [("c", 1, 0, "c1", 10.7), ("c", 1, 1, "late", 11.3)])


def test_two_hops_with_hubs(spark):
    """A planted hub's edges are dealt into pieces; the result is that of a walk."""
    edges = [("hub", f"n{i}") for i in range(300)] + [(f"n{i}", f"m{i % 7}") for i in range(0, 300, 3)] + [("a", "n0"), ("a", "a"), ("a", "n0")]
    table = spark.createDataFrame(edges, "src string, dst string")
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    picked = ["hub", "a", "m1", "alone", "a"]
    want = set()
    for s in picked:
        one = near.get(s, set())
        two = set().union(*(near[x] for x in one)) if one else set()
        want |= {(s, t, 0 if t == s else 1 if t in one else 2) for t in {s} | one | two}
    selected = spark.createDataFrame([(s,) for s in picked], "term_id string")
    for hub in (10, 20_000):
        assert {tuple(r) for r in concepts.two_hops(table, selected, hub=hub).select("selected", "term_id", "level").collect()} == want


def test_code_reaches_workers(tmp_path):
    """With the package on the driver's path only, jobs with Python functions run."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {root!r})
from foliospark.streaming.sentences import sentences
print("found", sentences(spark.createDataFrame([("One. Two.",)], "text string")).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env=env, timeout=300)
    assert "found 2" in done.stdout, done.stderr[-2000:]


def test_sentences_in_sql(spark):
    """The table function gives what the segmenter gives, whatever the order of rows and the type of ids."""
    sentences_sql.register(spark)
    rows = [(f"s{s}", i, p, "other") for s in range(5) for i, p in enumerate(PIECES[s:])] + [(None, 0, "No id. ", "x"), ("null", 0, None, "x"), ("null", 1, "Then. ", "x")]
    random.Random(3).shuffle(rows)
    spark.createDataFrame(rows, "stream_id string, seq int, piece string, sentence string").repartition(3).createOrReplaceTempView("pieces_view")
    got = spark.sql("SELECT * FROM sentences_of(TABLE(pieces_view)) WHERE stream_id IS NOT NULL").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["stream_id"], r["sentence_no"])):
        by.setdefault(r["stream_id"], []).append(r["sentence"])
    assert by == {**{f"s{s}": sentences.segment(PIECES[s:]) for s in range(5)}, "null": ["Then."]}
    assert spark.sql("SELECT * FROM sentences_of(TABLE(SELECT 1 AS stream_id, 0 AS seq, 'a' AS piece WHERE false))").count() == 0
    with pytest.raises(Exception, match="piece"):
        spark.sql("SELECT * FROM sentences_of(TABLE(SELECT 1 AS stream_id, 0 AS seq))").collect()


def test_incremental_ingest_is_replayable(spark, tmp_path):
    schema = "book_title string, line_no long, page_number int, text string, size double"
    rows = [("B", 0, 1, "Title", 20.0), *[("B", i, 1, f"line {i}", 10.0) for i in range(1, 5)]]
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"file://{tmp_path}/in")
    lib = store.Library(spark, f"file://{tmp_path}/lib")
    for run in (1, 2):  # another checkpoint: the same file is ingested again
        lines = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
        ingest.start_ingest(lines, lib, f"file://{tmp_path}/check{run}").awaitTermination(120)
    got = lib.read().collect()
    assert [(r["chunk_id"], r["chapter"], r["text"]) for r in got] == [("b_p1_g0_c0", "Title", "line 1 line 2 line 3 line 4")]
