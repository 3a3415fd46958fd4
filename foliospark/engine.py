"""The whole engine behind one object, and its command line.

A :class:`Engine` owns a folder with the library, the chapter lists and the caches.
Encoders and text models are callables that the caller brings.
"""

from __future__ import annotations

import argparse
import importlib
import json
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import ASK_TOP_K
from .operators import chunking, concepts, evaluate, fusion, query, render, routing, structure
from .operators.indexes import IndexedLibrary
from .operators.store import _path, _remove, exists
from .sources import readers
from .sources.readers import hashed_embedding

_VECTORS = "cache_key string, encoder string, book_title string, chapter string, chapter_pos int, embedding array<float>"


class Engine:
    """Ingest, inspect, ask and map a library of books.

    What asking needs beside the chunks (book profiles, chapter vectors) is stored and
    kept in memory for the library's newest version; a change makes a new version. Search
    reads the library's indexes; ``exact`` compares a question with all vectors, otherwise
    with those of the nearest lists. A text model is called again after each of ``waits``
    seconds while it fails in a way that ``retriable`` takes for passing (None: never).
    """

    def __init__(
        self, spark: SparkSession, root: str, *, encode: Callable[[Column], Column] = hashed_embedding, encoder: str | None = None, exact: bool = True,
        retriable: Callable[[Exception], bool] | None = query.may_pass, waits: tuple[float, ...] = (5, 10, 20, 40),
    ):
        self.exact, self.retriable, self.waits = exact, retriable, waits
        self.spark, self.root, self.encode = spark, root.rstrip("/"), encode
        self.encoder = encoder or getattr(encode, "__qualname__", type(encode).__name__)
        self.library = IndexedLibrary(spark, f"{self.root}/library")
        self.cache = f"{self.root}/extractions"
        self._held: tuple[int, DataFrame, DataFrame] | None = None

    # --- books -------------------------------------------------------------------------

    def _chunks(self, lines: DataFrame, toc: DataFrame | None = None) -> DataFrame:
        if toc is not None:
            start = structure.content_start(toc, lines)
            lines = lines.join(start, "book_title").where(F.col("page_number") >= F.col("content_start")).select(*lines.columns)
        built = chunking.build_chunks(structure.heading_groups(structure.heading_levels(lines)))
        return built.withColumn("embedding", self.encode(F.col("text")))

    def ingest(self, lines: DataFrame, *, toc: DataFrame | None = None, skip_front_matter: bool = True) -> None:
        """Replace the books of ``lines`` by chunks of them; lines before the TOC's first top-level page are left out."""
        self.library.upsert(self._chunks(lines, toc if skip_front_matter else None))

    def ingest_chapters(self, lines: DataFrame, chapters: DataFrame) -> None:
        """Ingest each listed chapter as a book of its own."""
        self.ingest(structure.single_chapter(lines, chapters))

    def ingest_upload(
        self, content: bytes, title: str, parser: Callable[[bytes], list], *, contents: Callable[[bytes], list[tuple[int, str, int]]] | None = None
    ) -> tuple[int, int]:
        """Ingest a file that is only at hand as bytes; returns the numbers of chunks kept and removed.

        ``parser`` is that of :func:`readers.document_lines`; ``contents`` gives the file's
        table of contents as ``(level, title, page)``: chunks get its chapters' names, and
        those of front and back matter go. The file lies in the engine's folder while it is read.
        """
        folder = f"{self.root}/uploads/{uuid.uuid4().hex}"
        try:
            path, system = _path(self.spark, f"{folder}/upload.bin")
            out = system.create(path)
            out.write(bytearray(content))
            out.close()
            lines = readers.document_lines(self.spark, folder, parser).withColumn("book_title", F.lit(title))
            self.library.upsert(self._chunks(lines))
            before = self.library.read(title).count()
            entries = contents(content) if contents else []
            if entries:
                toc = self.spark.createDataFrame([(title, i, level, t, page) for i, (level, t, page) in enumerate(entries)], "book_title string, pos int, level int, title string, start_page int")
                ranges = structure.toc_ranges(toc, lines.groupBy("book_title").agg(F.max("page_number").alias("n_pages")))
                self.fix_chapters(structure.content_chapters(ranges))
        finally:
            _remove(self.spark, folder)
        kept = self.library.read(title).count()
        return kept, before - kept

    def list_chapters(self, toc: DataFrame, lines: DataFrame) -> DataFrame:
        pages = lines.groupBy("book_title").agg(F.max("page_number").alias("n_pages"))
        return structure.list_chapters(toc, structure.heading_levels(lines), pages)

    def fix_chapters(self, chapters: DataFrame) -> DataFrame:
        """Relabel chunks of the listed books by the chapters' pages, drop those of no chapter; returns the counts."""
        books = chapters.select("book_title").distinct()
        rows = self.library.read()
        mine = rows.join(books, "book_title", "left_semi").select(*rows.columns)
        self.library.replace(books, structure.reassign_chapters(mine, chapters))
        return structure.reassign_summary(rows, chapters)  # of the version before

    def sample_chunks(self, n: int = 10) -> DataFrame:
        return evaluate.sample_spread(self.library.read(), n=n)

    # --- questions ---------------------------------------------------------------------

    def prepared(self) -> tuple[DataFrame, DataFrame]:
        """Profiles and chapter vectors of the newest version; computed once for it, encoded once for a book's titles."""
        version = self.library.version()
        if self._held is None or self._held[0] != version:
            self.forget()
            chunks = self.library.read(version=version)
            path = f"{self.root}/profiles/v{version}"
            if not exists(self.spark, f"{path}/_SUCCESS"):
                self.library.profiles(version).write.mode("overwrite").parquet(path)
            vectors = self._vectors(routing.chapters_in_order(chunks))
            self._held = (version, self.spark.read.parquet(path).persist(), vectors.persist())
        return self._held[1], self._held[2]

    def _vectors(self, chapters: DataFrame) -> DataFrame:
        path = f"{self.root}/chapter_vectors"
        stored = lambda: self.spark.read.schema(_VECTORS).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], _VECTORS)
        _, missing = routing.cached_chapter_vectors(chapters, stored(), self.encode, self.encoder)
        missing.write.mode("append").parquet(path)
        return routing.cached_chapter_vectors(chapters, stored(), self.encode, self.encoder)[0].drop("cache_key", "encoder")

    def forget(self) -> None:
        """Let go what is kept in memory; the next question loads it again."""
        if self._held is not None:
            for df in self._held[1:]:
                df.unpersist()
        self._held = None

    def ask(self, questions: DataFrame, *, top_k: int = ASK_TOP_K, force_all_books: bool = False, book: str | None = None) -> DataFrame:
        """Results of ``query_id, question``; ``book`` overrides routing to a book."""
        chunks = self.library.read()
        asked = questions.withColumn("embedding", self.encode(F.col("question")))
        if book:
            chosen = asked.withColumn("book_filter", F.lit(book)).withColumn("chapter_filter", F.lit(None).cast("string"))
            return fusion.hydrate(fusion.search(chunks, chosen, top_k=top_k, index=self.library, exact=self.exact), chunks.drop("embedding"))
        profiles, vectors = self.prepared()
        return query.ask(chunks, asked, profiles, vectors, top_k=top_k, force_all=force_all_books, index=self.library, exact=self.exact)

    def _patient(self, model: Callable[[str], str]) -> Callable[[str], str]:
        return query.with_retry(model, waits=self.waits, retriable=self.retriable) if self.retriable else model

    def debug(self, questions: DataFrame, *, top_k: int = 10) -> DataFrame:
        """Book-routed results with a flag on chapters that look like front or back matter."""
        chunks = self.library.read()
        asked = questions.withColumn("embedding", self.encode(F.col("question")))
        return query.debug_queries(chunks, asked, self.prepared()[0], top_k=top_k, index=self.library, exact=self.exact)

    def keyword_search(self, keyword: str, *, book: str | None = None, limit: int | None = None) -> DataFrame:
        """Chunks that hold a keyword; opens the files that may."""
        return self.library.keyword_search(keyword, book=book, limit=limit)

    def eval_set(self, path: str, *, limit: int | None = 20, todo: bool = False) -> int:
        """Write an evaluation set made of the library's chunks as a JSON array, or a template of one to fill in; returns its items."""
        chunks = self.library.read()
        made = evaluate.candidates_with_todo(chunks, limit=limit or 5) if todo else evaluate.generated_questions(chunks, limit=limit)
        items = [r.asDict(recursive=True) for r in made.collect()]  # ``limit`` rows
        _write_text(self.spark, path, json.dumps(items, ensure_ascii=False, indent=2))
        return len(items)

    def answer(self, questions: DataFrame, model: Callable[[str], str], **options) -> DataFrame:
        """``query_id, answer, answer_error`` of a text model over the results."""
        prompts = query.prompts(questions, self.ask(questions, **options))
        return query.call_model(prompts, self._patient(model)).select("query_id", "answer", "answer_error")

    def evaluate(self, items: DataFrame | None = None, model: Callable[[str], str] | None = None, *, path: str | None = None) -> str:
        """Metrics of search over all books, judged metrics of answers to them, as a report; written to ``path`` if given.

        ``items`` are those of :func:`readers.eval_set` (None: the built-in ones). Without
        a model, or if it fails, the judged part is skipped and the report says why.
        """
        items = readers.eval_set(self.spark, None) if items is None else items
        chunks = self.library.read()
        asked = items.select(F.col("id").alias("query_id"), "question").withColumn("embedding", self.encode(F.col("question")))
        found = fusion.hydrate(fusion.search(chunks, asked, top_k=10, index=self.library, exact=self.exact), chunks.drop("embedding")).persist()
        truth = items.select(F.col("id").alias("query_id"), F.col("ground_truth_chunk_id").alias("chunk_id"))
        retrieval = evaluate.metrics(truth, found).first().asDict()
        generation, skipped = None, "no text model was given"
        if model is not None:
            model = self._patient(model)
            first = found.where("pos <= 3")
            prompts = query.prompts(asked, first).join(query.contexts(first), "query_id", "left")
            answers = query.call_model(prompts, model).select("query_id", "answer", "answer_error", "context")
            judged = items.select(F.col("id").alias("query_id"), "question", F.col("ground_truth_answer").alias("truth")).join(answers, "query_id").persist()
            failed = judged.where("answer_error is not null").select("answer_error").orderBy("query_id").first()
            scores = None if failed else evaluate.generation_metrics(judged, model).first().asDict()
            skipped = failed[0] if failed else scores.pop("error")
            generation = None if skipped else scores
            judged.unpersist()
        found.unpersist()
        text = evaluate.report(retrieval, when=f"{datetime.now():%Y-%m-%d %H:%M}", size=items.count(), generation=generation, skipped=skipped)
        if path:
            _write_text(self.spark, path, text)
        return text

    # --- concepts ----------------------------------------------------------------------

    def extract_concepts(self, book: str, model: Callable[[str], str], *, chapter: str | None = None, pause: float = 0.0) -> DataFrame:
        """Extractions of a book's batches up to the first that fails; cached by text, resumed by the next call."""
        prompts = self._prompts(self.library.read(book), chapter)
        concepts.extract(prompts, self.cache, self._patient(model), pause=pause, callers=1).write.format("noop").mode("overwrite").save()
        return concepts.extracted(prompts, concepts.extraction_cache(self.spark, self.cache))

    def _prompts(self, rows: DataFrame, chapter: str | None = None) -> DataFrame:
        rows = rows.where(F.col("chapter") == chapter) if chapter else rows
        return concepts.batch_texts(concepts.batches(rows))

    def concept_graph(self, books: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of what has been extracted so far of whole books, in the order given (None: all, by title)."""
        rows = self.library.read()
        if books is not None:
            order = self.spark.createDataFrame([(b, i) for i, b in enumerate(books)], "book_title string, book_pos int")
            rows = rows.join(order.select("book_title"), "book_title", "left_semi")
        found = concepts.extracted(self._prompts(rows), concepts.extraction_cache(self.spark, self.cache))
        return concepts.graph(found if books is None else found.join(order, "book_title"))

    def concept_map(self, nodes: DataFrame, edges: DataFrame, title: str) -> str:
        return render.concept_map(nodes, edges, title=title)

    def reset(self) -> None:
        """Drop the library and every cache."""
        self.forget()
        self.library.reset()
        for folder in (self.cache, f"{self.root}/profiles", f"{self.root}/chapter_vectors", f"{self.root}/uploads"):
            _remove(self.spark, folder)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    p, system = _path(spark, path)
    out = system.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def _named(place: str) -> Callable[[str], str]:
    """The callable that ``module:name`` stands for."""
    module, _, name = place.partition(":")
    return getattr(importlib.import_module(module), name)


def main(arguments: list[str] | None = None) -> None:
    """``python -m foliospark.engine ROOT COMMAND ...``"""
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("root", help="folder of the library")
    sub = p.add_subparsers(dest="command", required=True)
    lines, toc = "Parquet of book_title, line_no, page_number, text, size", "Parquet of book_title, pos, level, title, start_page"
    one = sub.add_parser("ingest", help="replace books by those of a table of lines")
    one.add_argument("lines", help=lines)
    one.add_argument("--toc", help=toc)
    listed = sub.add_parser("list-chapters", help="chapters by table of contents, or by headings")
    listed.add_argument("lines", help=lines)
    listed.add_argument("--toc", help=toc)
    chapter = sub.add_parser("ingest-chapter", help="ingest one chapter, by its place in the list, as a book of its own")
    chapter.add_argument("lines", help=lines)
    chapter.add_argument("book")
    chapter.add_argument("index", type=int)
    chapter.add_argument("--toc", help=toc)
    sub.add_parser("list-books")
    sample = sub.add_parser("sample-chunks")
    sample.add_argument("-n", type=int, default=10)
    ask = sub.add_parser("ask")
    ask.add_argument("question")
    ask.add_argument("--all-books", action="store_true")
    ask.add_argument("--book")
    fix = sub.add_parser("fix-chapters")
    fix.add_argument("chapters", help="Parquet of book_title, pos, title, start_page, end_page")
    scored = sub.add_parser("evaluate", help="retrieval metrics as a report")
    scored.add_argument("--items", help="JSON of id, question, ground_truth_answer, ground_truth_chunk_id")
    scored.add_argument("--report", help="file to write")
    found = sub.add_parser("search", help="chunks that hold a keyword")
    found.add_argument("keyword")
    found.add_argument("--book")
    found.add_argument("--limit", type=int, default=5)
    debug = sub.add_parser("debug-query", help="results with their scores and a flag on front and back matter")
    debug.add_argument("question")
    for name, text in (("create-eval-set", "a template of an evaluation set to fill in"), ("generate-eval-set", "an evaluation set of questions made of chunks")):
        items = sub.add_parser(name, help=text)
        items.add_argument("path")
        items.add_argument("-n", type=int, default=5 if name == "create-eval-set" else 20)
    terms = sub.add_parser("extract-concepts", help="ask a text model for the terms of a book's batches; goes on where it broke off")
    terms.add_argument("book")
    terms.add_argument("--model", required=True, help="module:callable")
    terms.add_argument("--chapter")
    terms.add_argument("--pause", type=float, default=0.0)
    drawn = sub.add_parser("concept-map", help="a page with the graph of what was extracted")
    drawn.add_argument("path")
    drawn.add_argument("--title", default="Concepts")
    sub.add_parser("reset-library")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("foliospark").getOrCreate()
    engine = Engine(spark, a.root)
    contents = lambda: spark.read.parquet(a.toc) if a.toc else spark.createDataFrame([], "book_title string, pos int, level int, title string, start_page int")
    if a.command == "ingest":
        engine.ingest(spark.read.parquet(a.lines), toc=spark.read.parquet(a.toc) if a.toc else None)
    elif a.command == "list-chapters":
        found = engine.list_chapters(contents(), spark.read.parquet(a.lines))
        structure.chapter_labels(found).orderBy("book_title", "pos").show(1000, truncate=False)
    elif a.command == "ingest-chapter":
        rows = spark.read.parquet(a.lines).where(F.col("book_title") == a.book)
        found = engine.list_chapters(contents().where(F.col("book_title") == a.book), rows).where(F.col("pos") == a.index)
        if found.isEmpty():
            raise SystemExit(f"{a.book} has no chapter {a.index}; see list-chapters")
        engine.ingest_chapters(rows, found)
    elif a.command == "list-books":
        engine.library.read().groupBy("book_title").count().orderBy("book_title").show(truncate=False)
    elif a.command == "sample-chunks":
        engine.sample_chunks(a.n).select("book_title", "page_number", F.substring("text", 1, 200).alias("text")).show(truncate=False)
    elif a.command == "ask":
        q = spark.createDataFrame([(0, a.question)], "query_id long, question string")
        found = engine.ask(q, force_all_books=a.all_books, book=a.book)
        found.select("pos", "book_title", "chapter", "page_number", F.substring("text", 1, 200).alias("text")).orderBy("pos").show(truncate=False)
    elif a.command == "fix-chapters":
        engine.fix_chapters(spark.read.parquet(a.chapters)).show()
    elif a.command == "search":
        engine.keyword_search(a.keyword, book=a.book, limit=a.limit).show(a.limit, truncate=False)
    elif a.command == "debug-query":
        q = spark.createDataFrame([(0, a.question)], "query_id long, question string")
        engine.debug(q).select("pos", "rrf_score", "chunk_id", "chapter", "polluted").orderBy("pos").show(truncate=False)
    elif a.command in ("create-eval-set", "generate-eval-set"):
        print(engine.eval_set(a.path, limit=a.n, todo=a.command == "create-eval-set"), "items")
    elif a.command == "extract-concepts":
        print(engine.extract_concepts(a.book, _named(a.model), chapter=a.chapter, pause=a.pause).count(), "batches")
    elif a.command == "concept-map":
        _write_text(spark, a.path, engine.concept_map(*engine.concept_graph(), a.title))
    elif a.command == "evaluate":
        print(engine.evaluate(readers.eval_set(spark, a.items) if a.items else None, path=a.report))
    else:
        engine.reset()


if __name__ == "__main__":
    main()
