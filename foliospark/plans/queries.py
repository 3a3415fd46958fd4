"""Queries over the driver's tables.

``documents`` stand for a library (source: book, language: chapter, doc_id: page and
position), or for books of their own where structure is asked for; ``benchmark`` items
are questions; ``conversations`` are tables of contents (role: level, turn: position and
page) and streams of text; words of ``benchmark`` items are concepts, neighbours related.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import bm25, chunking, concepts, dense, evaluate, fusion, query, routing, store, structure
from ..operators.indexes import ChunkIndex, IndexedLibrary
from ..operators.sizes import broadcast_if_small, spread
from ..sources import documents, readers
from ..streaming import sentences as S
from ..streaming import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_CHANGED: dict[tuple, IndexedLibrary] = {}


def _flat(df: DataFrame) -> DataFrame:
    """Whole numbers as long, lists of words as one string: what SQL gives for them."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.IntegerType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def registered(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: _flat(f(Tables(spark, sf_dir)))
    return f


class Tables:
    """The driver's tables, and what they stand for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def chunks(self, vectors: bool = False) -> DataFrame:
        return readers.documents_as_chunks(self.documents, self.embeddings if vectors else None)

    def questions(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))

    def filtered_questions(self) -> DataFrame:
        """Every question asks one source; those of even ids ask English documents only."""
        return self.questions().withColumn("book_filter", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))).withColumn(
            "chapter_filter", F.when(F.col("query_id") % 2 == 0, "en")
        )

    def vector_questions(self) -> DataFrame:
        v = self.embeddings.select(F.col("vec_id").alias("query_id"), "embedding")
        return self.questions().join(v, "query_id")

    def vectors(self) -> DataFrame:
        return self.embeddings.select(
            F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("chunk_id"), F.col("vec_id").alias("corpus_pos"),
            F.col("label").cast("string").alias("book_title"), F.lit(None).cast("string").alias("chapter"), "embedding",
        )

    def vector_queries(self) -> DataFrame:
        """The stated query set: every vector whose id is divisible by 50."""
        return self.embeddings.where("vec_id % 50 = 0").select(
            F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("string").alias("book_filter")
        )

    def lines(self) -> DataFrame:
        """Lines of documents, each a book of pages of ten lines."""
        one = readers.text_lines(self.documents, book=F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
        return one.withColumn("page_number", (F.floor(F.col("line_no") / 10) + 1).cast("int"))

    def levelled(self) -> DataFrame:
        return structure.heading_levels(self.lines())

    def book_pages(self) -> DataFrame:
        return self.lines().groupBy("book_title").agg(F.max("page_number").alias("n_pages"))

    def toc(self) -> DataFrame:
        level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
        return self.conversations.select(
            F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("book_title"), F.col("turn").cast("int").alias("pos"), level.alias("level"),
            F.concat(F.floor(F.col("turn") / 2).cast("string"), F.lit(".1 "), F.coalesce("text", F.lit(""))).alias("title"),
            F.col("turn").cast("int").alias("start_page"),
        )

    def toc_pages(self) -> DataFrame:
        return self.toc().groupBy("book_title").agg((F.max("start_page") + 3).alias("n_pages"))

    def source_ranges(self) -> DataFrame:
        """Two overlapping page ranges of each source; later pages lie in none."""
        top = self.documents.groupBy(F.col("source").alias("book_title")).agg(F.max("doc_id").alias("top"))
        half = lambda a, b, pos, title: F.struct(F.lit(pos).alias("pos"), F.lit(title).alias("title"), F.floor(F.col("top") * a).cast("int").alias("start_page"), F.floor(F.col("top") * b).cast("int").alias("end_page"))
        return top.select("book_title", F.explode(F.array(half(0.0, 0.5, 0, "en"), half(0.25, 0.75, 1, "later"))).alias("r")).select("book_title", "r.*", F.lit(1).alias("level"))

    def terms(self) -> DataFrame:
        words = F.posexplode(X.whitespace_tokens("text")).alias("at", "term")
        return self.benchmark.select((F.col("item_id") % 5).alias("book_pos"), "item_id", words).select(
            F.concat(F.lit("b"), F.col("book_pos").cast("string")).alias("book_title"), "book_pos",
            (F.col("item_id") * 1000 + F.col("at")).alias("term_pos"), "term", F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("definition"),
        )

    def relations(self) -> DataFrame:
        words = X.whitespace_tokens("text")
        pairs = F.arrays_zip(F.slice(words, 1, F.size(words) - 1).alias("source"), F.slice(words, 2, F.size(words)).alias("target"))
        rows = self.benchmark.where(F.size(words) > 1).select((F.col("item_id") % 5).alias("book_pos"), "item_id", F.posexplode(pairs).alias("at", "p"))
        return rows.select(
            F.concat(F.lit("b"), F.col("book_pos").cast("string")).alias("book_title"), "book_pos", (F.col("item_id") * 1000 + F.col("at")).alias("rel_pos"),
            F.col("p.source").alias("source"), F.concat(F.lit("r"), F.col("at").cast("string")).alias("relation"), F.col("p.target").alias("target"),
        )

    def graph(self) -> tuple[DataFrame, DataFrame]:
        nodes = concepts.nodes(self.terms())
        return nodes, concepts.edges(self.relations(), nodes)

    def truths(self) -> DataFrame:
        """Documents that hold an item's whole text; items without one are not in it.

        All words of an item but the first and the last stand whole in such a document, so
        the longest of them leads to the few that are searched. Items of one or two words,
        which have none, are looked for in every document.
        """
        words = F.split("text", r"(?U)\s+")
        items = self.benchmark.where("text is not null").select("item_id", F.col("text").alias("item"), words.alias("w"))
        inner = F.array_sort(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0))), lambda a, b: F.length(b) - F.length(a))
        long = items.where(F.size("w") > 2).select("item_id", inner[0].alias("word"))
        docs = spread(self.documents.select("doc_id", "source", "text"))
        led = docs.select("doc_id", F.explode(F.array_distinct(words)).alias("word")).join(broadcast_if_small(long), "word").select("doc_id", "item_id").distinct()
        whole = items.select("item_id", "item")
        held = docs.join(led, "doc_id").join(whole, "item_id").where(F.contains("text", F.col("item"))).select("doc_id", "source", "item_id")
        for block in self._blocks(items.where(F.size("w") <= 2).select("item_id", "item")):
            some = self.spark.createDataFrame([(block,)], "items array<struct<item_id:long,item:string>>")  # one row, of bounded bytes
            rest = docs.crossJoin(F.broadcast(some)).select("doc_id", "source", F.explode(F.filter("items", lambda i: F.contains(F.col("text"), i["item"]))).alias("i"))
            held = held.unionByName(rest.select("doc_id", "source", "i.item_id"))
        return held.select(F.col("item_id").alias("query_id"), F.concat(X.slug("source"), F.lit("_p"), F.col("doc_id").cast("string"), F.lit("_g0_c0")).alias("chunk_id"))

    @staticmethod
    def _blocks(items: DataFrame, block_bytes: int = 1 << 20) -> Iterator[list]:
        """Items in blocks of bounded bytes, each to be looked for in every document at once."""
        block, size = [], 0
        for r in items.toLocalIterator():
            block.append((r["item_id"], r["item"]))
            size += 16 + len(r["item"])
            if size >= block_bytes:
                yield block
                block, size = [], 0
        if block:
            yield block

    def extractions(self) -> DataFrame:
        """What a text model might say of each item: its words as terms, neighbours related."""
        words = X.whitespace_tokens("text")
        named = F.transform(words, lambda w: F.struct(w.alias("term"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("definition")))
        pairs = F.transform(
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda w, i: F.struct(words[i].alias("source"), F.concat(F.lit("r"), i.cast("string")).alias("relation"), w.alias("target")),
        )
        said = F.concat(F.lit("```json\n"), F.to_json(F.struct(named.alias("terms"), pairs.alias("relations"))), F.lit("\n```"))
        return concepts.parse(
            self.benchmark.select(F.concat(F.lit("b"), (F.col("item_id") % 5).cast("string")).alias("book_title"), F.col("item_id").cast("int").alias("batch_id"), said.alias("answer"))
        )

    def library(self) -> store.Library:
        """The chunks as a stored library of their own."""
        out = store.Library(self.spark, store.scratch(self.spark, "library"))
        out.rebuild(self.chunks())
        return out

    def changed_library(self) -> IndexedLibrary:
        """A library with indexes after five versions: all books; one rewritten and one new; chunks deleted; a book dropped; the rewritten one again.

        Queries of one application share it while it is there.
        """
        name = (self.spark.sparkContext.applicationId, self.sf_dir, self.spark.conf.get("spark.checkpoint.dir", None))
        out = _CHANGED.get(name)
        if out is not None and out.version() == 5:
            return out
        out = IndexedLibrary(self.spark, store.scratch(self.spark, "library"))
        chunks = self.chunks(vectors=True)  # not every chunk has one
        out.rebuild(chunks)
        said = F.concat(F.coalesce("text", F.lit("")), F.lit(" Revised TOKEN words revised"))
        again = chunks.where("book_title = 'src1' and corpus_pos % 3 > 0").withColumn("text", said)
        out.upsert(again.unionByName(chunks.where("book_title = 'src3' and corpus_pos % 4 = 3").withColumn("book_title", F.lit("new — book"))))
        out.delete_ids(chunks.where("corpus_pos % 11 = 0 and book_title not in ('src1', 'src3')").select("chunk_id"))
        out.delete_book("src2")
        out.upsert(again.where("corpus_pos % 7 > 1"))
        _CHANGED[name] = out
        return out

    def by_length(self) -> DataFrame:
        return self._ranking(F.desc("n_chars"))

    def by_id(self) -> DataFrame:
        return self._ranking(F.col("doc_id"))

    def _ranking(self, order) -> DataFrame:
        from pyspark.sql import Window

        w = Window.partitionBy("source").orderBy(order, "doc_id")
        ranked = self.documents.select("source", "doc_id", "n_chars").withColumn("rank0", F.row_number().over(w) - 1).where("rank0 < 20")
        return ranked.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id"), "rank0")


# --- retrieval ---------------------------------------------------------------------------


@registered
def bm25_topk(t: Tables) -> DataFrame:
    return bm25.top_k(t.chunks(), t.questions())


@registered
def bm25_filtered(t: Tables) -> DataFrame:
    return bm25.top_k(t.chunks(), t.filtered_questions())


@registered
def bm25_idf(t: Tables) -> DataFrame:
    return bm25.idf(t.chunks()).withColumn("idf", F.round("idf", 6))


@registered
def dense_topk(t: Tables) -> DataFrame:
    return dense.top_k(t.vectors(), t.vector_queries().drop("book_filter"))


@registered
def dense_filtered(t: Tables) -> DataFrame:
    return dense.top_k(t.vectors(), t.vector_queries())


@registered
def rrf_fusion(t: Tables) -> DataFrame:
    return fusion.fuse(t.by_length(), t.by_id())


@registered
def hybrid_search(t: Tables) -> DataFrame:
    found = fusion.search(t.chunks(vectors=True), t.vector_questions())
    return fusion.hydrate(found, t.chunks()).select("query_id", "pos", "found_pos", "chunk_id", "rrf_score", "book_title", "chapter", "page_number")


@registered
def orphan_results(t: Tables) -> DataFrame:
    library = t.labels.select(F.col("doc_id").cast("string").alias("chunk_id"))
    return fusion.orphans(fusion.fuse(t.by_length(), t.by_id(), top_k=10), library)


@registered
def hydrated_results(t: Tables) -> DataFrame:
    library = t.labels.select(F.col("doc_id").cast("string").alias("chunk_id"), "quality")
    return fusion.hydrate(fusion.fuse(t.by_length(), t.by_id(), top_k=10), library).select("query_id", "pos", "found_pos", "chunk_id", "quality")


@registered
def book_profiles(t: Tables) -> DataFrame:
    return routing.book_profiles(t.chunks()).withColumn("score", F.round("score", 6))


@registered
def route_book(t: Tables) -> DataFrame:
    return routing.route_books(t.questions(), routing.book_profiles(t.chunks()))


def _label_vectors(t: Tables) -> DataFrame:
    parts = t.embeddings.select(F.col("label").cast("string").alias("chapter"), F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("chapter", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy("chapter").agg(v.alias("embedding")).select(F.lit("all").alias("book_title"), "chapter", F.col("chapter").cast("int").alias("chapter_pos"), "embedding")


@registered
def route_chapter(t: Tables) -> DataFrame:
    asked = t.vector_queries().select("query_id", "embedding", F.lit("all").alias("book_filter"))
    return routing.route_chapters(asked, _label_vectors(t), min_margin=1.15, min_similarity=0.25)


@registered
def debug_query(t: Tables) -> DataFrame:
    index = ChunkIndex(t.chunks(), t.chunks(vectors=True))
    found = query.debug_queries(t.chunks(), t.vector_questions(), index.profiles, index=index)
    index.release()
    return found.select("query_id", "pos", "chunk_id", "rrf_score", "polluted")


@registered
def ask_routed(t: Tables) -> DataFrame:
    """Questions routed to a book and to a chapter, a language's vector being its name's."""
    index = ChunkIndex(t.chunks(), t.chunks(vectors=True))
    vectors = routing.chapter_vectors(routing.chapters_in_order(t.chunks()), readers.hashed_embedding)
    found = query.ask(t.chunks(), t.vector_questions(), index.profiles, vectors, index=index)
    index.release()
    return found.select("query_id", "pos", "chunk_id", "rrf_score", "book_filter", "chapter_filter")


@registered
def keyword_search_snippet(t: Tables) -> DataFrame:
    return query.keyword_search(t.chunks(), "Token").select("chunk_id", "book_title", "snippet")


@registered
def keyword_first_matches(t: Tables) -> DataFrame:
    return query.keyword_search(t.chunks(), "token", book="src1", limit=5).select("chunk_id", "snippet")


@registered
def pollution_flag(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.is_polluted("text").alias("polluted"))


@registered
def format_context(t: Tables) -> DataFrame:
    found = fusion.fuse(t.by_length(), t.by_id(), top_k=3)
    docs = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("lang").alias("chapter"), F.lit("Unknown").alias("section"), F.col("doc_id").alias("page_number"))
    return query.contexts(found.join(docs, "chunk_id")).select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("n_chars"))


@registered
def library_changes(t: Tables) -> DataFrame:
    """The rows between the first and the newest version of a changed library."""
    rows = t.changed_library().changes(1)
    return rows.select("change", "chunk_id", "book_title", F.md5("text").alias("text_md5"))


@registered
def library_changes_step(t: Tables) -> DataFrame:
    """The rows that deleting chunks has changed: what the rewritten books have kept is not among them."""
    return t.changed_library().changes(2, 3).select("change", "chunk_id", "book_title")


@registered
def library_search(t: Tables) -> DataFrame:
    """BM25 from the postings and statistics that a changed library has kept."""
    return t.changed_library().search(t.questions())


@registered
def library_vocabulary(t: Tables) -> DataFrame:
    """Document frequencies by signed deltas after the changes."""
    return t.changed_library().vocabulary()


@registered
def library_sizes(t: Tables) -> DataFrame:
    """Totals by signed deltas at every version."""
    library = t.changed_library()
    parts = [library.statistics(v).where("kind = 'size'").select(F.lit(v).alias("version"), F.col("term").alias("name"), "value") for v in range(1, 6)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered
def library_profiles(t: Tables) -> DataFrame:
    """Book profiles from stored counts after the changes."""
    return t.changed_library().profiles().withColumn("score", F.round("score", 6))


@registered
def library_nearest(t: Tables) -> DataFrame:
    """Vectors nearest to the questions', from the lists of a changed library, all of them read."""
    return t.changed_library().nearest(t.vector_questions(), exact=True).select("query_id", "chunk_id", "rank0")


@registered
def library_nearest_probed(t: Tables) -> DataFrame:
    """As ``library_nearest`` from the lists nearest to each question."""
    return t.changed_library().nearest(t.vector_questions()).select("query_id", "chunk_id", "rank0")


@registered
def library_keyword(t: Tables) -> DataFrame:
    """A substring in a changed library, by the files whose trigrams may hold it."""
    return t.changed_library().keyword_search("revised token").select("chunk_id", "book_title", "snippet")


@registered
def library_pages(t: Tables) -> DataFrame:
    """A range of pages of a changed library; files of other pages are not opened."""
    return t.changed_library().read(pages=(100, 400)).select("chunk_id", "book_title", "page_number")


# --- structure ---------------------------------------------------------------------------


@registered
def text_lines(t: Tables) -> DataFrame:
    return t.lines()


@registered
def html_lines(t: Tables) -> DataFrame:
    return readers.html_lines(t.pages).select("book_title", "line_no", "page_number", "text", "size")


@registered
def html_toc(t: Tables) -> DataFrame:
    return readers.html_toc(t.pages)


@registered
def body_size_mode(t: Tables) -> DataFrame:
    return structure.body_size(t.lines())


@registered
def heading_levels(t: Tables) -> DataFrame:
    return t.levelled().select("book_title", "line_no", "page_number", "level")


@registered
def page_offset(t: Tables) -> DataFrame:
    return structure.heading_levels(t.lines(), page_offset=7).select("book_title", "line_no", "page_number", "level")


@registered
def document_lines(t: Tables) -> DataFrame:
    """Pages 2 to 40 of files of a hundred web pages each, by the source of documents: a page a line of the file, its text between tags."""
    folder = store.scratch(t.spark, "files")
    bare = F.regexp_replace(F.coalesce("html", F.lit("")), r"[\r\n]+", " ")
    pages = t.pages.select(F.floor(F.col("page_id") / 100).cast("long").alias("doc"), "page_id", bare.alias("line"))
    pages.repartition("doc").sortWithinPartitions("doc", "page_id").select("doc", "line").write.partitionBy("doc").text(folder)
    documents.register(t.spark, _html_parser, name="html_files")
    rows = t.spark.read.format("html_files").load(folder).where("page_number between 2 and 40")
    doc = F.regexp_extract("path", r"doc=(\d+)", 1).cast("long").alias("doc")
    return rows.select(doc, "page_number", (F.col("line_no") % documents.PAGE_LINES).alias("nth"), "text", "size")


def _html_parser(content: bytes, first: int, last: int) -> list:
    import re

    pages = content.decode("utf-8").split("\n")[first - 1 : last]
    return [(first + i, [(x.strip(" "), len(x) % 7 + 10) for x in re.split("<[^>]*>", page) if x.strip(" ")]) for i, page in enumerate(pages)]



@registered
def list_chapters(t: Tables) -> DataFrame:
    """Contents of conversations, headings of documents."""
    pages = t.toc_pages().unionByName(t.book_pages())
    return structure.list_chapters(t.toc(), t.levelled(), pages)


@registered
def heading_groups(t: Tables) -> DataFrame:
    return structure.heading_groups(t.levelled())


@registered
def heading_ranges(t: Tables) -> DataFrame:
    return structure.heading_ranges(t.levelled(), t.book_pages())


@registered
def page_slice(t: Tables) -> DataFrame:
    return structure.page_slice(t.lines(), 2, 3).select("book_title", "line_no", "page_number", "text")


@registered
def toc_ranges(t: Tables) -> DataFrame:
    return structure.toc_ranges(t.toc(), t.toc_pages())


@registered
def chapter_labels(t: Tables) -> DataFrame:
    return structure.chapter_labels(structure.toc_ranges(t.toc(), t.toc_pages()))


@registered
def content_start(t: Tables) -> DataFrame:
    return structure.content_start(t.toc(), t.toc())


@registered
def content_chapters(t: Tables) -> DataFrame:
    return structure.content_chapters(structure.toc_ranges(t.toc(), t.toc_pages()))


@registered
def leading_number_groups(t: Tables) -> DataFrame:
    return structure.leading_number_groups(structure.toc_ranges(t.toc(), t.toc_pages()))


@registered
def single_chapter(t: Tables) -> DataFrame:
    heads = structure.heading_ranges(t.levelled(), t.book_pages())
    return structure.single_chapter(t.lines(), heads).select("book_title", "line_no", "page_number", "text")


@registered
def reassign_chapters(t: Tables) -> DataFrame:
    return structure.reassign_chapters(t.chunks(), t.source_ranges()).select("chunk_id", "book_title", "chapter", "page_number")


@registered
def reassign_summary(t: Tables) -> DataFrame:
    return structure.reassign_summary(t.chunks(), t.source_ranges())


# --- library -----------------------------------------------------------------------------


@registered
def chunk_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.chunk_id("source", "doc_id", F.lit(0), F.lit(0)).alias("chunk_id"))


@registered
def upsert_book(t: Tables) -> DataFrame:
    labelled = t.documents.where("source = 'src1'").join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return store.upserted(t.chunks(), readers.documents_as_chunks(labelled)).select("chunk_id", "book_title", "corpus_pos")


@registered
def delete_by_ids(t: Tables) -> DataFrame:
    bad = readers.documents_as_chunks(t.documents.join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi"))
    return store.without_ids(t.chunks(), bad).select("chunk_id", "book_title")


@registered
def stored_upsert(t: Tables) -> DataFrame:
    """A stored library after one source's chunks were replaced twice by the labelled ones, one was deleted, and one is new."""
    library = t.library()
    labelled = readers.documents_as_chunks(t.documents.where("source = 'src1'").join(t.labels.select("doc_id"), "doc_id", "left_semi"))
    library.upsert(labelled)
    library.upsert(labelled)
    library.delete_book("src2")
    library.upsert(t.chunks().where("book_title = 'src3'").withColumn("book_title", F.lit("007 — [b=c], é%")))
    return library.read().select("chunk_id", "book_title", F.md5("text").alias("text_md5"))


@registered
def stored_delete_ids(t: Tables) -> DataFrame:
    library = t.library()
    bad = t.documents.join(t.labels.where("quality = 0").select("doc_id"), "doc_id", "left_semi")
    library.delete_ids(readers.documents_as_chunks(bad).select("chunk_id"))
    return library.read().select("chunk_id", "book_title", "corpus_pos")


@registered
def stored_fix_chapters(t: Tables) -> DataFrame:
    library = t.library()
    chapters = t.source_ranges()
    rows = library.read()
    library.replace(chapters.select("book_title").distinct(), structure.reassign_chapters(rows, chapters))
    return library.read().select("chunk_id", "book_title", "chapter", "page_number")


@registered
def library_wire(t: Tables) -> DataFrame:
    """Chunks written as a library's JSON and read again."""
    path = store.scratch(t.spark, "wire")
    chunking.to_wire(t.chunks()).write.json(path)
    wire = readers.library_json(t.spark, path, lines=True)
    return wire.select("chunk_id", F.md5("text").alias("text_md5"), "book_title", "chapter", "section", "page_number", "chunk_index_on_page")


def _raw_chunks(t: Tables) -> DataFrame:
    page = F.when(F.col("lang") == "fr", F.lit("iv")).otherwise(F.col("doc_id").cast("string"))
    return t.documents.select(
        F.when(F.col("lang") != "es", F.col("doc_id").cast("string")).alias("chunk_id"), "text", F.col("source").alias("book_title"),
        page.alias("page_number"), F.lit("0").alias("chunk_index_on_page"),
    )


@registered
def validate_chunks(t: Tables) -> DataFrame:
    return chunking.validated(_raw_chunks(t)).groupBy("valid", "reason").agg(F.count("*").alias("n"), F.coalesce(F.sum("page_number"), F.lit(0)).alias("sum_pages"))


@registered
def id_collisions(t: Tables) -> DataFrame:
    two = t.chunks().unionByName(t.chunks().where("chapter = 'de'").withColumn("book_title", F.upper("book_title")))
    return chunking.id_collisions(two)


@registered
def library_stats(t: Tables) -> DataFrame:
    return store.stats(t.chunks())


@registered
def library_books(t: Tables) -> DataFrame:
    return store.books(t.chunks())


@registered
def chapters_in_order(t: Tables) -> DataFrame:
    return routing.chapters_in_order(t.chunks())


@registered
def sample_spread(t: Tables) -> DataFrame:
    return evaluate.sample_spread(t.chunks()).select("book_title", "chunk_id", "page_number", "nth")


@registered
def chapter_cache_key(t: Tables) -> DataFrame:
    return store.chapter_cache_key(routing.chapters_in_order(t.chunks()))


@registered
def extraction_batches(t: Tables) -> DataFrame:
    return concepts.batches(t.chunks().select("book_title", "corpus_pos", "chunk_id")).select("book_title", "chunk_id", "batch_id")


@registered
def batch_keys(t: Tables) -> DataFrame:
    return store.batch_keys(concepts.batches(t.chunks().select("book_title", "corpus_pos", "chunk_id")))


@registered
def pending_batches(t: Tables) -> DataFrame:
    keys = store.batch_keys(concepts.batches(t.chunks().select("book_title", "corpus_pos", "chunk_id")))
    return store.pending(keys, keys.where("batch_id % 2 = 0"))


@registered
def calls_needed(t: Tables) -> DataFrame:
    return concepts.calls_needed(t.chunks())


@registered
def extraction_prompts(t: Tables) -> DataFrame:
    prompts = concepts.batch_texts(concepts.batches(t.chunks()))
    return prompts.select("book_title", "batch_id", "cache_key", "text_key", F.md5("prompt").alias("prompt_md5"))


# --- concepts ----------------------------------------------------------------------------


@registered
def concept_nodes(t: Tables) -> DataFrame:
    return t.graph()[0].drop("book_pos", "term_pos")


@registered
def concept_edges(t: Tables) -> DataFrame:
    return t.graph()[1].drop("book_pos", "rel_pos")


@registered
def extracted_terms(t: Tables) -> DataFrame:
    return concepts.terms(t.extractions())


@registered
def extracted_relations(t: Tables) -> DataFrame:
    return concepts.relations(t.extractions())


@registered
def extracted_nodes(t: Tables) -> DataFrame:
    return concepts.graph(t.extractions())[0].drop("book_pos", "term_pos")


@registered
def extracted_edges(t: Tables) -> DataFrame:
    return concepts.graph(t.extractions())[1].drop("book_pos", "rel_pos")


@registered
def concept_node_filter(t: Tables) -> DataFrame:
    nodes = t.graph()[0]
    return concepts.filter_nodes(nodes, "definition", ["item 0", "item 7", "no item"]).select("term_id", "definition")


@registered
def concept_edge_payload(t: Tables) -> DataFrame:
    return concepts.edge_payload(t.graph()[1]).drop("book_pos", "rel_pos")


@registered
def concept_degree(t: Tables) -> DataFrame:
    return concepts.degrees(*t.graph())


@registered
def concept_related(t: Tables) -> DataFrame:
    r = concepts.related(*t.graph())
    return r.select("term_id", "n_related", F.array_join(F.transform("related", lambda s: F.concat(s["relation"], F.lit(">"), s["term"])), ",").alias("related"))


@registered
def concept_colours(t: Tables) -> DataFrame:
    return concepts.colours(t.graph()[0])


@registered
def concept_two_hop(t: Tables) -> DataFrame:
    nodes, edges = t.graph()
    return concepts.two_hops(edges, concepts.degrees(nodes, edges).where("is_hub").select("term_id"))


@registered
def graph_summary(t: Tables) -> DataFrame:
    return concepts.summary(*t.graph())


@registered
def concept_node_labels(t: Tables) -> DataFrame:
    return concepts.node_payload(*t.graph()).select("id", "label", "kind", "isCrossRef")


@registered
def concept_edge_filter(t: Tables) -> DataFrame:
    return concepts.filter_edges(t.graph()[1], "relation", ["r1", "r2"])


# --- evaluation --------------------------------------------------------------------------


def _metrics(t: Tables) -> DataFrame:
    found = fusion.fuse(t.by_length(), t.by_id(), top_k=10)
    library = t.labels.select(F.col("doc_id").cast("string").alias("chunk_id"))
    truth = t.documents.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return evaluate.metrics(truth.select(F.col("source").alias("query_id"), F.col("doc_id").cast("string").alias("chunk_id")), fusion.hydrate(found, library))


@registered
def hit_rate_and_mrr(t: Tables) -> DataFrame:
    m = _metrics(t)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@registered
def benchmark_truths(t: Tables) -> DataFrame:
    return t.truths()


@registered
def retrieval_eval(t: Tables) -> DataFrame:
    """Hits and reciprocal rank of lexical search for passages that some document holds whole."""
    ranked = bm25.top_k(t.chunks(), t.questions()).select("query_id", "chunk_id", (F.col("rank0") + 1).alias("pos"), (F.col("rank0") + 1).alias("found_pos"))
    m = evaluate.metrics(t.truths(), ranked)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@registered
def mean_judge_scores(t: Tables) -> DataFrame:
    judged = t.documents.select("lang", X.judge_score("text").alias("score"))
    return evaluate.mean_scores(judged, ["lang"]).withColumn("mean_score", F.round("mean_score", 6))


@registered
def judged_items(t: Tables) -> DataFrame:
    """A judge that says 1 to prompts of an odd number of characters and raises at every eleventh length."""

    def model(prompt: str) -> str:
        if len(prompt) % 11 == 0:
            raise TimeoutError(str(len(prompt)))
        return f"I say {len(prompt) % 2}."

    items = t.benchmark.select("item_id", F.col("text").alias("context"), F.col("item_id").cast("string").alias("answer"))
    return evaluate.judge(items, model, kind="faithfulness").select("item_id", "score", "judged_error")


@registered
def eval_slice(t: Tables) -> DataFrame:
    """The fourth to the eleventh question, as the generation metrics are tried on."""
    rows = evaluate.generated_questions(t.chunks(), limit=None).withColumn("nth", F.substring("id", 2, 20).cast("long"))
    return query.nth_rows(rows, ["nth"], 3, 8).select("id", "question")


@registered
def eval_set_json(t: Tables) -> DataFrame:
    """An evaluation set from JSON files of some items each."""
    folder = store.scratch(t.spark, "items")
    item = F.struct(
        F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.coalesce("text", F.lit("")).alias("question"),
        F.md5("text").alias("ground_truth_answer"), F.concat(F.lit("c"), F.col("item_id").cast("string")).alias("ground_truth_chunk_id"),
    )
    some = t.benchmark.groupBy(F.floor(F.col("item_id") / 20).cast("long").alias("part")).agg(F.to_json(F.collect_list(item)).alias("value"))  # twenty items a file
    some.repartition("part").write.partitionBy("part").text(folder)
    return readers.eval_set(t.spark, folder).select("id", "question", "ground_truth_answer", "ground_truth_chunk_id")


@registered
def answer_prompts(t: Tables) -> DataFrame:
    found = fusion.fuse(t.by_length(), t.by_id(), top_k=3)
    docs = t.documents.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("lang").alias("chapter"), F.lit("Unknown").alias("section"), F.col("doc_id").alias("page_number"))
    asked = t.documents.select(F.col("source").alias("query_id")).distinct().withColumn("question", F.concat(F.lit("What of "), "query_id", F.lit("?")))
    return query.prompts(asked, found.join(docs, "chunk_id")).select("query_id", F.md5("prompt").alias("prompt_md5"))


@registered
def eval_candidates(t: Tables) -> DataFrame:
    return evaluate.candidates_with_todo(t.chunks())


@registered
def eval_questions(t: Tables) -> DataFrame:
    return evaluate.generated_questions(t.chunks(), limit=None)


@registered
def eval_questions_first(t: Tables) -> DataFrame:
    return evaluate.generated_questions(t.chunks())


@registered
def parse_judge_score(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.judge_score("text").alias("score"))


@registered
def sentences_sql(t: Tables) -> DataFrame:
    """Every conversation as a stream of its turns, cut into sentences by the table function in SQL."""
    sql.register(t.spark)
    turns = t.conversations.select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.concat("text", F.lit(" ")).alias("piece"))
    return t.spark.sql("SELECT stream_id, sentence_no, sentence FROM sentences_of(TABLE({turns}))", turns=turns)


# --- text --------------------------------------------------------------------------------


@registered
def word_counts(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.whitespace_tokens("text")).alias("n_tokens"), F.size(X.word_tokens("text")).alias("n_words"))


@registered
def strip_citations(t: Tables) -> DataFrame:
    """Whole texts, with a citation before, within and after them."""
    mark = F.lit(" (Chapter 1, Section 2, p.12)")
    half = F.floor(F.length("text") / 2).cast("int")
    cited = F.concat(mark, F.substr("text", F.lit(1), half), mark, F.substr("text", half + 1), mark)
    return t.documents.select("doc_id", F.md5(X.strip_citations(cited)).alias("text_md5"))


@registered
def fence_stripped(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(X.fence_stripped(F.concat(F.lit("```json "), F.coalesce("text", F.lit("")), F.lit(" ```")))).alias("text_md5"))


@registered
def latex_to_spoken(t: Tables) -> DataFrame:
    """Whole texts, with a formula of each kind after them."""
    n = F.col("doc_id").cast("string")
    formulas = F.concat(
        F.lit(r" Let $\frac{"), n, F.lit(r"}{n}\sum_{i=1}^{n} x_i \leq \alpha^2$ and E = mc^3 \times y^{k+1}, $\nabla_\theta L$; "),
        F.lit(r"a^2^3 b^{2}^n, x_{i}_j c_d_e $$\beta \neq \pi \cdot z^10$$ (see p.4) \geq é^2."),
    )
    return t.documents.select("doc_id", F.md5(X.speech_text(F.concat(F.coalesce("text", F.lit("")), formulas))).alias("spoken_md5"))


@registered
def sentence_end_test(t: Tables) -> DataFrame:
    lines = t.lines().select("book_title", "line_no", F.concat("text", F.lit(".")).alias("cited"), "text")
    return lines.select("book_title", "line_no", X.is_sentence_end("text").alias("ends"), X.is_sentence_end("cited").alias("cited_ends"))


@registered
def html_escape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.md5(X.html_escaped("html")).alias("escaped_md5"))


@registered
def split_chunks(t: Tables) -> DataFrame:
    return chunking.split_groups(t.documents.select("doc_id", "text")).select("doc_id", "sub_index", "chunk_text")


@registered
def build_chunks(t: Tables) -> DataFrame:
    return chunking.build_chunks(structure.heading_groups(t.levelled()))


@registered
def sentences(t: Tables) -> DataFrame:
    return S.sentences(t.conversations.select("conv_id", "turn", "text")).select("conv_id", "turn", "sentence_no", "sentence")
