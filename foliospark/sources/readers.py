"""Sources as DataFrames with explicit schemas."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import CHUNK_WIRE, EVAL_SET, UNKNOWN
from ..shipping import ship

#: A style's proxy sizes for HTML, which has no font sizes of its own.
HTML_SIZES = {"h1": 18.0, "h2": 15.0, "h3": 13.0, "p": 10.0, "li": 10.0}

_LINES = "book_title string, line_no bigint, page_number int, text string, size double"


def text_lines(documents: DataFrame, *, book: str | Column = "source", page: str | Column = "doc_id", text: str = "text", size: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines of plain texts, a page a row; blank lines are dropped, others stripped.

    ``size`` makes a line's size of its text, for texts have none. By default short
    lines are taken for headings: up to 24 characters 16, up to 48 13, else 10.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    default = lambda t: F.when(F.length(t) <= 24, 16.0).when(F.length(t) <= 48, 13.0).otherwise(10.0)
    lines = documents.select(
        as_col(book).alias("book_title"), as_col(page).cast("int").alias("page_number"), F.posexplode(F.split(text, "\n")).alias("line_no", "text")
    ).withColumn("text", F.trim("text"))
    lines = lines.where("text != ''").withColumn("size", F.round((size or default)(F.col("text")), 1))
    return lines.select("book_title", F.col("line_no").cast("long").alias("line_no"), "page_number", "text", "size")


def html_lines(pages: DataFrame, *, book: str | Column = "url", page: str | Column = "page_id", html: str = "html", sizes: dict[str, float] | None = None) -> DataFrame:
    """Lines of HTML by tag, sized by :data:`HTML_SIZES`; tags inside a line are dropped."""
    sizes = sizes or HTML_SIZES
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    tags = "|".join(sizes)
    found = F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<(?:{tags})\b[^>]*>.*?</(?:{tags})>)"), F.lit(1))
    lines = pages.select(as_col(book).alias("book_title"), as_col(page).cast("int").alias("page_number"), F.posexplode(found).alias("line_no", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<(\w+)", 1))
    size = F.lit(10.0)
    for name, value in sizes.items():
        size = F.when(tag == name, value).otherwise(size)
    bare = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"\s+", " "))
    lines = lines.select("book_title", F.col("line_no").cast("long").alias("line_no"), "page_number", bare.alias("text"), size.alias("size"))
    return lines.where("text != ''")


def html_toc(pages: DataFrame, *, book: str | Column = "url", page: str | Column = "page_id", html: str = "html") -> DataFrame:
    """``book_title, pos, level, title, start_page``: headings h1 to h3 as contents."""
    lines = html_lines(pages, book=book, page=page, html=html)
    level = F.when(F.col("size") == 18.0, 1).when(F.col("size") == 15.0, 2).when(F.col("size") == 13.0, 3)
    return lines.withColumn("level", level).where("level is not null").select(
        "book_title", F.col("line_no").cast("int").alias("pos"), "level", F.col("text").alias("title"), F.col("page_number").alias("start_page")
    )


def document_lines(spark: SparkSession, path: str, parser: Callable[[bytes], list[tuple[int, list[tuple[str, float]]]]]) -> DataFrame:
    """Lines of binary files (PDF and others) by a parser that the caller brings.

    ``parser`` gives pages from 1 as ``(page, [(line, size of its first span)])``. Lines
    are stripped, blank ones dropped, sizes rounded to one decimal. The book is the file's name.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                rows = [(page, t.strip(), round(float(size), 1)) for page, lines in parser(content) for t, size in lines if t.strip()]
                name = p.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(rows)), pa.array(range(len(rows)), pa.int64()), pa.array([r[0] for r in rows], pa.int32()),
                        pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()),
                    ],
                    names=["book_title", "line_no", "page_number", "text", "size"],
                )

    return files.mapInArrow(parse, _LINES)


def library_json(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """Chunks of a library kept as a JSON array, flat; a file's order is not kept by Spark, so none is made up.

    An array is read by one task; ``lines`` reads files of an object a line, in many.
    """
    return spark.read.schema(CHUNK_WIRE).json(path, multiLine=not lines).select("chunk_id", "text", "metadata.*")


def eval_set(spark: SparkSession, path: str | None) -> DataFrame:
    """An evaluation set from JSON; without a path the built-in example."""
    if path:
        return spark.read.schema(EVAL_SET).json(path, multiLine=True)
    rows = [(f"q{i}", q, a, c) for i, (q, a, c) in enumerate(_EXAMPLE, 1)]
    return spark.createDataFrame(rows, EVAL_SET)


#: Five items about the chunks of an imaginary book, to try the metrics on.
_EXAMPLE = [
    ("What does an index trade for faster reads?", "Space and slower writes.", "example_book_p1_g0_c0"),
    ("When is a scan cheaper than an index?", "When most rows qualify.", "example_book_p2_g1_c0"),
    ("What does a join key decide?", "Which rows meet in one task.", "example_book_p3_g2_c0"),
    ("Why are small tables broadcast?", "To spare the large side a shuffle.", "example_book_p4_g3_c0"),
    ("What is a skewed key?", "One that holds far more rows than others.", "example_book_p5_g4_c0"),
]


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A unit vector of hashed words: a stand-in where no encoder is at hand, of no quality."""
    words = F.split(F.lower(text), r"\s+")
    at = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(at, lambda a: a == i)).cast("double"))
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: (x / F.when(length > 0, length).otherwise(1.0)).cast("float"))


def encoded(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], *, text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """``rows`` with unit vectors of ``encoder``, which is given up to ``batch`` texts at once."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            texts, vectors = [t or "" for t in b.to_pylist()], []
            for i in range(0, len(texts), batch):
                for v in encoder(texts[i : i + batch]):
                    length = sum(x * x for x in v) ** 0.5 or 1.0
                    vectors.append([x / length for x in v])
            yield pa.array(vectors, pa.list_(pa.float32()))

    return rows.withColumn(out, encode.asNondeterministic()(F.col(text)))


def documents_as_chunks(documents: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Documents as a library: source is the book, language the chapter, doc_id page and position.

    Vectors are those of ``embeddings`` with the document's id; documents without one have null.
    """
    slug = F.replace(F.lower("source"), F.lit(" "), F.lit("_"))
    chunks = documents.select(
        F.concat(slug, F.lit("_p"), F.col("doc_id").cast("string"), F.lit("_g0_c0")).alias("chunk_id"), "text",
        F.col("source").alias("book_title"), F.col("lang").alias("chapter"), F.lit(UNKNOWN).alias("section"),
        F.col("doc_id").alias("page_number"), F.lit(0).alias("chunk_index_on_page"), F.col("doc_id").alias("corpus_pos"),
    )
    if embeddings is None:
        return chunks
    v = embeddings.select(F.col("vec_id").alias("corpus_pos"), "embedding")
    return chunks.join(v, "corpus_pos", "left")
