"""Two-level routing: a question to a book by distinctive words, then to a chapter by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vector import dot
from ..model import BOOK_MARGIN, CHAPTER_FLOOR, CHAPTER_MARGIN, LEGACY_MATTER, PROFILE_SIZE
from .sizes import broadcast_if_small, spread
from .store import chapter_cache_key


def book_profiles(chunks: DataFrame, *, top_n: int = PROFILE_SIZE) -> DataFrame:
    """``book_title, word, score, rank``: each book's most distinctive words.

    Score: (count / book total) / (corpus count / corpus total) * count. Ties go to the
    word that comes first in the book (words beyond a chunk's 16 millionth count as there).
    """
    words = spread(chunks.select("book_title", "corpus_pos", "text")).select("book_title", "corpus_pos", F.posexplode(X.word_tokens("text")).alias("at", "word"))
    # a place as one number: a minimum of structs would have to sort all words
    place = F.shiftleft(F.col("corpus_pos").cast("long"), 24) + F.least("at", F.lit((1 << 24) - 1))
    return profiles_of(words.groupBy("book_title", "word").agg(F.count("*").alias("n"), F.min(place).alias("first")), top_n=top_n)


def profiles_of(count: DataFrame, *, top_n: int = PROFILE_SIZE) -> DataFrame:
    """:func:`book_profiles` from counts ``book_title, word, n, first``, which are read four times."""
    book = count.groupBy("book_title").agg(F.sum("n").alias("book_total"))
    corpus = count.groupBy("word").agg(F.sum("n").alias("corpus_n"))
    total = book.agg(F.sum("book_total").alias("corpus_total"))
    score = (F.col("n") / F.col("book_total")) / (F.col("corpus_n") / F.col("corpus_total")) * F.col("n")
    scored = count.join(book, "book_title").join(corpus, "word").crossJoin(F.broadcast(total)).withColumn("score", score)
    w = Window.partitionBy("book_title").orderBy(F.desc(F.round("score", 9)), "first")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n).select("book_title", "word", "score", "rank")


def _margin(scored: DataFrame, name: str, tie: list[str]) -> DataFrame:
    """Per query the best, its score and the runner-up's (0 where there is none)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *tie)
    two = scored.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return two.groupBy("query_id").agg(
        F.max(F.when(F.col("rn") == 1, F.col(name))).alias(name),
        F.max(F.when(F.col("rn") == 1, F.col("score"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("rn") == 2, F.col("score"))), F.lit(0)).alias("second"),
    )


def route_books(queries: DataFrame, profiles: DataFrame, *, min_margin: float = BOOK_MARGIN) -> DataFrame:
    """``query_id, book_filter``: the book whose profile holds most of the question's words.

    Null (no filter) without usable words, without a hit, or if the best has less than
    ``min_margin`` times the runner-up's hits.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(X.word_tokens("question"))).alias("word"))
    # the questions' words are checked, not the profiles: these may still have to be computed
    hits = profiles.select("book_title", "word").join(broadcast_if_small(words), "word").groupBy("query_id", "book_title").agg(F.count("*").alias("score"))
    best = _margin(hits, "book_title", ["book_title"])
    sure = (F.col("second") == 0) | (F.col("top") >= min_margin * F.col("second"))
    chosen = best.select("query_id", F.when(sure, F.col("book_title")).alias("book_filter"))
    return queries.select("query_id").join(chosen, "query_id", "left")


def chapters_in_order(chunks: DataFrame) -> DataFrame:
    """``book_title, chapter, chapter_pos``: chapters by first page, the legacy sentinel left out."""
    first = chunks.where(F.col("chapter").isNotNull() & (F.col("chapter") != LEGACY_MATTER)).groupBy("book_title", "chapter").agg(
        F.min(F.struct("page_number", "corpus_pos")).alias("first")
    )
    w = Window.partitionBy("book_title").orderBy("first", "chapter")
    return first.withColumn("chapter_pos", F.row_number().over(w)).select("book_title", "chapter", "chapter_pos")


def chapter_vectors(chapters: DataFrame, encode) -> DataFrame:
    """``chapters`` with ``embedding``: what ``encode``, a Column function, makes of the titles."""
    return chapters.withColumn("embedding", encode(F.col("chapter")))


def cached_chapter_vectors(chapters: DataFrame, cache: DataFrame, encode, encoder: str) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``chapters`` that a cache has, and what it lacks, encoded: rows to add to it.

    The cache has ``cache_key, encoder, book_title, chapter, chapter_pos, embedding``; a
    book's key changes with its set of chapter titles, so a book that is relabelled is
    encoded again. The second result calls the encoder when it is read.
    """
    keyed = chapters.join(chapter_cache_key(chapters), "book_title").withColumn("encoder", F.lit(encoder))
    own = ["cache_key", "encoder"]
    known = cache.join(keyed.select(*own).distinct(), own, "left_semi")
    todo = keyed.join(cache.select(*own).distinct(), own, "left_anti")
    columns = ["cache_key", "encoder", "book_title", "chapter", "chapter_pos", "embedding"]
    return known.select(*columns), chapter_vectors(todo, encode).select(*columns)


def route_chapters(
    queries: DataFrame, vectors: DataFrame, *, min_margin: float = CHAPTER_MARGIN, min_similarity: float = CHAPTER_FLOOR, digits: int = 6
) -> DataFrame:
    """``query_id, chapter_filter``: the chapter nearest to the question within its book.

    ``queries`` has ``query_id, book_filter, embedding``; ``vectors`` has ``book_title,
    chapter, chapter_pos, embedding``. Null without a book, without chapters, below
    ``min_similarity``, or if the runner-up is positive and the best is less than
    ``min_margin`` times it. Ties go to the earlier chapter.
    """
    v = broadcast_if_small(vectors.select(F.col("book_title").alias("book_filter"), "chapter", "chapter_pos", F.col("embedding").alias("v")), 20_000)
    scored = queries.select("query_id", "book_filter", "embedding").join(v, "book_filter").withColumn(
        "score", F.round(dot(F.col("embedding"), F.col("v")), digits)
    )
    best = _margin(scored, "chapter", ["chapter_pos"])
    sure = (F.col("top") >= min_similarity) & ((F.col("second") <= 0) | (F.col("top") >= min_margin * F.col("second")))
    chosen = best.select("query_id", F.when(sure, F.col("chapter")).alias("chapter_filter"))
    return queries.select("query_id").join(chosen, "query_id", "left")


def route(queries: DataFrame, profiles: DataFrame, vectors: DataFrame, *, force_all: bool = False) -> DataFrame:
    """``queries`` with ``book_filter`` and ``chapter_filter``; ``force_all`` asks all books."""
    if force_all:
        none = F.lit(None).cast("string")
        return queries.withColumn("book_filter", none).withColumn("chapter_filter", none)
    booked = queries.join(route_books(queries, profiles), "query_id")
    return booked.join(route_chapters(booked, vectors), "query_id")
