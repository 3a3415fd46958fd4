"""BM25 over chunks for many queries at once.

Statistics (documents, lengths, document frequencies) are those of the whole corpus;
filters act after scoring and before the cut. Texts are read once, into stored segments of
postings with block maxima (:mod:`.postings`); all else reads these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import CANDIDATE_DEPTH
from . import postings
from .store import dropped, stored


def idf(chunks: DataFrame) -> DataFrame:
    """``term, df, idf`` of the chunks' vocabulary, stored: negative values become a quarter of the mean over it."""
    index = postings.index_chunks(chunks)
    out = stored(postings.weighted(postings.frequencies(index), postings.totals(index).first()["n_docs"]), "idf")
    dropped(index)
    return out


def with_filters(queries: DataFrame) -> DataFrame:
    """``queries`` with ``book_filter`` and ``chapter_filter``; missing or empty ones are null (no filter)."""
    for c in ("book_filter", "chapter_filter"):
        queries = queries.withColumn(c, F.nullif(F.col(c), F.lit("")) if c in queries.columns else F.lit(None).cast("string"))
    return queries


def passes(book: str = "book_title", chapter: str = "chapter") -> F.Column:
    """The row satisfies its query's filters; a null filter passes all."""
    one = lambda f, c: F.col(f).isNull() | F.coalesce(F.col(f) == F.col(c), F.lit(False))
    return one("book_filter", book) & one("chapter_filter", chapter)


def top_k(chunks: DataFrame, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, drop_zero: bool = False, digits: int = 6) -> DataFrame:
    """``query_id, chunk_id, rank0, score``: the best chunks of each query; see :func:`postings.top_k`.

    Queries that fewer than ``depth`` chunks match are filled with the first chunks of
    score zero, unless ``drop_zero``; queries without a chunk that passes their filters
    give no rows. The index lasts for the call; a library keeps its own.
    """
    q = with_filters(queries).select("query_id", "question", "book_filter", "chapter_filter")
    index = postings.index_chunks(chunks)
    out = postings.top_k(index, q, depth=depth, drop_zero=drop_zero, digits=digits)
    dropped(index)
    return out
