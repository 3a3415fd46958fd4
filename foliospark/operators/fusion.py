"""Reciprocal-rank fusion, and chunks for ranked ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CANDIDATE_DEPTH, RRF_K, TOP_K
from . import bm25, dense


def fuse(dense_ranking: DataFrame, lexical_ranking: DataFrame, *, top_k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """``query_id, pos, chunk_id, rrf_score`` from two rankings ``query_id, chunk_id, rank0``.

    A list adds ``1 / (rrf_k + rank0)`` with ranks from 0. Ties go to the dense list's
    order, then to the lexical list's. ``pos`` counts from 1; scores have 5 decimals.
    """
    both = dense_ranking.select("query_id", "chunk_id", "rank0", F.lit(0).alias("source")).unionByName(
        lexical_ranking.select("query_id", "chunk_id", "rank0", F.lit(1).alias("source"))
    )
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.sum(F.lit(1.0) / (rrf_k + F.col("rank0"))).alias("rrf"),
        F.min(F.struct("source", "rank0")).alias("first"),
    )
    # equal sums may differ in the last bits by order of addition
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "first", "chunk_id")
    ranked = fused.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= top_k)
    return ranked.select("query_id", "pos", "chunk_id", F.round("rrf", 5).alias("rrf_score"))


def hydrate(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with their chunks' columns; ids that no chunk has are dropped after the cut.

    ``pos`` stays the place before the drop, ``found_pos`` counts the rows that remain.
    """
    found = results.join(chunks, "chunk_id")
    w = Window.partitionBy("query_id").orderBy("pos")
    return found.withColumn("found_pos", F.row_number().over(w))


def orphans(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """``query_id, n_skipped``: ranked ids that no chunk has."""
    return results.join(chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy("query_id").agg(F.count("*").alias("n_skipped"))


def search(
    chunks: DataFrame, queries: DataFrame, *, top_k: int = TOP_K, rrf_k: int = RRF_K, depth: int = CANDIDATE_DEPTH, index=None, exact: bool = True
) -> DataFrame:
    """Hybrid search of all queries: dense and lexical candidates, fused and cut.

    With ``index``, a library that keeps its indexes, candidates come from these, and
    ``chunks`` is not read; unless ``exact`` the dense ones from the nearest lists.
    """
    if index is None:
        return fuse(dense.top_k(chunks, queries, depth=depth), bm25.top_k(chunks, queries, depth=depth), top_k=top_k, rrf_k=rrf_k)
    return fuse(index.nearest(queries, depth=depth, exact=exact), index.search(queries, depth=depth), top_k=top_k, rrf_k=rrf_k)
