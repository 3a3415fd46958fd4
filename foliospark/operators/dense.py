"""Exact nearest chunks of many query vectors, in blocks of queries."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import CANDIDATE_DEPTH
from ..shipping import ship
from .bm25 import passes, with_filters

#: Numbers that a block of query vectors holds at most: what is broadcast at once (16 MB).
BLOCK_NUMBERS = 2_000_000
#: Chunk vectors that are compared with a block in one piece.
ROWS = 4096
#: Queries whose scores with such a piece are held at once (8 MB), and whose best are handed over at once.
HELD_QUERIES = 256


#: Place of a chunk without a position: before all others.
_NOWHERE = -(1 << 63)


def query_blocks(queries: DataFrame, block_numbers: int = BLOCK_NUMBERS) -> Iterator[list]:
    """The queries' ids, vectors and filters, streamed to the driver in bounded blocks."""
    block, n = [], 0
    for r in queries.toLocalIterator():
        block.append((r["query_id"], np.array(r["embedding"], np.float64), r["book_filter"], r["chapter_filter"]))
        n += len(r["embedding"])
        if n >= block_numbers:
            yield block
            block, n = [], 0
    if block:
        yield block


def top_k(
    chunks: DataFrame, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, digits: int = 6, block_numbers: int = BLOCK_NUMBERS,
    probes: Callable[[list], list[np.ndarray]] | None = None,
) -> DataFrame:
    """``query_id, chunk_id, rank0, score``: the chunks nearest by dot product.

    ``chunks`` has ``chunk_id, corpus_pos, book_title, chapter, embedding``, ``queries``
    has ``query_id, embedding`` and filters if any, which act before the cut. Vectors are
    taken as they come (normalise them for cosine); null vectors and vectors of another
    length than a query's are not compared with it. Every task keeps the best ``depth`` of
    its rows for each query, so the shuffle holds tasks * queries * depth rows, however
    many chunks there are. Ordered by score rounded to ``digits``, then corpus position
    (none comes first), then chunk id. Ids of queries may be of any type.
    Queries beyond ``block_numbers`` are searched block by block, each block's result being
    checkpointed (in ``spark.checkpoint.dir``) before the next is sent out.

    With ``probes``, ``chunks`` has a column ``list`` and a query is compared with the rows
    of its lists alone, which the function gives for a block's vectors; other lists are
    filtered out, so they are not read where they are partitions of a stored table.
    """
    spark = chunks.sparkSession
    ship(spark)
    q = with_filters(queries).where("embedding is not null").select("query_id", "embedding", "book_filter", "chapter_filter")
    kind = q.schema["query_id"].dataType.simpleString()
    place = F.coalesce(F.col("corpus_pos").cast("long"), F.lit(_NOWHERE)).alias("corpus_pos")
    rows = chunks.where("embedding is not null").select("chunk_id", place, "book_title", "chapter", "embedding", *["list"] * (probes is not None))
    w = Window.partitionBy("number").orderBy(F.desc("score"), "corpus_pos", "chunk_id")
    blocks, out = query_blocks(q, block_numbers), None
    block, following = next(blocks, None), next(blocks, None)
    several = following is not None
    while block is not None:
        lists = probes([r[1] for r in block]) if probes else None
        shared = spark.sparkContext.broadcast((block, lists))
        near = rows.where(F.col("list").isin(sorted({int(i) for own in lists for i in own}))) if probes else rows
        part = near.mapInArrow(_best(shared, depth, digits), "number long, score double, corpus_pos long, chunk_id string")
        part = part.withColumn("rank0", F.row_number().over(w) - 1).where(F.col("rank0") < depth)
        ids = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(block)], f"number long, query_id {kind}"))  # of one block
        part = part.join(ids, "number").select("query_id", "chunk_id", "rank0", "score")
        if several:
            part = part.checkpoint()
            shared.unpersist()
        out = part if out is None else out.unionByName(part)
        block, following = following, next(blocks, None)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, rank0 int, score double")
    return out


def _best(shared, depth: int, digits: int):
    names = ["number", "score", "corpus_pos", "chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lists = shared.value
        everyone, by_list = _by_length(block, range(len(block))), {}
        if lists is not None:
            for i, own in enumerate(lists):
                for n in own:
                    by_list.setdefault(int(n), []).append(i)
            by_list = {n: _by_length(block, own) for n, own in by_list.items()}
        kept: dict[int, list] = {}
        for b in batches:
            parts = [(everyone, b)]
            if lists is not None:
                number = b.column("list").to_numpy(zero_copy_only=False)
                parts = [(by_list[n], b.take(pa.array(np.flatnonzero(number == n)))) for n in np.unique(number).tolist() if n in by_list]
            for asked, some in parts:
                for i in range(0, some.num_rows, ROWS):
                    _keep_best(kept, asked, some.slice(i, ROWS), depth, digits)
        while kept:
            rows = [(i, -s, p, c) for i in list(itertools.islice(kept, HELD_QUERIES)) for s, p, c in kept.pop(i)]
            if rows:  # no row of the task may pass these queries' filters
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.float64(), pa.int64(), pa.string()))], names=names)

    return run


def _by_length(block: list, own: Iterable[int]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Some of a block's queries by the length of their vectors; the block itself under -1."""
    by: dict[int, list[int]] = {}
    for i in own:
        by.setdefault(len(block[i][1]), []).append(i)
    return {n: (ids, np.array([block[i][1] for i in ids], np.float64)) for n, ids in by.items()} | {-1: (block, None)}


def _keep_best(kept: dict, asked: dict, rows: pa.RecordBatch, depth: int, digits: int) -> None:
    """Merge the best ``depth`` of some rows into each query's list; filters are compared as whole columns."""
    block = asked[-1][0]
    lengths = pc.list_value_length(rows.column("embedding")).to_numpy(zero_copy_only=False)
    pos = rows.column("corpus_pos").to_numpy(zero_copy_only=False)
    ids = rows.column("chunk_id")
    named = {}
    for c in ("book_title", "chapter"):
        coded = rows.column(c).dictionary_encode()
        number = {v: i for i, v in enumerate(coded.dictionary.to_pylist())}
        named[c] = number, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    masks: dict[tuple, np.ndarray] = {}
    for n, (own, matrix) in asked.items():
        at = np.flatnonzero(lengths == n)
        if n < 0 or not len(at):
            continue
        v = rows.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)
        for first in range(0, len(own), HELD_QUERIES):
            score = matrix[first : first + HELD_QUERIES] @ v.T
            np.round(score, digits, out=score)
            for j, i in enumerate(own[first : first + HELD_QUERIES]):
                some = np.arange(len(at))
                for column, wanted in zip(("book_title", "chapter"), block[i][2:4]):
                    if wanted is not None:
                        if (column, wanted) not in masks:
                            number, codes = named[column]
                            masks[column, wanted] = codes == number.get(wanted, -2)
                        some = some[masks[column, wanted][at[some]]]
                if len(some) > depth:  # rows below the cut's score cannot be among the best; ties stay
                    s = score[j, some]
                    some = some[s >= np.partition(s, len(s) - depth)[len(s) - depth]]
                order = some[np.lexsort((pos[at[some]], -score[j, some]))[:depth]]
                new = [(-score[j, k], int(pos[at[k]]), ids[int(at[k])].as_py()) for k in order]
                kept[i] = sorted(kept.get(i, []) + new)[:depth]


__all__ = ["top_k", "query_blocks", "passes"]
