"""Splitting groups into overlapping chunks, and chunk identity."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import CHUNK_OVERLAP, CHUNK_SIZE
from ..shipping import ship

SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters that share up to ``overlap`` with the one before.

    The text is cut at the first separator that it holds, each piece keeping the separator
    before it; pieces are packed while they fit; a piece that does not fit by itself is
    cut at the next separator. Chunks are stripped, blank ones dropped.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, rest = separators[at], separators[at + 1 :]
    if mark:
        head, *tail = text.split(mark)
        pieces = [p for p in [head, *[mark + t for t in tail]] if p]
    else:
        pieces = list(text)
    out: list[str] = []
    waiting: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            waiting.append(piece)
            continue
        out += _pack(waiting, size, overlap)
        waiting = []
        out += split_text(piece, size, overlap, rest) if rest else [piece]
    return out + _pack(waiting, size, overlap)


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, first, total = [], 0, 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]))
            while first < i and (total > overlap or total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    if first < len(pieces):
        out.append("".join(pieces[first:]))
    return [s for c in out if (s := c.strip())]


def split_groups(groups: DataFrame, *, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """``groups`` exploded into ``sub_index, chunk_text``; groups of no text give no chunks."""

    ship(groups.sparkSession)

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([split_text(t, size, overlap) if t else [] for t in batch.to_pylist()], pa.list_(pa.string()))

    return groups.select("*", F.posexplode(split(F.col(text))).alias("sub_index", "chunk_text"))


def build_chunks(groups: DataFrame) -> DataFrame:
    """Chunks of heading groups: ids, lineage and ``corpus_pos`` in book and reading order."""
    split = split_groups(groups)
    order = Window.partitionBy("book_title").orderBy("group_index", "sub_index")
    return split.select(
        X.chunk_id("book_title", "page_number", "group_index", "sub_index").alias("chunk_id"),
        F.col("chunk_text").alias("text"), "book_title", "chapter", "section", "page_number",
        F.col("sub_index").alias("chunk_index_on_page"),
        (F.row_number().over(order) - 1).cast("long").alias("corpus_pos"),
    )


def to_wire(chunks: DataFrame) -> DataFrame:
    """Flat chunks with their lineage nested in ``metadata``."""
    return chunks.select(
        "chunk_id", "text", F.struct("book_title", "chapter", "section", "page_number", "chunk_index_on_page").alias("metadata")
    )


def from_wire(wire: DataFrame) -> DataFrame:
    return wire.select("chunk_id", "text", "metadata.*")


def validated(rows: DataFrame) -> DataFrame:
    """``rows`` with ``valid`` and ``reason``, types coerced where they can be.

    Required: chunk_id, text, book_title, and page_number and chunk_index_on_page as
    whole numbers. A missing chapter or section column is "Unknown"; a null in it stays.
    """
    for c in ("chapter", "section"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit("Unknown"))
    page, index = F.expr("try_cast(page_number as int)"), F.expr("try_cast(chunk_index_on_page as int)")
    reason = (
        F.when(F.col("chunk_id").isNull(), "chunk_id")
        .when(F.col("text").isNull(), "text")
        .when(F.col("book_title").isNull(), "book_title")
        .when(page.isNull(), "page_number")
        .when(index.isNull(), "chunk_index_on_page")
    )
    return rows.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).withColumn("page_number", page).withColumn("chunk_index_on_page", index)


def require_valid(rows: DataFrame) -> DataFrame:
    """Valid rows; reading an invalid one raises."""
    checked = validated(rows)
    stop = F.raise_error(F.concat(F.lit("invalid chunk: "), F.col("reason")))
    return checked.where(F.when(F.col("valid"), F.lit(True)).otherwise(stop.cast("boolean"))).drop("valid", "reason")


def id_collisions(chunks: DataFrame) -> DataFrame:
    """``chunk_id, n_books, n``: ids that more than one chunk has (titles that differ by case or spaces)."""
    return chunks.groupBy("chunk_id").agg(F.countDistinct("book_title").alias("n_books"), F.count("*").alias("n")).where("n > 1")
