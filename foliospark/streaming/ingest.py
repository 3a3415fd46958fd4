"""Incremental ingest: every micro-batch of lines replaces the books it holds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, structure
from ..operators.store import Library


def chunks_of_lines(lines: DataFrame) -> DataFrame:
    """Lines to chunks: body size, heading levels, groups, split."""
    return chunking.build_chunks(structure.heading_groups(structure.heading_levels(lines)))


def start_ingest(lines: DataFrame, library: Library, checkpoint: str, *, build: Callable[[DataFrame], DataFrame] = chunks_of_lines, once: bool = True) -> StreamingQuery:
    """Write a stream of lines into a library; a batch that is replayed leaves the same table.

    A book must arrive whole in one micro-batch, as a file of its own does.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        library.upsert(build(batch))

    writer = lines.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
