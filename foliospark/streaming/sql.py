"""Sentences of pieces as a table function in SQL.

    SELECT * FROM sentences_of(TABLE(pieces))

``pieces`` has ``stream_id`` (of any type), ``seq`` and ``piece``; other columns are not
read. The function asks for a partition by stream and an order by piece itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf

from ..shipping import ship
from .sentences import feed


class SentencesOf:
    """Feeds a stream's pieces, in order, to the segmenter; what is left at the end is a sentence if it is not blank."""

    def __init__(self):
        self.key, self.buffer, self.n = None, "", 0

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        kinds = {f.name.lower(): f.dataType for f in rows.dataType.fields} if rows.isTable else {}
        lacks = [c for c in ("stream_id", "seq", "piece") if c not in kinds]
        if lacks:
            raise ValueError(f"sentences_of needs a table with stream_id, seq and piece; there is no {', '.join(lacks)}")
        out = T.StructType().add("stream_id", kinds["stream_id"]).add("sentence_no", T.IntegerType()).add("sentence", T.StringType())
        return AnalyzeResult(
            schema=out, partitionBy=[PartitioningColumn("stream_id")], orderBy=[OrderingColumn("seq")],
            select=[SelectedColumn("stream_id"), SelectedColumn("seq"), SelectedColumn("piece")],
        )

    def _numbered(self, found: list[str]) -> Iterator[tuple]:
        for sentence in found:
            yield self.key, self.n, sentence
            self.n += 1

    def eval(self, row: T.Row) -> Iterator[tuple]:
        self.key = row["stream_id"]
        found, self.buffer = feed(self.buffer, row["piece"] or "")
        yield from self._numbered(found)

    def terminate(self) -> Iterator[tuple]:
        if self.buffer.strip():
            yield from self._numbered([self.buffer.strip()])


def register(spark: SparkSession, name: str = "sentences_of") -> None:
    """Make the function known to SQL under a name."""
    ship(spark)
    spark.udtf.register(name, udtf(SentencesOf))
