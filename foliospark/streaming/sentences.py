"""Sentences from pieces of text, in batch and in Structured Streaming.

A sentence ends at ``.``, ``!`` or ``?`` before white space or the end of what has come
so far. An end that looks like a page mark, "e.g.", "i.e." or a bare number is passed
over once; if the next end does not hold either, the text waits for more. What is left
when the stream ends is a sentence if it is not blank.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import NOT_AN_END
from ..shipping import ship

_END = re.compile(r"[.!?](?:\s|$)")
_NOT_AN_END = re.compile(NOT_AN_END)


def _taken(buffer: str) -> tuple[str, str] | None:
    """The first sentence of the buffer and the rest, if one is complete."""
    ends = _END.finditer(buffer)
    first = next(ends, None)
    # the look-ahead starts after the first end, so an end right behind it still counts
    second = first and _END.search(buffer, first.end())
    for end in (first, second):
        if end is None:
            return None
        candidate = buffer[: end.end()].strip()
        if not _NOT_AN_END.search(candidate):
            return candidate, buffer[end.end() :]
    return None


def feed(buffer: str, piece: str) -> tuple[list[str], str]:
    """Sentences completed by a piece, and what remains in the buffer."""
    out, buffer = [], buffer + piece
    while (taken := _taken(buffer)) is not None:
        sentence, buffer = taken
        out.append(sentence)
    return out, buffer


def segment(pieces: list[str]) -> list[str]:
    """All sentences of pieces in order, the remainder included."""
    out, buffer = [], ""
    for piece in pieces:
        new, buffer = feed(buffer, piece)
        out += new
    return [*out, buffer.strip()] if buffer.strip() else out


def sentences(rows: DataFrame, *, text: str = "text") -> DataFrame:
    """``rows`` exploded into ``sentence_no, sentence``; null and blank texts give none."""
    ship(rows.sparkSession)

    @F.arrow_udf("array<string>")
    def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([segment([t]) if t else [] for t in batch.to_pylist()], pa.list_(pa.string()))

    return rows.select("*", F.posexplode(split(F.col(text))).alias("sentence_no", "sentence"))


class _Segmenter(StatefulProcessor):
    """Holds a stream's buffer and next expected piece, and, in a map of their own, pieces that came too early."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "buffer string, next int, emitted int, ended boolean, timer long")
        self.early = handle.getMapState("early", "seq int", "piece string, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        buffer, expected, emitted, ended, timer = self.state.get() if self.state.exists() else ("", 0, 0, False, -1)
        now = {}
        for df in rows:
            for seq, piece, last in zip(df["seq"], df["piece"], df["is_last"]):
                if int(seq) >= expected and not ended:  # a piece that came before is not taken again
                    now[int(seq)] = (piece or "", bool(last))
        out = []
        while not ended:
            if expected in now:
                piece, ended = now.pop(expected)
            elif self.early.containsKey((expected,)):
                piece, ended = self.early.getValue((expected,))
                self.early.removeKey((expected,))
            else:
                break
            new, buffer = feed(buffer, piece)
            out += new
            expected += 1
        if ended:  # what comes still is known to be late until the stream is forgotten
            out += [buffer.strip()] if buffer.strip() else []
            buffer = ""
            self.early.clear()
        else:
            for seq, value in now.items():
                self.early.updateValue((seq,), value)
        if self.idle_ms is not None:
            if timer >= 0:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        if ended and self.idle_ms is None:
            self.state.clear()
        else:
            self.state.update((buffer, expected, emitted + len(out), ended, timer))
        yield _numbered(key, emitted, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        buffer, _, emitted, _, _ = self.state.get() if self.state.exists() else ("", 0, 0, True, -1)
        self.state.clear()
        self.early.clear()
        yield _numbered(key, emitted, [buffer.strip()] if buffer.strip() else [])

    def close(self) -> None:
        pass


def _numbered(key, first: int, out: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"stream_id": [key[0]] * len(out), "sentence_no": range(first, first + len(out)), "sentence": pd.Series(out, dtype=object)})


def stream_sentences(pieces: DataFrame, *, idle_ms: int | None = None) -> DataFrame:
    """Sentences of a stream of ``stream_id long, seq int, piece string, is_last boolean``.

    Pieces of one stream may come in any order, also across batches: gaps are waited for,
    each early piece being written once. Pieces that come again are passed over. Without
    ``idle_ms`` a stream is forgotten at its last piece, and one that is left off is kept.
    With it a stream is forgotten when it has had no piece for so many milliseconds of
    processing time: one that was left off ends with what it holds up to its first gap, and
    pieces behind the gap are lost; until then pieces after the last are passed over. A
    piece that comes later still begins a new stream. Timers run in batches without data
    too, so under ``availableNow`` such a query only ends by itself if
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is off. Needs the RocksDB state store.
    """
    ship(pieces.sparkSession)
    return pieces.groupBy("stream_id").transformWithStateInPandas(
        statefulProcessor=_Segmenter(idle_ms), outputStructType="stream_id long, sentence_no int, sentence string",
        outputMode="Append", timeMode="None" if idle_ms is None else "ProcessingTime",
    )
