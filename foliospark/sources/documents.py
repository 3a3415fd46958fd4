"""Lines of documents by a parser of the caller's, as a data source for batches and streams.

Files are split into ranges of pages, each a task's; a filter on ``page_number`` reaches the
parser, which then parses these pages alone. A stream takes files as they come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..shipping import ship

SCHEMA = "path string, book_title string, line_no long, page_number int, text string, size double"
#: Bytes from which a file is split, and pages of a part.
SPLIT_BYTES, PART_PAGES = 32 << 20, 200
#: Numbers of lines that a page has room for in ``line_no``.
PAGE_LINES = 1 << 20
_LAST = (1 << 31) - 1

#: What a parser gives for pages ``first`` to ``last`` of a file's bytes, both included: ``(page, [(line, size)])``.
Parser = Callable[[bytes, int, int], list[tuple[int, list[tuple[str, float]]]]]


class _Part(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))


def _files(folder: str) -> list[tuple[int, str, int]]:
    """``(time, path, bytes)`` of a folder's files, or of one file; hidden names and marks of a write are passed over."""
    system, root = fs.FileSystem.from_uri(folder)
    info = system.get_file_info(root)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size or 0) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def _rows(folder: str, part: _Part, parser: Parser) -> Iterator[pa.RecordBatch]:
    path, first, last = part.value
    system, _ = fs.FileSystem.from_uri(folder)
    with system.open_input_stream(path) as f:
        content = f.read()
    book = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    out = [
        (path, book, page * PAGE_LINES + i, page, text.strip(), round(float(size), 1))
        for page, lines in parser(content, first, last) if first <= page <= last for i, (text, size) in enumerate(lines) if text.strip()
    ]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], names=[c.split()[0] for c in SCHEMA.split(", ")])


class _Reader(DataSourceReader):
    def __init__(self, folder: str, parser: Parser, count: Callable[[bytes], int] | None):
        self.folder, self.parser, self.count, self.first, self.last, self.only = folder, parser, count, 1, _LAST, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can of conditions on the page, and gives back the others."""
        for f in filters:
            if getattr(f, "attribute", None) != ("page_number",):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.last = max(self.first, f.value), min(self.last, f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                if isinstance(f, In):
                    pages = [v for v in f.value if v is not None]
                    self.first, self.last = max(self.first, min(pages, default=1)), min(self.last, max(pages, default=0))
                yield f

    def partitions(self) -> list[_Part]:
        system, _ = fs.FileSystem.from_uri(self.folder)
        out = []
        for _, path, size in _files(self.folder):
            if self.count is None or size < SPLIT_BYTES:
                out.append(_Part(path, self.first, self.last))
                continue
            with system.open_input_stream(path) as f:
                n = min(self.last, self.count(f.read()))
            out += [_Part(path, a, min(n, a + PART_PAGES - 1)) for a in range(self.first, n + 1, PART_PAGES)]
        return [p for p in out if p.value[1] <= p.value[2]] or [_Part("", 1, 0)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if partition.value[0]:
            yield from _rows(self.folder, partition, self.parser)


class _Stream(DataSourceStreamReader):
    """Files in the order of their time, then their path; a file that comes with an earlier time than one seen is not taken."""

    def __init__(self, folder: str, parser: Parser):
        self.folder, self.parser = folder, parser

    def initialOffset(self) -> dict:
        return {"time": "-1", "path": ""}

    def latestOffset(self) -> dict:
        found = _files(self.folder)
        return {"time": str(found[-1][0]), "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        place = lambda o: (int(o["time"]), o["path"])
        return [_Part(p, 1, _LAST) for t, p, _ in _files(self.folder) if place(start) < (t, p) <= place(end)]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        yield from _rows(self.folder, partition, self.parser)


def register(spark: SparkSession, parser: Parser, *, name: str = "documents", count: Callable[[bytes], int] | None = None) -> None:
    """Make ``spark.read.format(name).load(folder)``, and ``readStream``, give the lines of a folder's files: ``SCHEMA``.

    Lines are stripped, blank ones dropped, sizes rounded to one decimal; the book is the
    file's name. ``line_no`` ascends within a book and does not depend on which pages are
    read. With ``count``, the number of a file's pages, files of ``SPLIT_BYTES`` and more are
    read in parts of ``PART_PAGES`` pages. Turns filter push-down for Python sources on in
    the session.
    """
    ship(spark)

    class Documents(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> _Reader:
            return _Reader(self.options["path"], parser, count)

        def streamReader(self, schema) -> _Stream:
            return _Stream(self.options["path"], parser)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Documents)


