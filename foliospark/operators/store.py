"""The library as one versioned table of chunks; embeddings are a column of it."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from .sizes import is_small

_NO_BOOK = "none"
#: Chunks of a file at most: the unit that statistics skip, and that a task is given of a large book.
FILE_ROWS = 10_000
#: Ids up to which a deletion sends them to all tasks; beyond, the texts of the library are shuffled.
DELETED = 1_000_000
#: A row of a version's list: a file of a book with what it holds. One row more, without a file, has the columns of all.
MANIFEST = "book_key string, written string, file string, n_rows long, first_page long, last_page long, chapters array<string>, schema string"


def book_key(title: Column | str) -> Column:
    """A title as a folder name: its MD5 after a letter; titles of any characters are told apart, none is a number."""
    return F.coalesce(F.concat(F.lit("b"), F.md5(X.col(title))), F.lit(_NO_BOOK))


class Library:
    """A table of chunks under a path whose versions are committed whole.

    Every change writes the books concerned into a folder of its own, by book, and then a
    new list of the files that hold the books, with their counts, pages and chapters. The
    list becomes the newest version by one rename, so a run that breaks off leaves the
    version before, and other books' files are not touched. A read opens the files that its
    version lists, however many versions there were. Titles are a column, folders are named
    by their hash. Readers keep the version they began with until :meth:`vacuum`.

    One writer at a time may commit. A second one is refused where a rename to a taken name
    fails in one step (HDFS); object stores and local files only check before they move, so
    there writers must take turns by other means.
    """

    #: Folders that hold what is written with the chunks, by ``written`` and ``book_key``.
    PARTS = ("data",)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        """The newest version; 0 where there is none."""
        names = [f.getPath().getName() for f in _list(self.spark, f"{self.path}/versions")]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        """``MANIFEST`` of a version or the newest: a row per file, and one of the columns."""
        version = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/v{version}") if version else self.spark.createDataFrame([], MANIFEST)

    def _listed(self, version: int | None = None) -> DataFrame:
        return self.manifest(version).where("file is not null")

    def _columns(self, version: int | None = None) -> T.StructType | None:
        row = self.manifest(version).where("file is null").first()
        return T.StructType.fromJson(json.loads(row["schema"])) if row else None

    def _open(self, files: DataFrame, columns: T.StructType) -> DataFrame:
        paths = [f"{self.path}/data/written={r['written']}/book_key={r['book_key']}/{r['file']}" for r in files.select("book_key", "written", "file").collect()]  # a row per file
        return self.spark.read.schema(columns).parquet(*paths) if paths else self.spark.createDataFrame([], columns)

    def read(self, book: str | None = None, *, version: int | None = None, pages: tuple[int, int] | None = None, chapter: str | None = None) -> DataFrame:
        """All chunks, or those of a book, a range of pages (both ends included) or a chapter, of a version or the newest.

        Only files are opened that may hold such chunks by their statistics. A library that
        was never written to is an error, as its columns are not known.
        """
        version = self.version() if version is None else version
        columns = self._columns(version)
        if columns is None:
            raise ValueError(f"there is no library at {self.path}")
        files = self._listed(version)
        if book:
            files = files.where(F.col("book_key") == book_key(F.lit(book)))
        if pages:
            files = files.where((F.col("first_page") <= pages[1]) & (F.col("last_page") >= pages[0]))
        if chapter:
            files = files.where(F.array_contains("chapters", chapter))
        rows = self._open(files, columns)
        if pages:
            rows = rows.where(F.col("page_number").between(*pages))
        return rows.where(F.col("chapter") == chapter) if chapter else rows

    def changes(self, old: int, new: int | None = None) -> DataFrame:
        """The rows between two versions: their columns and ``change``, ``insert`` or ``delete``.

        Books whose files are the same in both are not opened. Rows that a rewritten book
        has kept are in neither; a row that changed is deleted and inserted.
        """
        new = self.version() if new is None else new
        columns = self._columns(max(old, new))
        if columns is None:
            raise ValueError(f"there is no library at {self.path}")
        gone, come = self.changed(old, new)
        before, after = (self._open(f, columns) for f in (gone, come))
        return before.exceptAll(after).withColumn("change", F.lit("delete")).unionByName(after.exceptAll(before).withColumn("change", F.lit("insert")))

    def changed(self, old: int, new: int) -> tuple[DataFrame, DataFrame]:
        """The manifest's files that only the old version has, and those that only the new one has."""
        a, b = self._listed(old), self._listed(new)
        own = ["book_key", "written"]
        return a.join(b.select(*own).distinct(), own, "left_anti").select(*a.columns), b.join(a.select(*own).distinct(), own, "left_anti").select(*b.columns)

    def _write(self, chunks: DataFrame, dealt: bool = False) -> DataFrame:
        """Write chunks by book; returns their rows of a manifest. ``dealt`` ones lie by book already and stay in their tasks."""
        with small_tasks(self.spark):
            return self._written(chunks, dealt)

    def _written(self, chunks: DataFrame, dealt: bool) -> DataFrame:
        written = f"w{uuid.uuid4().hex}"
        keyed = chunks.withColumn("book_key", book_key("book_title"))
        # a large book is written by several tasks, its positions side by side; a small one by one task
        place = [F.floor(F.col("corpus_pos") / FILE_ROWS)] if "corpus_pos" in chunks.columns else []
        keyed = keyed if dealt else keyed.repartition("book_key", *place)
        keyed.write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("book_key").parquet(f"{self.path}/data/written={written}")
        # as rows are partitioned the key is no column of the files, and nothing is read where no row was written
        rows = self.spark.read.schema(keyed.schema).parquet(f"{self.path}/data/written={written}")
        self._index(written, rows)
        page = F.col("page_number").cast("long") if "page_number" in chunks.columns else F.lit(None).cast("long")
        chapter = F.col("chapter") if "chapter" in chunks.columns else F.lit(None).cast("string")
        return rows.select("book_key", F.col("_metadata.file_name").alias("file"), page.alias("page"), chapter.alias("chapter")).groupBy("book_key", "file").agg(
            F.lit(written).alias("written"), F.count("*").alias("n_rows"), F.min("page").alias("first_page"), F.max("page").alias("last_page"),
            F.array_sort(F.collect_set("chapter")).alias("chapters"), F.lit(None).cast("string").alias("schema"),
        ).select(*self._names())

    def _index(self, written: str, rows: DataFrame) -> None:
        """What a library with indexes stores with the chunks of a write, which ``rows`` reads with their ``book_key``."""

    @staticmethod
    def _names() -> list[str]:
        return ["book_key", "written", "file", "n_rows", "first_page", "last_page", "chapters", "schema"]

    def _commit(self, listed: DataFrame, columns: T.StructType | None = None, removed: DataFrame | None = None) -> None:
        before = self.version()
        version = before + 1
        columns = columns or self._columns(before)
        aside = f"{self.path}/pending-{uuid.uuid4().hex}"
        head = self.spark.createDataFrame([(None, None, None, 0, None, None, None, columns.json())] if columns else [], MANIFEST)
        listed.select(*self._names()).unionByName(head).coalesce(1).write.parquet(aside)  # a row per file
        with small_tasks(self.spark):
            self._before_commit(before, self.spark.read.schema(MANIFEST).parquet(aside).where("file is not null"), removed)
        to = f"{self.path}/versions/v{version}"
        source, system = _path(self.spark, aside)
        target, _ = _path(self.spark, to)
        system.mkdirs(target.getParent())
        if system.exists(target) or not system.rename(source, target):
            _remove(self.spark, aside)
            raise RuntimeError(f"another writer has committed version {version}")

    def _before_commit(self, before: int, listed: DataFrame, removed: DataFrame | None = None) -> None:
        """What a library with indexes stores for the version after ``before``, whose files ``listed`` has; ``removed`` are the chunks that it lacks, if it has no new ones."""

    def upsert(self, chunks: DataFrame) -> None:
        """Replace the books that ``chunks`` holds; no chunks change nothing."""
        new = self._write(chunks)
        self._commit(self._listed().join(new.select("book_key").distinct(), "book_key", "left_anti").select(*self._names()).unionByName(new), self._same(chunks))

    def _same(self, chunks: DataFrame) -> T.StructType:
        """The columns of all chunks: files of a library are read as one table."""
        old, new = self._columns(), chunks.schema
        if old is not None and self._listed().limit(1).count() and [(f.name, f.dataType) for f in old] != [(f.name, f.dataType) for f in new]:
            raise ValueError(f"the library's columns are {old.simpleString()}, not {new.simpleString()}")
        return new

    def replace(self, books: DataFrame, chunks: DataFrame) -> None:
        """Replace the books of ``book_title`` by ``chunks``, which may be read from this library; books without any go."""
        new = self._write(chunks)
        gone = books.select(book_key("book_title").alias("book_key")).unionByName(new.select("book_key")).distinct()
        self._commit(self._listed().join(gone, "book_key", "left_anti").select(*self._names()).unionByName(new), self._same(chunks))

    def rebuild(self, chunks: DataFrame) -> None:
        """Replace everything; ``chunks`` may be read from this library."""
        self._commit(self._write(chunks), chunks.schema)

    def delete_ids(self, ids: DataFrame) -> None:
        """Delete chunks by ``chunk_id``; only books that lose chunks are rewritten."""
        version = self.version()
        columns, files = self._columns(version), self._listed(version)
        rows = self._open(files, columns)
        ids = ids.select("chunk_id").distinct()
        few = is_small(ids, DELETED)
        ids = F.broadcast(ids) if few else ids
        hit = rows.join(ids, "chunk_id", "left_semi").select(book_key("book_title").alias("book_key")).distinct()
        hit = self.spark.createDataFrame(hit.collect(), "book_key string")  # a row per book that loses chunks
        rows = self._open(files.join(hit, "book_key", "left_semi"), columns)
        # where ids are few, no text is shuffled
        new = self._write(rows.join(ids, "chunk_id", "left_anti").select(*columns.names), dealt=few)
        removed = rows.join(ids, "chunk_id", "left_semi")
        self._commit(files.join(hit, "book_key", "left_anti").select(*self._names()).unionByName(new), columns, removed)

    def delete_book(self, book: str) -> None:
        """Drop a book."""
        self._commit(self._listed().where(F.col("book_key") != book_key(F.lit(book))))

    def vacuum(self) -> None:
        """Delete files and lists that the newest version does not need; older versions cannot be read any more."""
        version = self.version()
        needed = {(f"written={r['written']}", f"book_key={r['book_key']}") for r in self._listed(version).select("written", "book_key").distinct().collect()}  # a row per book
        name = lambda f: f.getPath().getName()
        for part in self.PARTS:
            for write in _list(self.spark, f"{self.path}/{part}"):
                if not name(write).startswith("written="):
                    continue
                for book in _list(self.spark, write.getPath().toString()):
                    if name(book).startswith("book_key=") and (name(write), name(book)) not in needed:
                        _remove(self.spark, book.getPath().toString())
                if name(write) not in {w for w, _ in needed}:
                    _remove(self.spark, write.getPath().toString())
        for f in _list(self.spark, f"{self.path}/versions"):
            if name(f) != f"v{version}":
                _remove(self.spark, f.getPath().toString())

    def reset(self) -> None:
        _remove(self.spark, self.path)


def _path(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all machines share, under ``spark.checkpoint.dir``; a local one only where one machine runs all."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="foliospark-")
    return f"{root.rstrip('/')}/foliospark/{name}-{uuid.uuid4().hex}"


#: What a task reads of files, and what opening one counts as. By Spark's own bounds (128 and 4 MB) the files of many
#: small books weigh more than a large book's, which then come to one task.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": "32m", "spark.sql.files.openCostInBytes": "64k"}


@contextmanager
def small_tasks(spark: SparkSession) -> Iterator[None]:
    """Files are read by ``TASK_BYTES``, unless the session has bounds of its own."""
    own = spark.conf.getAll
    new = [k for k in TASK_BYTES if k not in own]
    for k in new:
        spark.conf.set(k, TASK_BYTES[k])
    try:
        yield
    finally:
        for k in new:
            spark.conf.unset(k)


#: Options of a write of rows of megabytes: a row group each, as a writer holds a group, and a reader decodes one, at once.
LONG_ROWS = {"parquet.block.row.count.limit": "1"}


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to a scratch folder and read back, so that jobs that read it do not compute it again."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)


def _list(spark: SparkSession, path: str) -> list:
    p, system = _path(spark, path)
    return list(system.listStatus(p)) if system.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _path(spark, path)
    return system.exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    p, system = _path(spark, path)
    system.delete(p, True)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """The library after replacing the books of ``new``; new rows come after all others."""
    rest = old.join(new.select("book_title").distinct(), "book_title", "left_anti").select(*old.columns)
    last = rest.agg(F.coalesce(F.max("corpus_pos"), F.lit(-1)).alias("_last"))
    moved = new.crossJoin(F.broadcast(last)).withColumn("corpus_pos", F.col("corpus_pos") + F.col("_last") + 1)  # one row
    return rest.unionByName(moved.select(*old.columns))


def without_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def stats(chunks: DataFrame) -> DataFrame:
    """One row: ``n_chunks, n_books``."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.countDistinct("book_title").alias("n_books"))


def books(chunks: DataFrame) -> DataFrame:
    return chunks.select("book_title").distinct().orderBy("book_title")


def chapter_cache_key(chapters: DataFrame) -> DataFrame:
    """``book_title, cache_key``: MD5 of book and sorted chapter titles, pipe-joined."""
    titles = F.array_sort(F.collect_list("chapter"))
    return chapters.groupBy("book_title").agg(F.md5(F.concat_ws("|", F.col("book_title"), titles)).alias("cache_key"))


def batch_keys(batches: DataFrame) -> DataFrame:
    """``book_title, batch_id, cache_key``: MD5 of a batch's sorted chunk ids, pipe-joined."""
    return batches.groupBy("book_title", "batch_id").agg(X.list_key(F.collect_list("chunk_id")).alias("cache_key"))


def pending(keys: DataFrame, cache: DataFrame) -> DataFrame:
    """Batches whose key the cache does not have."""
    return keys.join(cache.select("cache_key"), "cache_key", "left_anti")
