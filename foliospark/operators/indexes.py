"""A library that keeps its indexes: postings, word counts, vector lists and statistics.

With every write of books go their postings (:mod:`.postings`), their words' counts and
their vectors, in folders of the same write, so an index is live exactly where its book is.
What depends on the whole corpus (document frequencies, lengths, word totals) is kept as
signed deltas: a commit adds what its books hold and takes away what they held before, read
from the indexes of the files that the two versions do not share, or from the texts of
chunks that are deleted one by one. Its cost follows the change. Deltas are summed when they are read and compacted now and then.

Vectors lie in coarse lists, partitions of the stored table. Their centres are learned once,
from a sample, and again when asked for; a search reads the lists whose centres are nearest
to a query, or all of them if it is to be exact.

Every file has a Bloom filter of the trigrams of its lower-cased texts, so a search for a
substring opens the files that may hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import CANDIDATE_DEPTH, PROFILE_SIZE
from ..shipping import ship
from . import bm25, dense, postings, query, routing
from .sizes import BROADCAST_ROWS
from .store import LONG_ROWS, Library, _list, _path, _remove, book_key, dropped, exists, stored

#: Versions after which deltas are added up in a table of their own.
COMPACT = 8
#: Vectors from which the centres are learned, at about this many, and lists at most: more lists only cost more to choose from.
SAMPLE, LISTS = 50_000, 4096
_WORDS = "book_key string, word string, n long, first long"
_STATISTICS = "kind string, term string, value long"
_VECTORS = ["chunk_id", "corpus_pos", "book_title", "chapter", "embedding", "book_key"]
_TRIGRAMS = "book_key string, file string, bits binary"
#: Bits of a filter for each distinct trigram, and places that a trigram sets.
BITS, PLACES = 10, 4
#: Words of deleted chunks that are counted at once.
COUNTED = 100_000
#: Trigrams of texts that are gathered before they are made distinct, at least.
MERGED = 1 << 20


class ChunkIndex:
    """Postings and book profiles of a table of chunks, made by one cut of its texts, for the ``index`` of :func:`fusion.search`.

    ``chunks`` have ``chunk_id, corpus_pos, book_title, chapter, text``; ``vectors`` have an
    ``embedding`` too and no need of a text. ``release`` deletes it; what a search has found stays.
    """

    def __init__(self, chunks: DataFrame, vectors: DataFrame):
        self.rows, self.postings = vectors, postings.index_chunks(chunks, booked=True)
        counts = stored(postings.book_words(self.postings), "words")
        self.profiles = stored(routing.profiles_of(counts), "profiles")
        dropped(counts)

    def search(self, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH) -> DataFrame:
        """As :func:`bm25.top_k`."""
        q = bm25.with_filters(queries).select("query_id", "question", "book_filter", "chapter_filter")
        index = self.postings.select(*(f.split()[0] for f in postings.SEGMENTS.split(", ")))
        return postings.top_k(index, q, depth=depth)

    def nearest(self, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, exact: bool = True) -> DataFrame:
        """As :func:`dense.top_k`, always exact."""
        return dense.top_k(self.rows, queries, depth=depth)

    def release(self) -> None:
        dropped(self.postings, self.profiles)


class IndexedLibrary(Library):
    """See the module. ``chunks`` have ``chunk_id, corpus_pos, book_title, chapter, text`` and may have ``embedding``."""

    PARTS = ("data", "postings", "words", "trigrams")

    # --- writing -----------------------------------------------------------------------

    def _index(self, written: str, rows: DataFrame) -> None:
        at = f"{self.path}/postings/written={written}"
        segments = postings.segments(rows, by_book=True, counted=True).withColumn("book_key", book_key(F.col("book_title")[0]))
        segments.write.options(**LONG_ROWS).partitionBy("book_key").parquet(at)
        # texts were cut into words for the postings: a row for each word of a segment, which lie by book
        words = self.spark.read.schema(f"{postings.WORDS}, book_key string").parquet(at).select("book_key", F.explode(F.arrays_zip("words", "word_ns", "word_firsts")).alias("w"))
        words = words.select("book_key", F.col("w.words").alias("word"), F.col("w.word_ns").alias("n"), F.col("w.word_firsts").alias("first"))
        words.write.partitionBy("book_key").parquet(f"{self.path}/words/written={written}")
        low = rows.where("text is not null").select("book_key", F.col("_metadata.file_name").alias("file"), F.lower("text").alias("text"))
        low.mapInArrow(_filters, _TRIGRAMS).write.partitionBy("book_key").parquet(f"{self.path}/trigrams/written={written}")
        if "embedding" in rows.columns:
            self._write_vectors(written, rows)

    def _before_commit(self, before: int, listed: DataFrame, removed: DataFrame | None = None) -> None:
        if removed is None:
            own = ["book_key", "written"]
            old, new = self._listed(before).select(*own).distinct(), listed.select(*own).distinct()
            signed = self._held(old.join(new, own, "left_anti"), -1).unionByName(self._held(new.join(old, own, "left_anti"), 1))
        else:
            signed = self._counted(removed, -1)
        delta = signed.groupBy("kind", "term").agg(F.sum("value").alias("value")).where("value != 0")
        # what a run left that broke off before its commit is replaced
        delta.write.mode("overwrite").parquet(f"{self.path}/statistics/delta-{before + 1}")

    def _held(self, books: DataFrame, sign: int) -> DataFrame:
        """What the indexes of some written books add to the statistics, times ``sign``."""
        pairs = books.collect()  # a row per book that changed
        index, words = self._part("postings", postings.SEGMENTS + ", book_key string", pairs), self._part("words", _WORDS, pairs)
        value = lambda kind, term, n: (F.lit(kind).alias("kind"), F.col(term).alias("term"), (sign * F.col(n)).cast("long").alias("value"))
        sizes = index.select(F.explode(F.create_map(F.lit("n_chunks"), "n_chunks", F.lit("n_words"), "n_words")).alias("name", "n"))
        terms = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
        return terms.select(*value("df", "t.terms", "t.dfs")).unionByName(sizes.select(*value("size", "name", "n"))).unionByName(words.select(*value("word", "word", "n")))

    def _counted(self, rows: DataFrame, sign: int) -> DataFrame:
        """What some chunks add to the statistics, times ``sign``, by their texts: for a few of many books' chunks less work than their books' indexes."""
        entry = lambda kind, term, n: F.struct(F.lit(kind).alias("kind"), term.alias("term"), (sign * n).cast("long").alias("value"))
        listed = lambda kind, terms, ns: F.transform(F.arrays_zip(F.col(terms).alias("t"), F.col(ns).alias("n")), lambda x: entry(kind, x["t"], x["n"]))
        sizes = F.array(*(entry("size", F.lit(name), F.col(name)) for name in ("n_chunks", "n_words")))
        # one pass over the texts, in segments so small that all their entries may lie in one array
        found = postings.segments(rows, words=COUNTED, counted=True)
        return found.select(F.explode(F.concat(listed("df", "terms", "dfs"), listed("word", "words", "word_ns"), sizes)).alias("e")).select("e.*")

    def _part(self, part: str, schema: str, pairs: list) -> DataFrame:
        """What an index has of ``(book_key, written)`` pairs; folders of other books are filtered out before they are listed as files."""
        by: dict[str, set[str]] = {}
        for r in pairs:
            by.setdefault(r["written"], set()).add(r["book_key"])
        folders = [f"{self.path}/{part}/written={w}" for w in sorted(by) if exists(self.spark, f"{self.path}/{part}/written={w}")]
        if not folders:
            return self.spark.createDataFrame([], schema + ", written string")
        rows = self.spark.read.schema(schema + ", written string").option("basePath", f"{self.path}/{part}").parquet(*folders)
        wanted = sorted((w, k) for w, keys in by.items() for k in keys)
        if len(wanted) <= 1000:  # a filter on partitions; beyond, a join
            keys = sorted({k for _, k in wanted})
            rows = rows.where(F.col("book_key").isin(keys))
        live = self.spark.createDataFrame(wanted, "written string, book_key string")
        return rows.join(F.broadcast(live) if len(wanted) <= BROADCAST_ROWS else live, ["written", "book_key"], "left_semi")

    def _live(self, version: int) -> list:
        return self._listed(version).select("book_key", "written").distinct().collect()  # a row per book

    # --- statistics --------------------------------------------------------------------

    def statistics(self, version: int | None = None) -> DataFrame:
        """``kind, term, value`` of a version: ``df`` chunks that hold a term, ``word`` occurrences of a routing word, ``size`` totals.

        The sum of signed deltas since the last version that was compacted.
        """
        version = self.version() if version is None else version
        names = [f.getPath().getName() for f in _list(self.spark, f"{self.path}/statistics")]
        base = max((int(n.split("-")[1]) for n in names if n.startswith("total-") and int(n.split("-")[1]) <= version and exists(self.spark, f"{self.path}/statistics/{n}/_SUCCESS")), default=0)
        paths = [f"{self.path}/statistics/total-{base}"] * (base > 0) + [f"{self.path}/statistics/delta-{i}" for i in range(base + 1, version + 1)]
        if not paths:
            return self.spark.createDataFrame([], _STATISTICS)
        total = self.spark.read.schema(_STATISTICS).parquet(*paths).groupBy("kind", "term").agg(F.sum("value").alias("value")).where("value != 0")
        if version - base < COMPACT:
            return total
        total.write.mode("overwrite").parquet(f"{self.path}/statistics/total-{version}")
        return self.statistics(version)

    def vocabulary(self, version: int | None = None) -> DataFrame:
        """``term, df`` of a version."""
        return self.statistics(version).where("kind = 'df'").select("term", F.col("value").alias("df"))

    def size(self, version: int | None = None) -> tuple[int, int]:
        """Chunks of a version, and words in them."""
        found = {r["term"]: r["value"] for r in self.statistics(version).where("kind = 'size'").collect()}  # two rows
        return found.get("n_chunks", 0), found.get("n_words", 0)

    def profiles(self, version: int | None = None, *, top_n: int = PROFILE_SIZE) -> DataFrame:
        """``book_title, word, score, rank`` as :func:`routing.book_profiles`, from stored counts: no text is read."""
        version = self.version() if version is None else version
        live = self._live(version)
        words = self._part("words", _WORDS, live)
        count = words.groupBy("book_key", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        corpus = self.statistics(version).where("kind = 'word'").select(F.col("term").alias("word"), F.col("value").alias("corpus_n"))
        book = words.groupBy("book_key").agg(F.sum("n").alias("book_total"))
        total = corpus.agg(F.sum("corpus_n").alias("corpus_total"))
        titles = self._part("postings", postings.SEGMENTS + ", book_key string", live).select("book_key", F.col("book_title")[0].alias("book_title")).distinct()
        score = (F.col("n") / F.col("book_total")) / (F.col("corpus_n") / F.col("corpus_total")) * F.col("n")
        scored = count.join(book, "book_key").join(corpus, "word").crossJoin(F.broadcast(total)).withColumn("score", score)  # one row
        w = Window.partitionBy("book_key").orderBy(F.desc(F.round("score", 9)), "first")
        best = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
        return best.join(titles, "book_key").select("book_title", "word", "score", "rank")

    # --- search ------------------------------------------------------------------------

    def search(self, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, drop_zero: bool = False, version: int | None = None) -> DataFrame:
        """BM25 as :func:`bm25.top_k` over a version's postings; no text is read."""
        version = self.version() if version is None else version
        index = self._part("postings", postings.SEGMENTS + ", book_key string", self._live(version))
        q = bm25.with_filters(queries).select("query_id", "question", "book_filter", "chapter_filter")
        return postings.top_k(index, q, vocabulary=self.vocabulary(version), size=self.size(version), depth=depth, drop_zero=drop_zero)

    def nearest(self, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, probes: int | None = None, exact: bool = False, version: int | None = None) -> DataFrame:
        """As :func:`dense.top_k` over a version's vectors in the ``probes`` lists nearest to a query (None: a quarter, 16 at least).

        ``exact`` reads all lists. The others are not read: they are filtered out as partitions.
        """
        version = self.version() if version is None else version
        number = self._lists()
        centres = self._centres(number)
        rows = self.vectors(version)
        if exact or centres is None:
            return dense.top_k(rows, queries, depth=depth)
        n = min(len(centres), probes or max(16, len(centres) // 4))

        def chosen(vectors: list) -> list[np.ndarray]:
            fits = np.array([v if len(v) == centres.shape[1] else [0.0] * centres.shape[1] for v in vectors], np.float64)
            near = np.argsort(-(fits @ centres.T), axis=1, kind="stable")[:, :n]
            # vectors of another length than the centres' are all in the first list
            return [near[i] if len(v) == centres.shape[1] else np.array([0]) for i, v in enumerate(vectors)]

        return dense.top_k(rows, queries, depth=depth, probes=chosen)

    def vectors(self, version: int | None = None) -> DataFrame:
        """A version's vectors with their ``list``."""
        version = self.version() if version is None else version
        columns = self._columns(version)
        kind = columns["embedding"].dataType.simpleString() if columns is not None and "embedding" in columns.names else "array<float>"
        schema = f"chunk_id string, corpus_pos long, book_title string, chapter string, embedding {kind}, book_key string, list int"
        return self._part(f"vectors/lists-{self._lists()}/rows", schema, self._live(version))

    def _lists(self) -> int:
        """The number of the newest centres whose lists are complete; 0 where there are none."""
        names = [f.getPath().getName() for f in _list(self.spark, f"{self.path}/vectors")]
        return max((int(n.split("-")[1]) for n in names if exists(self.spark, f"{self.path}/vectors/{n}/ready")), default=0)

    def _centres(self, number: int) -> np.ndarray | None:
        if not number:
            return None
        return np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/vectors/lists-{number}/centres").orderBy("list").collect()])  # LISTS at most

    def _write_vectors(self, written: str, rows: DataFrame) -> None:
        known = rows.where("embedding is not null").select(*_VECTORS[:1], F.col("corpus_pos").cast("long").alias("corpus_pos"), *_VECTORS[2:])
        number = self._lists()
        if not number:
            number = 1
            if not self._learn(known, number):
                return
            self._ready(number)
        self._place(known, number).write.partitionBy("list").parquet(f"{self.path}/vectors/lists-{number}/rows/written={written}")

    def relearn(self) -> None:
        """Learn the centres anew from the newest version and deal its vectors into their lists; for a library that has grown.

        Searches go on in the old lists until the new ones are complete. Versions before
        the newest have no vectors any more.
        """
        rows, number = self.vectors(), self._lists() + 1
        _remove(self.spark, f"{self.path}/vectors/lists-{number}")  # of a run that broke off
        if self._learn(rows, number):
            self._place(rows.drop("list"), number).write.partitionBy("written", "list").parquet(f"{self.path}/vectors/lists-{number}/rows")
            self._ready(number)

    def _ready(self, number: int) -> None:
        path, system = _path(self.spark, f"{self.path}/vectors/lists-{number}/ready")
        system.mkdirs(path)

    def _place(self, rows: DataFrame, number: int) -> DataFrame:
        """Rows with the ``list`` of the nearest centre, dealt out for a write by list."""
        ship(self.spark)
        shared = self.spark.sparkContext.broadcast(self._centres(number))  # LISTS vectors at most

        @F.arrow_udf("int")
        def nearest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            of = shared.value
            for b in batches:
                out = np.zeros(len(b), np.int32)  # vectors of another length are in the first list
                fits = np.flatnonzero(b.value_lengths().to_numpy(zero_copy_only=False) == of.shape[1])
                if len(fits):
                    v = b.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), -1)
                    out[fits] = np.argmax(v @ of.T, axis=1)
                yield pa.array(out)

        # a list is dealt out by chunk, so that one that holds a third of all vectors is written by several tasks
        placed = rows.withColumn("list", nearest(F.col("embedding")))
        return placed.repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8))).sortWithinPartitions("list", "book_key")

    def _learn(self, rows: DataFrame, number: int) -> bool:
        """Store centres of unit length from a sample, as many lists as the root of the number of vectors; False where there are no vectors."""
        sizes = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        if sizes is None:
            return False
        n, d = sizes["count"], sizes["d"]
        norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        unit = F.when(norm > 0, F.transform("embedding", lambda x: x.cast("double") / norm))
        some = rows.where(F.size("embedding") == d)
        # distinct vectors: centres are begun with as many different ones as there are lists
        some = (some.sample(SAMPLE / n, seed=1) if n > SAMPLE else some).select(unit.alias("v")).where("v is not null").distinct()
        # SAMPLE vectors are little for a task of each of the session's shuffle partitions, in every iteration
        some = some.coalesce(max(1, self.spark.sparkContext.defaultParallelism)).persist()
        k, found = min(LISTS, round(n**0.5)), some.count()
        if k < 2 or found < 3:
            centres = np.array([r["v"] for r in some.limit(1).collect()] or [[0.0] * d])
        else:
            model = KMeans(k=min(k, found), seed=1, maxIter=10, initMode="random").fit(some.select(array_to_vector("v").alias("features")))
            centres = np.array(model.clusterCenters())
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        some.unpersist()
        table = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/vectors/lists-{number}/centres")
        return True

    # --- substrings --------------------------------------------------------------------

    def holding(self, keyword: str, *, book: str | None = None, version: int | None = None) -> DataFrame:
        """The manifest's files that may hold the keyword, whatever the case; never leaves one out that does.

        Keywords of fewer than three letters may be anywhere.
        """
        ship(self.spark)
        version = self.version() if version is None else version
        files = self._listed(version)
        if book:
            files = files.where(F.col("book_key") == book_key(F.lit(book)))
        low = self.spark.range(1).select(F.lower(F.lit(keyword))).first()[0]
        asked = trigrams(low)
        if not len(asked):
            return files
        rows = self._part("trigrams", _TRIGRAMS, files.select("book_key", "written").distinct().collect())  # a row per book

        def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                held = [may_hold(np.frombuffer(bits.as_py(), np.uint8), asked) for bits in b.column("bits")]
                yield b.filter(pa.array(held, pa.bool_())).select(["book_key", "written", "file"])

        found = rows.mapInArrow(test, "book_key string, written string, file string").distinct()
        return files.join(found, ["book_key", "written", "file"], "left_semi").select(*files.columns)

    def keyword_search(self, keyword: str, *, book: str | None = None, limit: int | None = None, version: int | None = None) -> DataFrame:
        """As :func:`query.keyword_search` over a version; opens the files that may hold the keyword."""
        version = self.version() if version is None else version
        return query.keyword_search(self._open(self.holding(keyword, book=book, version=version), self._columns(version)), keyword, book=book, limit=limit)

    def vacuum(self) -> None:
        super().vacuum()
        version, number = self.version(), self._lists()
        needed = {f"written={r['written']}" for r in self._live(version)}
        for f in _list(self.spark, f"{self.path}/vectors"):
            if f.getPath().getName() != f"lists-{number}":
                _remove(self.spark, f.getPath().toString())
        for f in _list(self.spark, f"{self.path}/vectors/lists-{number}/rows"):
            if f.getPath().getName().startswith("written=") and f.getPath().getName() not in needed:
                _remove(self.spark, f.getPath().toString())
        if version:
            total = f"{self.path}/statistics/total-{version}"
            if not exists(self.spark, f"{total}/_SUCCESS"):
                self.statistics(version).write.mode("overwrite").parquet(total)
            for f in _list(self.spark, f"{self.path}/statistics"):
                if f.getPath().getName() != f"total-{version}":
                    _remove(self.spark, f.getPath().toString())


def trigrams(text: str) -> np.ndarray:
    """The distinct runs of three code points of a text, as numbers."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    # by hashing, not by sorting: a text has few distinct ones
    return pc.unique(pa.array(c[:-2] | c[1:-1] << np.uint64(21) | c[2:] << np.uint64(42))).to_numpy() if len(c) > 2 else np.empty(0, np.uint64)


def _places(numbers: np.ndarray, n_bits: int) -> np.ndarray:
    """``PLACES`` rows of bits that numbers set; ``n_bits`` is a power of two."""
    out = []
    for i in range(PLACES):
        x = (numbers ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out.append((x ^ (x >> np.uint64(29))) & np.uint64(n_bits - 1))
    return np.stack(out)


def bloom(numbers: np.ndarray) -> bytes:
    """A Bloom filter of distinct numbers, of at least ``BITS`` bits each."""
    n_bits = 1 << max(6, (BITS * len(numbers) - 1).bit_length())
    bits = np.zeros(n_bits, np.uint8)
    bits[_places(numbers, n_bits).astype(np.int64).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(raw: np.ndarray, numbers: np.ndarray) -> bool:
    """Whether a filter may hold all of the numbers."""
    at = _places(numbers, 8 * len(raw)).astype(np.int64)
    return bool((raw[at >> 3] >> (at & 7).astype(np.uint8) & 1).all())


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A filter for each file that a task reads; files follow each other."""
    at, held, new, size = None, np.empty(0, np.uint64), [], 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]]), pa.array([bloom(np.unique(np.concatenate([held, *new])))], pa.binary())], names=["book_key", "file", "bits"])

    for b in batches:
        for key, file, text in zip(*(c.to_pylist() for c in b.columns)):
            if at != (key, file):
                if at is not None:
                    yield row()
                at, held, new, size = (key, file), np.empty(0, np.uint64), [], 0
            new.append(trigrams(text))
            size += len(new[-1])
            if size > max(MERGED, len(held)):  # not with every text, which costs what is held each time
                held, new, size = np.unique(np.concatenate([held, *new])), [], 0
    if at is not None:
        yield row()
