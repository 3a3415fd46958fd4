"""Ranked lexical search by Fagin's threshold algorithm over a stored index.

The index is document-partitioned: a *segment* is a bounded batch of documents, one stored
row that holds, for every term, its documents sorted by impact, and a forward index from
document to its terms' impacts. A term's impact in a document depends on the corpus only
by the number and mean length of its documents, so lists are sorted when they are stored;
terms' weights, which differ by query set, are applied when it is searched.

A task opens its segments one after another. For a query it reads the lists of the query's
terms in turns, a block of the next entries of each list, looks up every new document's
whole score in the forward index, and stops when the threshold, the score of a document
that would stand at the current place of each list, is strictly below the worst of the
best scores kept; documents of an equal score are never left out. The best scores go on
from segment to segment. A first job searches a part of the segments; the others start
with the worst score that it kept for a query as a floor, so few tasks have anything to
send that is not among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_ROWS, lean, materialize, release, ship
from .decontaminate import words_of

#: Terms' occurrences that a segment holds at about this many: some 12 MB as stored.
SEGMENT_TERMS = 1_500_000
#: Bytes of queries that are searched at once (and broadcast); more go block by block.
BLOCK_BYTES = 8 << 20
#: Entries that are read of each list in a turn.
TURN = 64
#: One of so many segments is searched first.
FIRST = 16

_TERMS = "keys array<{key}>, sizes binary, terms array<binary>, dfs array<long>, starts binary, numbers binary, counts binary"
_INDEX = "keys array<{key}>, terms array<binary>, dfs array<long>, starts binary, numbers binary, impacts binary, docs binary, sorted binary"


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight: in whole numbers, at most a million."""
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_factor(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Documents' ``m``: 50 and half of their lengths in percent of the mean; the products are taken of any size."""
    return np.array([100 - 50 + 50 * n * n_docs // max(1, n_terms) for n in sizes.tolist()], np.int64)


def weight(df: int, n_docs: int) -> int:
    """A term's weight: never below zero, larger for rarer terms."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Counts:
    """Collects documents; gives a row of their terms' counts."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.keys, self.terms, self.at = [], [], 0

    def add(self, key, text: str | None) -> None:
        words, own = words_of(text), self.numbers
        self.terms.append(np.fromiter([own.setdefault(w, len(own)) for w in words], np.int32, len(words)))
        self.keys.append(key)
        self.at += len(words) + 1

    def row(self, key_type: pa.DataType) -> pa.RecordBatch:
        n = np.array([len(t) for t in self.terms], np.int64)
        width = max(1, len(self.numbers))
        pairs, counts = np.unique(np.repeat(np.arange(len(n)), n) * width + np.concatenate(self.terms), return_counts=True)
        doc, term = pairs // width, (pairs % width).astype("<i4")
        starts = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n))))).astype("<i4")
        df = np.bincount(term, minlength=len(self.numbers)).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.keys], pa.list_(key_type)), pa.array([n.astype("<i8").tobytes()]), pa.array([list(self.numbers)], pa.list_(pa.binary())),
                pa.array([df.tolist()], pa.list_(pa.int64())), *(pa.array([a.tobytes()]) for a in (starts, term, counts.astype("<i4"))),
            ],
            names=["keys", "sizes", "terms", "dfs", "starts", "numbers", "counts"],
        )


class Index:
    """A stored index: a row per segment, the number of documents with a term, and of all terms' occurrences."""

    def __init__(self, segments: DataFrame, n_docs: int, n_terms: int):
        self.segments, self.n_docs, self.n_terms = segments, n_docs, n_terms

    def frequencies(self, terms: list[bytes]) -> dict[bytes, int]:
        """Documents that hold each of some terms, a set of a size its caller has checked."""
        spark = self.segments.sparkSession
        asked = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in terms], "term binary"))
        held = self.segments.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.dfs").alias("df"))
        return {bytes(r["term"]): r["df"] for r in held.join(asked, "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}

    def release(self) -> None:
        release(self.segments)


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_terms: int = SEGMENT_TERMS) -> Index:
    """Store the index of whole texts.

    Null texts and texts without terms are documents without a term, which no query finds
    and which do not count. Repeated rows are documents of their own. Texts are read once;
    a second pass over the counts sorts the lists, as impacts need the corpus' mean length.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, key_type = _Counts(), None
        for b in batches:
            key_type = b.schema.field(0).type
            for k, t in zip(b.column(0), b.column(1)):
                seg.add(k.as_py(), t.as_py())
                if seg.at >= segment_terms:
                    yield seg.row(key_type)
                    seg = _Counts()
        if seg.keys:
            yield seg.row(key_type)

    @lean
    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        for b in batches:
            for sizes in b.column(0):
                n = np.frombuffer(sizes.as_py(), "<i8")
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], names=["n_docs", "n_terms"])

    counted = materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(count, _TERMS.format(key=kind)), "term-counts", **LONG_ROWS)
    n_docs, n_terms = counted.select("sizes").mapInArrow(totals, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = n_docs or 0, n_terms or 0

    @lean
    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                sizes, starts, numbers, counts = (np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("sizes", "<i8"), ("starts", "<i4"), ("numbers", "<i4"), ("counts", "<i4")))
                doc = np.repeat(np.arange(len(sizes), dtype="<i4"), np.diff(starts))
                impacts = impact(counts.astype(np.int64), length_factor(sizes, n_docs, n_terms)[doc]).astype("<i4")
                order = np.lexsort((doc, -impacts, numbers))
                own = [pa.array([a.tobytes()]) for a in (impacts, doc[order], impacts[order])]
                row = b.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*(row.column(c) for c in ("keys", "terms", "dfs", "starts", "numbers")), *own],
                    names=["keys", "terms", "dfs", "starts", "numbers", "impacts", "docs", "sorted"],
                )

    segments = materialize(counted.mapInArrow(sort, _INDEX.format(key=kind)), "impacts", **LONG_ROWS)
    release(counted)
    return Index(segments, n_docs, n_terms)


class Segment:
    """One row of the index, opened."""

    def __init__(self, batch: pa.RecordBatch, i: int = 0):
        of = lambda c: np.frombuffer(batch.column(c)[i].as_py(), "<i4")
        self.keys = batch.column("keys")[i].as_py()
        self.number = {t: n for n, t in enumerate(batch.column("terms")[i].as_py())}
        self.first = np.concatenate(([0], np.cumsum(batch.column("dfs")[i].values.to_numpy()))).astype(np.int64)
        self.starts, self.numbers, self.impacts, self.docs, self.sorted = map(of, ("starts", "numbers", "impacts", "docs", "sorted"))
        self.entries = 0
        self._weights = np.zeros(len(self.number), np.int64)
        self._seen = np.zeros(len(self.keys), bool)

    def best(self, terms: list[tuple[int, int]], k: int, floor: int, *, turn: int = TURN) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores: all whose score is among the ``k`` highest here, ties included, and at least ``floor``.

        ``terms`` are numbers and weights of the query's terms that the segment holds.
        """
        at, w = (np.array(x, np.int64) for x in zip(*terms))
        self._weights[at] = w
        self._seen[:] = False
        low, high = self.first[at], self.first[at + 1]
        docs, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        kept = np.empty(0, np.int64)
        while True:
            read = low[:, None] + np.arange(turn)
            read = read[read < high[:, None]]
            self.entries += len(read)
            new = self.docs[read]
            new = np.unique(new[~self._seen[new]])
            if len(new):
                self._seen[new] = True
                found = self._scores(new)
                docs.append(new)
                scores.append(found)
                kept = np.concatenate((kept, found))
                if len(kept) > k:
                    kept = np.partition(kept, len(kept) - k)[len(kept) - k :]
            low = low + turn
            open_ = low < high
            if not open_.any():
                break
            # a document not met yet stands at or after the last entry read in every list, or not in it
            threshold = int((w[open_] * self.sorted[low[open_] - 1]).sum())
            if threshold < max(floor, int(kept.min()) if len(kept) == k else 0, 1):
                break
        self._weights[at] = 0
        found, score = np.concatenate(docs), np.concatenate(scores)
        least = max(floor, int(kept.min()) if len(kept) == k else 1, 1)
        return found[score >= least], score[score >= least]

    def _scores(self, docs: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index."""
        first, n = self.starts[docs].astype(np.int64), np.diff(self.starts)[docs]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(first - (ends - n), n)
        part = self._weights[self.numbers[at]] * self.impacts[at]
        return np.add.reduceat(part, ends - n)


def _better(row: tuple) -> tuple:
    """Highest score first, then the smallest key; null keys first, as Spark sorts them."""
    score, key = row
    return (-score, key is not None, key if key is not None else 0)


def _search(segments: DataFrame, shared, k: int) -> DataFrame:
    """``query, key, score``: the best of each task."""
    kind = segments.schema["keys"].dataType.elementType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, terms, weights, floors = shared.value  # a query is its terms' numbers
        best: dict[int, list] = {}
        key_type = None
        for b in batches:
            key_type = b.schema.field("keys").type.value_type
            for i in range(b.num_rows):
                seg = Segment(b, i)
                here = [seg.number.get(t) for t in terms]
                for q, own in enumerate(asked):
                    held = [(here[t], weights[t]) for t in own if here[t] is not None and weights[t] > 0]
                    if not held:
                        continue
                    mine = best.get(q, [])
                    floor = max(floors[q], mine[-1][0] if len(mine) == k else 0)
                    docs, scores = seg.best(held, k, floor)
                    if len(docs):
                        mine = mine + [(int(s), seg.keys[d]) for d, s in zip(docs.tolist(), scores.tolist())]
                        best[q] = sorted(mine, key=_better)[:k]
        rows = [(q, key, score) for q, own in best.items() for score, key in own]
        if rows:
            queries, keys, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(queries, pa.int64()), pa.array(keys, key_type), pa.array(scores, pa.int64())], names=["query", "key", "score"])

    return segments.mapInArrow(run, f"query long, key {kind}, score long")


def _blocks(queries: DataFrame, *, key: str, text: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Ids and distinct terms of queries that have any, streamed to the driver in blocks of bounded bytes."""
    block, size = [], 0
    for r in queries.select(F.col(key).alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = set(words_of(r["t"]))
        if words:
            block.append((r["k"], words))
            size += len(r["t"])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(
    index: Index, queries: DataFrame, *, k: int = 50, key: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, first: int = FIRST
) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id, rank, doc_id, score``, named so whatever the inputs' names.

    Terms count once in a query. Scores above 0 only; equal scores by ascending document
    key, null keys first. Queries that share an id are ranked each on their own; queries of
    null or without terms that the corpus holds give no rows. Results are stored.
    """
    spark = index.segments.sparkSession
    ship(spark)
    doc_kind = index.segments.schema["keys"].dataType.elementType.simpleString()
    item_kind = queries.schema[key].dataType.simpleString()
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_first())
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    early = F.pmod(F.xxhash64("starts"), F.lit(first)) == 0
    out = None
    for block in _blocks(queries, key=key, text=text, block_bytes=block_bytes):
        terms = sorted({w for _, ws in block for w in ws})
        number = {t: i for i, t in enumerate(terms)}
        df = index.frequencies(terms)
        weights = [weight(df[t], index.n_docs) if t in df else 0 for t in terms]
        asked, floors = [sorted(number[w] for w in ws) for _, ws in block], [0] * len(block)
        shared = spark.sparkContext.broadcast((asked, terms, weights, floors))  # of one block: bounded by its bytes
        some = materialize(top(_search(index.segments.where(early), shared, k)), "early")
        for r in some.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():  # a number a query
            floors[r["query"]] = r["least"]
        shared.unpersist()
        shared = spark.sparkContext.broadcast((asked, terms, weights, floors))
        found = top(_search(index.segments.where(~early), shared, k).unionByName(some.drop("rank")))
        items = spark.createDataFrame([(i, k_) for i, (k_, _) in enumerate(block)], f"query long, item_id {item_kind}")
        part = found.join(F.broadcast(items), "query").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("key").alias("doc_id"), "score")  # of one block
        part = materialize(part, "ranked")
        shared.unpersist()
        release(some)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")
    return out


def rank_documents(docs: DataFrame, queries: DataFrame, *, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Index ``docs``, search all ``queries``: ``item_id, rank, doc_id, score``; see :func:`search`.

    No documents or no queries give no rows; other columns are not read, so none can clash.
    """
    index = build_index(docs, key=key, text=text)
    out = search(index, queries, k=k, key=item_key, text=item_text)
    index.release()
    return out
