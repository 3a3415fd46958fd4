"""Benchmark decontamination over a stored, distributed positional inverted index.

The index is document-partitioned: a *segment* is a bounded batch of documents whose
words have positions in one number line (documents lie apart on it by one free
position), and a posting list is the ascending positions of a term in the segment. All
terms of all documents are stored as one Parquet table in the shared workspace, so any
number of benchmarks can be searched in one index, each reading the terms it asks for.

A phrase is found by intersecting the posting lists of its words, each moved back by the
word's offset, from the corpus-wide rarest word on. Phrases are kept by their rarest
word, so a segment looks only at those whose rarest word it holds. Proximity matches
come from the same lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, release, ship, trim

#: Words of a window.
WINDOW = 13
#: Words of text that a segment holds at about this many.
SEGMENT_WORDS = 1_000_000
#: Bytes of benchmark text that are searched at once (and broadcast); more go block by block.
BLOCK_BYTES = 8 << 20

#: A-Z in lower case; bytes of ASCII other than digits and letters to a space; others stay.
_WORDS = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))

_INDEX = "segment long, ordinal int, base long, n_words long, key {key}, term binary, n long, positions binary"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII digits and letters and of all other characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Store the positional index of whole texts; returns the stored table.

    It has a row per document (``term`` null: ``segment, ordinal, base, n_words, key``)
    and a row per segment and term (``segment, term, n, positions``; positions are
    little-endian unsigned 32-bit differences). Null texts have no words; repeated rows
    are documents of their own.
    """
    ship(docs.sparkSession)
    schema = _INDEX.format(key=docs.schema[key].dataType.simpleString())

    @lean
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        seg, n, kind = _Segment(), 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for k, t in zip(b.column(0), b.column(1)):
                seg.add(k.as_py(), t.as_py())
                if seg.at >= segment_words:
                    yield seg.rows(part + n, kind)
                    seg, n = _Segment(), n + 1
        if seg.keys:
            yield seg.rows(part + n, kind)

    return materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(index, schema), "postings")


class _Numbers(dict):
    """Numbers terms as they come."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class _Segment:
    """Collects documents, gives their index rows."""

    def __init__(self):
        self.own = _Numbers()
        self.at, self.keys, self.bases, self.counts = 0, [], [], []
        self.terms: list[np.ndarray] = []

    def add(self, key, text: str | None) -> None:
        words = words_of(text)
        self.terms.append(np.fromiter(map(self.own.__getitem__, words), np.int32, len(words)))
        self.keys.append(key)
        self.bases.append(self.at)
        self.counts.append(len(words))
        self.at += len(words) + 1

    def rows(self, segment: int, key_type: pa.DataType) -> pa.RecordBatch:
        ids = np.concatenate(self.terms)
        places = np.concatenate([np.arange(b, b + n, dtype=np.uint32) for b, n in zip(self.bases, self.counts)])
        order = np.argsort(ids, kind="stable")
        places = places[order]
        counts = np.bincount(ids, minlength=len(self.own))  # every term has a place
        first = np.cumsum(counts) - counts
        d, p = len(self.keys), len(first)
        deltas = np.diff(places, prepend=np.uint32(0)).astype("<u4")
        deltas[first] = places[first]
        at = np.concatenate((np.zeros(d, np.int64), 4 * first, [4 * len(ids)])).astype(np.int32)
        positions = pa.BinaryArray.from_buffers(
            pa.binary(), d + p, [pa.array([False] * d + [True] * p).buffers()[1], pa.py_buffer(at.tobytes()), pa.py_buffer(deltas.tobytes())]
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(d + p, segment)),
                pa.concat_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.nulls(p, pa.int32())]),
                pa.concat_arrays([pa.array(self.bases, pa.int64()), pa.nulls(p, pa.int64())]),
                pa.concat_arrays([pa.array(self.counts, pa.int64()), pa.nulls(p, pa.int64())]),
                pa.concat_arrays([pa.array(self.keys, key_type), pa.nulls(p, key_type)]),
                pa.concat_arrays([pa.nulls(d, pa.binary()), pa.array(list(self.own), pa.binary())]),
                pa.concat_arrays([pa.nulls(d, pa.int64()), pa.array(counts.astype(np.int64))]),
                positions,
            ],
            names=["segment", "ordinal", "base", "n_words", "key", "term", "n", "positions"],
        )


def frequencies(index: DataFrame, terms: Iterable[bytes]) -> dict[bytes, int]:
    """Corpus counts of the given terms, a set of a size its caller has checked."""
    asked = _terms_table(index, terms)
    counted = index.where("term is not null").join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("n").alias("n"))
    return {bytes(r["term"]): r["n"] for r in counted.collect()}


def _terms_table(index: DataFrame, terms: Iterable[bytes]) -> DataFrame:
    return index.sparkSession.createDataFrame([(bytearray(t),) for t in sorted(set(terms))], "term binary")


def intersect(lists: list[np.ndarray | None], order: Iterable[int]) -> np.ndarray:
    """Where a phrase starts: its words' posting lists, moved back by their offsets, intersected in the given order."""
    at: np.ndarray | None = None
    for i in order:
        found = lists[i]
        if found is None:
            return np.empty(0, np.int64)
        if at is None:
            at = found - i
        else:
            want = at + i
            where = np.searchsorted(found, want)
            where[where == len(found)] = 0
            at = at[found[where] == want]
        if not len(at):
            break
    return at if at is not None else np.empty(0, np.int64)


class Phrases(NamedTuple):
    """One block of items' phrases by their rarest word: all arrays ascend with ``rarest``.

    ``words`` holds the items' words end to end as numbers of ``terms``; a phrase is
    ``size`` of them from ``start`` on. ``count`` is each term's number in the corpus.
    """

    terms: list[bytes]
    count: np.ndarray
    words: np.ndarray
    items: list[str]
    rarest: np.ndarray
    item: np.ndarray
    start: np.ndarray
    size: np.ndarray


def arrange(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int | None) -> Phrases:
    """Every window of the items' words (None: each item is one phrase), without those that hold a word the corpus lacks."""
    terms = sorted({w for _, ws in items for w in ws})
    number = {t: i for i, t in enumerate(terms)}
    found = frequencies(index, terms)
    count = np.array([found.get(t, 0) for t in terms], np.int64)
    words = np.array([number[w] for _, ws in items for w in ws], np.int32)
    item, start, size, rarest, begin = [], [], [], [], 0
    for i, (_, ws) in enumerate(items):
        n = min(window or len(ws), len(ws))
        if n:
            every = np.lib.stride_tricks.sliding_window_view(words[begin : begin + len(ws)], n)
            at = np.flatnonzero(count[every].min(1) > 0)
            rarest.append(every[at, count[every[at]].argmin(1)])
            start.append(begin + at)
            item.append(np.full(len(at), i))
            size.append(np.full(len(at), n))
        begin += len(ws)
    none = [np.empty(0, np.int64)]
    rarest, item, start, size = (np.concatenate(none + x) for x in (rarest, item, start, size))
    order = np.argsort(rarest, kind="stable")
    return Phrases(terms, count, words, [i for i, _ in items], rarest[order], item[order], start[order], size[order])


def near(lists: dict[bytes, np.ndarray], terms: list[bytes], within: int, count: dict[bytes, int]) -> np.ndarray:
    """Places of the rarest term around which all ``terms`` lie within ``within`` words."""
    ranked = sorted(set(terms), key=lambda t: (count.get(t, 0), t))
    if any(t not in lists for t in ranked):
        return np.empty(0, np.int64)
    at = lists[ranked[0]]
    for t in ranked[1:]:
        low, high = np.searchsorted(lists[t], at - within), np.searchsorted(lists[t], at + within, "right")
        at = at[high > low]
    return at


def _postings(index: DataFrame, terms: Iterable[bytes]) -> DataFrame:
    asked = F.broadcast(_terms_table(index, terms))  # of one block: bounded by BLOCK_BYTES
    docs = index.where("term is null").select("segment", "ordinal", "base", "n_words", F.lit(None).cast("binary").alias("term"), F.lit(None).cast("binary").alias("positions"))
    lists = index.where("term is not null").join(asked, "term", "left_semi").select(
        "segment", F.lit(None).cast("int").alias("ordinal"), F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("n_words"), "term", "positions"
    )
    return docs.unionByName(lists)


def _opened(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[bytes, np.ndarray]]:
    """A segment's documents (ordinal, base, words; by base) and posting lists."""
    is_doc = table.column("term").is_null()
    docs = table.filter(is_doc).sort_by("base")
    lists = table.filter(pc.invert(is_doc))
    return (
        docs.column("ordinal").to_numpy(),
        docs.column("base").to_numpy(),
        docs.column("n_words").to_numpy(),
        {t: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(lists.column("term").to_pylist(), lists.column("positions").to_pylist())},
    )


def phrase_matches(index: DataFrame, items: list[tuple[str, list[bytes]]], window: int | None = None) -> DataFrame:
    """Exact matches of one block of items, stored: ``segment, ordinal, item_id, spans``.

    ``items`` pairs an id with its words; looked for is every run of ``window`` of them
    (the whole where there are fewer, or if it is None). ``spans`` are the document's
    word positions that occurrences of any of them cover, merged, as
    ``array<struct<start, end>>``, ends exclusive.
    """
    spark = index.sparkSession
    ship(spark)
    phrases = arrange(index, items, window)
    shared = spark.sparkContext.broadcast(phrases)  # a few numbers for each word of the block
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        p = shared.value
        ordinal, base, _, by_term = _opened(table)
        segment = table.column("segment")[0].as_py()
        number = {t: i for i, t in enumerate(p.terms)}
        held = {number[t]: v for t, v in by_term.items()}
        pieces: dict[int, list[tuple[np.ndarray, int]]] = {}
        for term in sorted(held):
            for k in range(*np.searchsorted(p.rarest, [term, term + 1]).tolist()):
                words = p.words[p.start[k] : p.start[k] + p.size[k]]
                at = intersect([held.get(w) for w in words.tolist()], np.argsort(p.count[words], kind="stable").tolist())
                if len(at):
                    pieces.setdefault(int(p.item[k]), []).append((at, int(p.size[k])))
        out: list[tuple[int, str, list[dict]]] = []
        for i, found in sorted(pieces.items()):
            start = np.concatenate([at for at, _ in found])
            end = np.concatenate([at + n for at, n in found])
            doc = np.searchsorted(base, start, "right") - 1
            order = np.argsort(start, kind="stable")
            merged: dict[int, list[list[int]]] = {}
            for d, a, b in zip(doc[order].tolist(), start[order].tolist(), end[order].tolist()):
                own = merged.setdefault(d, [])
                a, b = a - int(base[d]), b - int(base[d])
                if own and a <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], b)
                else:
                    own.append([a, b])
            out += [(int(ordinal[d]), p.items[i], [{"start": a, "end": b} for a, b in own]) for d, own in merged.items()]
        trim()
        return pa.table(
            {
                "segment": pa.array([segment] * len(out), pa.int64()),
                "ordinal": pa.array([o for o, _, _ in out], pa.int32()),
                "item_id": pa.array([i for _, i, _ in out], pa.string()),
                "spans": pa.array([s for _, _, s in out], pa.list_(span)),
            }
        )

    found = _postings(index, phrases.terms).groupBy("segment").applyInArrow(
        search, "segment long, ordinal int, item_id string, spans array<struct<start:long,end:long>>"
    )
    found = materialize(found, "matches")
    shared.unpersist()
    return found


def proximity_matches(index: DataFrame, queries: list[tuple[str, list[bytes], int]]) -> DataFrame:
    """Documents in which a query's terms lie near each other: ``key, query_id, places``.

    A query is an id, its terms and a distance; ``places`` are the word positions of the
    rarest term around which every other occurs within that distance, in the document.
    """
    spark = index.sparkSession
    ship(spark)
    terms = {t for _, ts, _ in queries for t in ts}
    shared = spark.sparkContext.broadcast((queries, frequencies(index, terms)))

    def search(table: pa.Table) -> pa.Table:
        asked, count = shared.value
        ordinal, base, n_words, lists = _opened(table)
        segment = table.column("segment")[0].as_py()
        out = []
        for query, ts, within in asked:
            found = near(lists, ts, within, count)
            doc = np.searchsorted(base, found, "right") - 1
            for d in np.unique(doc).tolist():
                low, high = int(base[d]), int(base[d] + n_words[d])
                own = {t: v[np.searchsorted(v, low) : np.searchsorted(v, high)] - low for t, v in lists.items() if t in set(ts)}
                if all(len(own[t]) for t in own) and len(at := near(own, ts, within, count)):
                    out.append((int(ordinal[d]), query, at.tolist()))
        return pa.table(
            {
                "segment": pa.array([segment] * len(out), pa.int64()),
                "ordinal": pa.array([o for o, _, _ in out], pa.int32()),
                "query_id": pa.array([q for _, q, _ in out], pa.string()),
                "places": pa.array([p for _, _, p in out], pa.list_(pa.int64())),
            }
        )

    found = _postings(index, terms).groupBy("segment").applyInArrow(
        search, "segment long, ordinal int, query_id string, places array<long>"
    )
    return found.join(index.where("term is null").select("segment", "ordinal", "key"), ["segment", "ordinal"]).select(
        "key", "query_id", "places"
    )


def blocks_of(items: DataFrame, *, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items' ids and words, streamed to the driver in blocks of bounded bytes."""
    block, size = [], 0
    for r in items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        block.append((r["k"], words))
        size += len(r["t"].encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES,
    segment_words: int = SEGMENT_WORDS,
) -> DataFrame:
    """One row per document: ``key, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of any window of an item; a document is
    contaminated if it has hits and at least one word in ``share`` is hit. Null texts
    have no words, items without words no windows, items of a null id count as one of an
    empty id; items that share an id count once. Repeated rows each give a row. Other
    columns are not read; ``key`` must not be named like a result. An empty benchmark hits
    nothing; no documents, no rows.
    """
    if key in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"):
        raise ValueError(f"{key} is a column of the result")
    index = build_index(docs, key=key, text=text, segment_words=segment_words)
    found = None
    for block in blocks_of(benchmark, key=item_key, text=item_text, block_bytes=block_bytes):
        part = phrase_matches(index, block, window)
        found = part if found is None else found.unionByName(part)
    rows = materialize(index.where("term is null").select("segment", "ordinal", "key", "n_words"), "documents")
    release(index)
    if found is None:
        hits = rows.withColumn("_spans", F.array().cast("array<struct<start:long,end:long>>")).withColumn("_items", F.array().cast("array<string>"))
    else:
        own = found.groupBy("segment", "ordinal").agg(
            F.array_sort(F.flatten(F.collect_list("spans"))).alias("_spans"),
            F.array_sort(F.collect_set("item_id")).alias("_items"),
        )
        hits = rows.join(own, ["segment", "ordinal"], "left")
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
        lambda a: a["n"],
    )
    n_hit = F.coalesce(covered, F.lit(0).cast("long"))
    return hits.select(
        F.col("key").alias(key),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")), 256).alias("items_sha256"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
