"""Packing documents into sequences: best fit, then swaps between underfull sequences.

Texts are encoded where they are scanned; what goes on is a narrow row for each piece. A
piece as long as a sequence is one. The others are dealt at random into groups of some
thirty thousand, each packed in one task: best fit in descending length, then a local search that
empties bins. Taking the emptiest bin, it moves a document to another underfull bin, or
exchanges one for one, two for one or one for two, such that the other bin gains; every
exchange increases the sum of squared fills. Bins that stay underfull meet those of other
groups in the next level, where the search goes on with the bins as they are, or with their
documents packed anew if that takes fewer.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, ship
from .token_store import library_codec

#: Tokens of a sequence.
CAPACITY = 1024
#: Pieces that a group has at about this many.
GROUP = 32768
#: Times that underfull bins are dealt anew: each level leaves less than a bin of free room a group where lengths allow it.
LEVELS = 3
#: Candidates that the search looks at for each piece of a group at most: it bounds time, every piece is packed in any case.
EFFORT = 400
#: The levels' place in a sequence's number, and the group's.
_LEVEL, _GROUP = 58, 20


class Bins:
    """Bins of one capacity and the items in them, by number."""

    def __init__(self, lengths: list[int], capacity: int = CAPACITY):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[dict[int, list[int]]] = []  # of a bin, by length
        self.fill: list[int] = []
        self.emptied = 0

    def put(self, item: int, bin_: int) -> None:
        while len(self.fill) <= bin_:
            self.items.append({})
            self.fill.append(0)
        n = self.lengths[item]
        self.items[bin_].setdefault(n, []).append(item)
        self.fill[bin_] += n

    def take(self, bin_: int, length: int) -> int:
        own = self.items[bin_]
        item = own[length].pop()
        if not own[length]:
            del own[length]
        self.fill[bin_] -= length
        return item

    def best_fit(self, items: list[int]) -> None:
        """Put items, longest first, into the bin with the least room that holds them."""
        room: dict[int, list[int]] = defaultdict(list)
        some = 0  # bit g: there are bins with room for g more
        for b, f in enumerate(self.fill):
            if 0 < f < self.capacity:
                room[self.capacity - f].append(b)
                some |= 1 << self.capacity - f
        for i in sorted(items, key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            wide = some >> n
            if wide:
                gap = n + (wide & -wide).bit_length() - 1
                b = room[gap].pop()
                if not room[gap]:
                    some ^= 1 << gap
            else:
                gap, b = self.capacity, len(self.fill)
            self.put(i, b)
            if gap > n:
                room[gap - n].append(b)
                some |= 1 << gap - n

    def free(self) -> int:
        """Free room of all underfull bins."""
        return sum(self.capacity - f for f in self.fill if 0 < f < self.capacity)

    def improve(self, effort: int) -> None:
        """Empty bins by exchanges until none helps, no whole bin of room is free, or ``effort`` candidates were looked at."""
        free = self.free()
        changed = True
        while changed and free >= self.capacity and effort > 0:
            changed = False
            search = _Search(self, effort)
            for donor in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=self.fill.__getitem__):
                if free < self.capacity or search.effort <= 0:
                    break
                if self.fill[donor] == self.capacity:
                    continue
                search.hide(donor)
                while self.fill[donor] and (found := search.best(donor)):
                    search.exchange(donor, *found)
                    changed = True
                if self.fill[donor]:
                    search.show(donor)
                else:
                    free -= self.capacity
                    self.emptied += 1
            effort = search.effort

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        """Each item's bin and offset there; bins that hold anything are numbered from 0."""
        bins, offsets = np.zeros(len(self.lengths), np.int64), np.zeros(len(self.lengths), np.int64)
        for number, own in enumerate(o for o in self.items if o):
            at = 0
            for item in sorted(i for some in own.values() for i in some):
                bins[item], offsets[item] = number, at
                at += self.lengths[item]
        return bins, offsets


class _Search:
    """Underfull bins by what they can take in: giving away ``v``, a bin of room g can take v + g.

    The first table of heaps has what bins give away as nothing or one item, the second as
    two; a heap has those of one v + g, the least given away, which is the largest gain,
    first. Entries of bins that have changed since are passed over.
    """

    def __init__(self, bins: Bins, effort: int):
        self.bins, self.effort = bins, effort
        self.version = [0] * len(bins.fill)
        self.heaps: tuple[dict, dict] = ({}, {})
        self.some = [0, 0]
        for b, f in enumerate(bins.fill):
            if 0 < f < bins.capacity:
                self.show(b)

    def hide(self, bin_: int) -> None:
        self.version[bin_] += 1

    def show(self, bin_: int) -> None:
        """Enter a bin as it is now."""
        self.version[bin_] += 1
        gap, own = self.bins.capacity - self.bins.fill[bin_], self.bins.items[bin_]
        if not gap or not own:
            return
        self._enter(0, gap, 0, bin_, ())
        for v in own:
            self._enter(0, gap + v, v, bin_, (v,))
        for v, w in combinations_with_replacement(sorted(own), 2):
            if v != w or len(own[v]) > 1:
                self._enter(1, gap + v + w, v + w, bin_, (v, w))

    def _enter(self, kind: int, reach: int, given: int, bin_: int, lengths: tuple[int, ...]) -> None:
        heappush(self.heaps[kind].setdefault(reach, []), (given, bin_, self.version[bin_], lengths))
        self.some[kind] |= 1 << reach

    def best(self, donor: int) -> tuple[tuple[int, ...], int, tuple[int, ...]] | None:
        """What the donor gives, to which bin and for what: the exchange that leaves the least room, then moves the most."""
        own = self.bins.items[donor]
        out, least = None, (self.bins.capacity + 1, 0)
        for n in sorted(own, reverse=True):
            for kind in (0, 1):
                out, least = self._look(kind, n, (n,), donor, out, least)
        for v, w in combinations_with_replacement(sorted(own), 2):
            if (v != w or len(own[v]) > 1) and v + w <= self.bins.capacity:
                out, least = self._look(0, v + w, (v, w), donor, out, least)
        return out

    def _look(self, kind: int, n: int, lengths: tuple[int, ...], donor: int, out, least: tuple[int, int]):
        heaps, fill = self.heaps[kind], self.bins.fill
        reach = n
        while (wide := self.some[kind] >> reach) and self.effort > 0:
            reach += (wide & -wide).bit_length() - 1
            if reach - n > least[0]:
                break
            heap = heaps[reach]
            while heap and self.version[heap[0][1]] != heap[0][2]:
                heappop(heap)
            self.effort -= 1
            if not heap:
                self.some[kind] ^= 1 << reach
                continue
            given, bin_, _, back = heap[0]
            gain = n - given
            # more in the other bin than the donor had before: the sum of squares grows; two moved alone are two moves
            if gain > 0 and fill[bin_] + gain > fill[donor] and (len(lengths) < 2 or back) and (reach - n, -gain) < least:
                out, least = (lengths, bin_, back), (reach - n, -gain)
            reach += 1
        return out, least

    def exchange(self, donor: int, lengths: tuple[int, ...], bin_: int, back: tuple[int, ...]) -> None:
        there = [self.bins.take(donor, n) for n in lengths]
        here = [self.bins.take(bin_, n) for n in back]
        for i in there:
            self.bins.put(i, bin_)
        for i in here:
            self.bins.put(i, donor)
        self.show(bin_)


def pieces(
    docs: DataFrame, tokenizer_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Every document's ids, cut to pieces; a stored table.

    ``row, doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (binary,
    little-endian unsigned 32-bit). A null text is empty; ``end_id`` ends each document, so
    none is without ids. Only documents of more than ``capacity`` ids are cut: all pieces
    but the first are full. ``row`` is a number of the piece's own.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(tokenizer_path, pattern)
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            of, piece, start, length, crc, raw = [], [], [], [], [], []
            for at, t in enumerate(b.column(1)):
                ids = np.frombuffer(codec.encode(t.as_py() or ""), codec.dtype).astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n, low, nth = len(ids) // 4, 0, 0
                while low < n:
                    high = low + ((n - low - 1) % capacity + 1)
                    own = ids if high - low == n else ids[4 * low : 4 * high]
                    of.append(at)
                    piece.append(nth)
                    start.append(low)
                    length.append(high - low)
                    crc.append(zlib.crc32(own))
                    raw.append(own if with_ids else b"")
                    low, nth = high, nth + 1
            columns = [pa.array(range(row, row + len(of)), pa.int64()), b.column(0).take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            row += len(of)
            yield pa.RecordBatch.from_arrays(columns + [pa.array(raw, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)

    schema = f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return materialize(docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(encode, schema), "pieces")


def _packed(level: int, capacity: int) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        group = table.column("part")[0].as_py()
        lengths, before = table.column("length").to_pylist(), table.column("sequence_id").to_pylist()
        bins = Bins(lengths, capacity)
        bins.best_fit(list(range(len(lengths))))
        if before[0] is not None and len(set(before)) <= len(bins.fill):  # as they were is no worse than from anew
            bins, numbers = Bins(lengths, capacity), {}
            for i, s in enumerate(before):
                bins.put(i, numbers.setdefault(s, len(numbers)))
        bins.improve(EFFORT * len(lengths))
        place, offset = bins.places()
        full = np.bincount(place, weights=bins.lengths)[place] >= capacity
        out = table.drop_columns(["part", "sequence_id", "offset", "open"])
        sequence = pa.array((level << _LEVEL) + (group << _GROUP) + place)
        return out.append_column("sequence_id", sequence).append_column("offset", pa.array(offset)).append_column("open", pa.array(~full))

    return run


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, levels: int = LEVELS) -> DataFrame:
    """Put pieces into as few sequences of at most ``capacity`` as the search finds.

    ``pieces`` has ``row`` (distinct, from 0, under 2**58) and ``length`` (1 to
    ``capacity``), and is a stored table, as it is read for every level; its other columns
    stay. Added are ``sequence_id`` (any numbers) and ``offset``, gapless from 0 in each
    sequence. No pieces, no rows. Which of several equal packings comes out depends on
    ``row`` alone.
    """
    ship(pieces.sparkSession)
    extra = {"sequence_id", "offset", "open", "part"} & {c.lower() for c in pieces.columns}
    if extra:
        raise ValueError(f"there are columns {sorted(extra)} already")
    none = lambda t: F.lit(None).cast(t)
    done = pieces.where(F.col("length") == capacity).select(*pieces.columns, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = pieces.where(F.col("length") < capacity).select(*pieces.columns, none("long").alias("sequence_id"), none("long").alias("offset"), F.lit(True).alias("open"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, open boolean"
    for level in range(1, levels + 1):
        n, free = left.agg(F.count("*"), F.sum(F.col("length"))).first()
        if level > 1:
            bins = left.select("sequence_id").distinct().count()
            if bins * capacity - (free or 0) < capacity:  # no room for one bin less
                break
        parts = -(-n // group) if n else 1
        dealt = left.withColumn("part", F.pmod(F.xxhash64(F.coalesce("sequence_id", "row"), F.lit(level)), F.lit(parts)))
        packed = materialize(dealt.groupBy("part").applyInArrow(_packed(level, capacity), kinds), "packed")
        done = done.unionByName(packed.where(~F.col("open")).drop("open"))
        left = packed.where("open")
        if parts == 1:
            break
    return done.unionByName(left.drop("open"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts`` of packed pieces with ``ids``: what a trainer reads.

    ``ids`` are a sequence's ids end to end, ``starts`` where each of its documents begins.
    A sequence has at most one capacity of ids, so no group is large.
    """
    own = F.array_sort(F.collect_list(F.struct("offset", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select(
        "sequence_id",
        F.unhex(F.array_join(F.transform("p", lambda p: F.hex(p["ids"])), "")).alias("ids"),
        F.col("p.doc_id").alias("doc_ids"),
        F.col("p.offset").alias("starts"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    See :func:`pieces` and :func:`pack`. Null texts are documents of the end id alone,
    repeated rows are documents of their own, null keys stay null; other columns are not
    read, so none can clash. An empty table gives no rows.
    """
    cut = pieces(docs, tokenizer_path, pattern, key=key, text=text, end_id=end_id, capacity=capacity)
    return pack(cut, capacity=capacity).drop("row")
