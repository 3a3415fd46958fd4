"""Near-duplicate vectors: inverted lists, product-quantised residuals, exact rerank.

A coarse quantiser of two levels, learned from a bounded sample, deals every distinct
vector to one inverted list of its number of dimensions and codes its residual in
subspaces. A vector also visits every list whose border (the plane half-way between two
centroids) is nearer than ``margin``. In a list asymmetric table look-ups give the
distance to each coded member; a member is passed to the exact cosine only if that
distance is no more than the radius plus the member's own coding error, which no true
partner fails. Of two vectors within a radius r the border between their lists is at most
r / 2 from one of them; noise in many dimensions lies mostly along the border, so the
default margin of some r / 3 finds nearly all pairs (recall is measured in the tests).
Lists under a top centroid that is farther off than twice the margin are not looked at.

Neighbouring lists make a unit of about ``block`` members, and a vector goes once to each
unit that it belongs to or visits, not once to every list. Copies are one vector with a
count. Lists beyond ``block`` members are split into parts in which every member meets
every member and visitor, so no task grows with a hot list, and nothing is capped. Tasks
return counts and spanning links, never pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release, ship

#: Vectors, in expectation, from which the quantisers are learned; more where there are more lists: some of each.
SAMPLE, SAMPLE_PER_LIST = 20_000, 8
#: Inverted lists are this many times the root of the number of vectors.
LISTS = 2.0
SUBSPACES = 16
CODES = 32
#: Distance to a list's border up to which the list is visited.
MARGIN = 0.1
#: Members of a unit, and of its visitors four times as many, that meet in one task.
BLOCK = 4096
#: Rows that ask at once; pairs that are reranked one by one, beyond which whole rows are multiplied.
ASKING, FEW_PAIRS = 512, 1 << 15


class Quantiser(NamedTuple):
    """Coarse centroids (sorted by their top centroid), where each top's begin, and residual codebooks."""

    tops: np.ndarray
    starts: np.ndarray
    centroids: np.ndarray
    books: list[np.ndarray]
    cuts: list[int]

    def assign(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The home list of every row, and the other lists that it visits.

        Looked at are the lists of the nearest top centroid and of those whose border is
        nearer than twice the margin.
        """
        d = _distances(x, self.tops)
        top = d.argmin(1)
        near = _borders(d, top, self.tops) <= 2 * margin
        home, visits = np.zeros(len(x), np.int64), [np.empty(0, np.int64)] * len(x)
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            some = near[rows].any(0)
            some[t] = True
            lists = np.concatenate([np.arange(self.starts[i], self.starts[i + 1]) for i in np.flatnonzero(some)])
            owner = np.searchsorted(self.starts, lists, "right") - 1
            c = self.centroids[lists]
            d = _distances(x[rows], c)
            d[~(near[rows][:, owner] | (owner == t)[None, :])] = np.inf
            own = d.argmin(1)
            home[rows] = lists[own]
            close = _borders(d, own, c) <= margin
            close[np.arange(len(rows)), own] = False
            at, which = np.nonzero(close)
            for r, v in zip(rows.tolist(), np.split(lists[which], np.searchsorted(at, np.arange(1, len(rows))))):
                visits[r] = v
        return home, visits

    def encode(self, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals, and the lengths of what the codes leave out."""
        codes = np.empty((len(residual), len(self.books)), np.uint8)
        left = np.zeros(len(residual))
        for m, book in enumerate(self.books):
            part = residual[:, self.cuts[m] : self.cuts[m + 1]]
            codes[:, m] = _distances(part, book).argmin(1)
            left += np.maximum(((part - book[codes[:, m]]) ** 2).sum(1), 0)
        return codes, np.sqrt(left)

    def tables(self, residual: np.ndarray) -> list[np.ndarray]:
        """Squared distances of queries' residuals to every code, by subspace."""
        return [_distances(residual[:, self.cuts[m] : self.cuts[m + 1]], book) for m, book in enumerate(self.books)]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def _borders(d: np.ndarray, own: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distance of every row to the plane between its own centroid and each other one, from squared distances."""
    some, at = np.unique(own, return_inverse=True)
    apart = np.sqrt(_distances(c[some], c))[at]
    return (d - d[np.arange(len(d)), own][:, None]) / np.maximum(2 * apart, 1e-12)


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; centroids that lose all their rows stay where they are."""
    c = x[rng.permutation(len(x))[: max(1, min(k, len(x)))]].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def train(x: np.ndarray, lists: int, *, subspaces: int = SUBSPACES, codes: int = CODES, seed: int = 7) -> Quantiser:
    """Learn coarse centroids on two levels, and residual codebooks, from unit vectors."""
    rng = np.random.default_rng(seed)
    tops = _means(x, round(math.sqrt(lists)), 6, rng)
    top = _distances(x, tops).argmin(1)
    below = [_means(x[top == t], max(1, round(lists * (top == t).mean())), 6, rng) if (top == t).any() else tops[t : t + 1] for t in range(len(tops))]
    starts = np.cumsum([0, *map(len, below)])
    centroids = np.concatenate(below)
    residual = x - centroids[np.concatenate([_distances(p, centroids).argmin(1) for p in np.array_split(x, -(-len(x) // 4096))])]
    subspaces = min(subspaces, x.shape[1])
    cuts = [round(i * x.shape[1] / subspaces) for i in range(subspaces + 1)]
    books = [_means(residual[:, a:b], codes, 6, rng) for a, b in zip(cuts, cuts[1:])]
    return Quantiser(tops, starts, centroids, books, cuts)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    v = _matrix(column).astype(np.float64)
    return v / np.sqrt((v * v).sum(1))[:, None]


def classes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of linked pairs every node but the least of its class, with that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        for ends in (x, y, before[x], before[y]):
            np.minimum.at(root, ends, low)
        root = root[root]
        if (root == before).all():
            break
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


class _Piece:
    """Members and visitors of a unit, or of two parts of it, that meet in one task.

    Rows have ``cid, copies, v, home, visits, codes, left, part``; a visitor's part is
    null and its visits are those in the unit.
    """

    def __init__(self, quantiser: Quantiser, offset: int, table: pa.Table, threshold: float):
        self.q, self.offset, self.threshold = quantiser, offset, threshold
        self.radius = math.sqrt(max(0.0, 2 - 2 * threshold))
        self.cid, self.copies = table.column("cid").to_numpy(), table.column("copies").to_numpy()
        self.v, self.home = _unit(table.column("v")), table.column("home").to_numpy()
        part = table.column("part")
        self.member = np.flatnonzero(part.is_valid().to_numpy(zero_copy_only=False))
        self.part = part.fill_null(-1).to_numpy()
        visits = table.column("visits").combine_chunks()
        self.visitor = np.repeat(np.arange(len(self.cid)), visits.value_lengths().fill_null(0).to_numpy())
        self.visited = visits.flatten().to_numpy()
        members = table.take(pa.array(self.member))
        self.codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(self.member), len(quantiser.books)).astype(np.int64)
        self.left = members.column("left").to_numpy()
        # which member visits which list, to look up
        self.lists = int(max(self.home.max(initial=0), self.visited.max(initial=0))) + 1
        self.both = np.sort(self.visitor * self.lists + self.visited)
        self.linked = np.zeros(len(self.cid), np.int64)
        self.found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

    def _visits(self, row: np.ndarray, of: np.ndarray) -> np.ndarray:
        key = row[None, :] * self.lists + of[:, None]
        at = np.minimum(np.searchsorted(self.both, key), max(0, len(self.both) - 1))
        return self.both[at] == key if len(self.both) else np.zeros(key.shape, bool)

    def run(self, low: int, high: int, group: int) -> None:
        """Compare: in group 0 the members with each other, in all groups with the visitors."""
        order = np.argsort(self.home[self.member], kind="stable")
        homes = self.home[self.member][order]
        for here in np.unique(homes).tolist():
            at = order[np.searchsorted(homes, here) : np.searchsorted(homes, here, "right")]
            members = self.member[at]
            if low != high:
                self._ask(here, members[self.part[members] == low], at[self.part[members] == high], lambda a, b: None)
                continue
            if group == 0:
                self._ask(here, members, at, lambda a, b: self.cid[a][:, None] < self.cid[b][None, :])
            asking = self.visitor[self.visited == here]
            asking = asking[(self.part[asking] < 0) | (group == 0)]
            # both visit the other's list: only the list of the smaller number counts the pair
            self._ask(here, asking, at, lambda a, b, here=here: (here < self.home[a])[:, None] | ~self._visits(b, self.home[a]))

    def _ask(self, here: int, asking: np.ndarray, at: np.ndarray, rule) -> None:
        members = self.member[at]
        if not len(members):
            return
        codes, reach = self.codes[at], (self.radius + self.left[at] + 1e-9) ** 2
        for i in range(0, len(asking), ASKING):
            a = asking[i : i + ASKING]
            d = np.zeros((len(a), len(at)))
            for m, t in enumerate(self.q.tables(self.v[a] - self.q.centroids[here - self.offset])):
                d += t[:, codes[:, m]]
            near = d <= reach[None, :]
            allowed = rule(a, members)
            if allowed is not None:
                near &= allowed
            x, y = np.nonzero(near)
            if len(x) <= FEW_PAIRS:
                same = (self.v[a[x]] * self.v[members[y]]).sum(1) >= self.threshold
            else:
                same = (self.v[a] @ self.v[members].T)[x, y] >= self.threshold
            x, y = a[x[same]], members[y[same]]
            self.linked += np.bincount(x, self.copies[y], len(self.cid)).astype(np.int64) + np.bincount(y, self.copies[x], len(self.cid)).astype(np.int64)
            if len(x):
                for own, more in zip(self.found, classes(self.cid[x], self.cid[y])):
                    own.append(more)

    def rows(self) -> pa.Table:
        a, b = (np.concatenate(f) for f in self.found)
        a, b = classes(a, b)
        some = np.flatnonzero(self.linked)
        return pa.table(
            {
                "a": pa.array(np.concatenate([self.cid[some], a])),
                "b": pa.array([*[None] * len(some), *b.tolist()], pa.int64()),
                "n": pa.array([*self.linked[some].tolist(), *[None] * len(a)], pa.int64()),
            }
        )


class Index(NamedTuple):
    """A quantiser for each number of dimensions, and the number of its first list."""

    quantisers: dict[int, Quantiser]
    offsets: dict[int, int]


def learn(distinct: DataFrame, sizes: dict[int, int], lists: int | None, sample: int) -> Index:
    """Quantisers from a sample by hash: at most some ``sample`` or ``SAMPLE_PER_LIST`` vectors a list, in expectation."""
    wanted = {dim: lists or max(1, round(LISTS * math.sqrt(n))) for dim, n in sizes.items()}
    total = sum(sizes.values())
    rate = {dim: max(sample / total, SAMPLE_PER_LIST * wanted[dim] / n) for dim, n in sizes.items()}
    share = F.element_at(F.create_map(*[F.lit(x) for kv in rate.items() for x in kv]), F.col("dim"))
    unit = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / (1 << 30)
    picked: dict[int, list] = {dim: [] for dim in sizes}
    for r in distinct.where(unit < share).select("dim", "v").toLocalIterator():
        picked[r["dim"]].append(np.array(r["v"], np.float64))
    quantisers, offsets, at = {}, {}, 0
    for dim in sorted(sizes):
        x = np.stack(picked[dim]) if picked[dim] else np.eye(1, dim)  # any centroid will do for a few vectors
        quantisers[dim] = train(x / np.sqrt((x * x).sum(1))[:, None], wanted[dim])
        offsets[dim], at = at, at + len(quantisers[dim].centroids)
    return Index(quantisers, offsets)


def units_of(members: list[int], tops: list[int], block: int) -> tuple[list[int], list[int]]:
    """Unit and number of parts of each list: neighbours under one top up to ``block`` members, larger lists alone."""
    unit, parts, held, last = [], [], 0, None
    for m, top in zip(members, tops):
        if not unit or top != last or held + m > block:
            unit.append(unit[-1] + 1 if unit else 0)
            held = 0
        else:
            unit.append(unit[-1])
        held, last = held + m, top
        parts.append(max(1, -(-m // block)))
    return unit, parts


def near_duplicate_vectors(
    vectors: DataFrame, *, key: str = "vec_id", column: str = "embedding", threshold: float = 0.95, lists: int | None = None,
    margin: float = MARGIN, sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Links are pairs of vectors of equal length whose cosine is at least ``threshold`` in
    double precision. Vectors that are null, empty, zero, or hold null or non-finite
    components link with nothing. ``n_links`` counts the other vectors linked directly,
    copies one by one; ``component_id`` is the smallest key reachable, a lone vector's own.
    Repeated rows are vectors of their own. Other columns are not read. An empty table
    gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.col("v")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate(e, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(column).alias("v")).withColumn(
        "ok", F.coalesce(finite, F.lit(False)) & F.coalesce(length > 0, F.lit(False))
    )
    # two hashes name a vector, so that only distinct vectors travel
    named = lambda i: F.when(F.col("ok"), F.xxhash64(F.lit(i), "v"))
    rows = rows.withColumns({"h1": named(1), "h2": named(2), "dim": F.when(F.col("ok"), F.size("v"))})
    distinct = rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v"))
    distinct = materialize(distinct.withColumn("cid", F.monotonically_increasing_id()), "distinct-vectors")
    sizes = {r["dim"]: r["count"] for r in distinct.groupBy("dim").count().collect()}  # a row for each length
    alone = rows.where(~F.col("ok")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    if not sizes:
        return alone
    trained = learn(distinct, sizes, lists, sample)
    shared = spark.sparkContext.broadcast(trained)  # centroids: the root of the number of vectors

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantisers, offsets = shared.value
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                q = quantisers[dim]
                for i in range(0, own.num_rows, 2048):
                    s = own.slice(i, 2048)
                    v = _unit(s.column("v"))
                    home, visits = q.assign(v, margin)
                    codes, left = q.encode(v - q.centroids[home])
                    yield pa.RecordBatch.from_arrays(
                        [
                            s.column("cid"), s.column("copies"), s.column("v"), s.column("dim"), pa.array(home + offsets[dim], pa.int32()),
                            pa.array([x + offsets[dim] for x in visits], pa.list_(pa.int32())), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(left),
                        ],
                        names=["cid", "copies", "v", "dim", "home", "visits", "codes", "left"],
                    )

    kind = distinct.schema["v"].dataType.simpleString()
    schema = f"cid long, copies long, v {kind}, dim int, home int, visits array<int>, codes binary, left double"
    indexed = materialize(distinct.select("cid", "copies", "v", "dim").mapInArrow(index, schema), "inverted-lists")
    held = {r["home"]: r["count"] for r in indexed.groupBy("home").count().collect()}  # a row for each list
    tops, members = [], []
    for dim in sorted(sizes):
        q = trained.quantisers[dim]
        for i in range(len(q.centroids)):
            tops.append((dim, int(np.searchsorted(q.starts, i, "right"))))
            members.append(held.get(trained.offsets[dim] + i, 0))
    unit, parts = units_of(members, tops, block)
    of_list = spark.createDataFrame([(i, u, p) for i, (u, p) in enumerate(zip(unit, parts))], "list int, unit int, parts int")
    # a visitor's lists by unit; its own unit needs no row of it, unless its list is split
    visit = indexed.select("cid", "copies", "v", "home", F.explode("visits").alias("list")).join(F.broadcast(of_list), "list")  # a row for each list
    own = of_list.select(F.col("list").alias("home"), F.col("unit").alias("own"))
    visit = visit.join(F.broadcast(own), "home").where("unit != own").select("cid", "list", "unit", "parts").groupBy("cid", "unit", "parts").agg(F.collect_list("list").alias("visits"))
    visit = materialize(visit, "visits")
    askers = visit.groupBy("unit").agg(F.ceil(F.count("*") / (4 * block)).cast("int").alias("groups"))
    of_unit = of_list.groupBy("unit").agg(F.max("parts").alias("parts")).join(askers, "unit", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
    numbers = lambda k: F.sequence(F.lit(0), k - 1)
    piece = lambda low, high, group: F.struct(low.cast("int").alias("low"), high.cast("int").alias("high"), group.cast("int").alias("group"))
    # members: their part with every part, and their part with every further group of visitors
    home = indexed.join(F.broadcast(of_list.select(F.col("list").alias("home"), "unit")), "home").join(F.broadcast(of_unit), "unit")
    home = home.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts").cast("long")).cast("int")).withColumn(
        "at",
        F.concat(
            F.transform(numbers(F.col("parts")), lambda p: piece(F.least(p, F.col("part")), F.greatest(p, F.col("part")), F.lit(0))),
            F.transform(F.slice(numbers(F.col("groups")), 2, 1 << 30), lambda g: piece(F.col("part"), F.col("part"), g)),
        ),
    )
    visiting = visit.drop("parts").join(indexed.select("cid", "copies", "v", "dim", "home"), "cid").join(F.broadcast(of_unit), "unit").withColumns(
        {"part": F.lit(None).cast("int"), "codes": F.lit(None).cast("binary"), "left": F.lit(None).cast("double")}
    )
    visiting = visiting.withColumn("at", F.transform(numbers(F.col("parts")), lambda p: piece(p, p, F.pmod(F.xxhash64("cid"), F.col("groups").cast("long")))))
    columns = ["cid", "copies", "v", "dim", "home", "visits", "codes", "left", "unit", "part"]
    pieces = home.select(*columns, F.explode("at").alias("at")).unionByName(visiting.select(*columns, F.explode("at").alias("at"))).select(*columns, "at.*")

    def search(table: pa.Table) -> pa.Table:
        dim, low, high, group = (table.column(c)[0].as_py() for c in ("dim", "low", "high", "group"))
        p = _Piece(shared.value.quantisers[dim], shared.value.offsets[dim], table, threshold)
        p.run(low, high, group)
        return p.rows()

    links = materialize(pieces.groupBy("unit", "low", "high", "group").applyInArrow(search, "a long, b long, n long"), "links")
    roots = connected_components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "cid")
    linked = links.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    classed = distinct.select("cid", "low", "copies", "h1", "h2").join(linked, "cid", "left").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = classed.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = classed.join(least, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    answer = materialize(answer, "classes")
    release(distinct, indexed, visit, links)
    found = rows.where("ok").select("vec_id", "h1", "h2").join(answer, ["h1", "h2"]).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
    return found.unionByName(alone)
