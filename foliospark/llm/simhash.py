"""SimHash near-duplicates: pivot distance tables discard pairs, survivors are verified.

Fingerprints are deduplicated first, so exact copies cost one row. Every distinct
fingerprint is dealt to pigeonhole buckets (two that differ in at most ``radius`` bits
agree on all bits of some ``blocks - radius`` of the ``blocks`` bit blocks), which keeps
the work far from all pairs without losing one. In a bucket the Hamming distances to
many reference fingerprints form a table; a pair whose largest coordinate difference
exceeds the radius cannot be close (triangle inequality) and is discarded. A bucket is
sorted by the first coordinate, so a row looks at those in a window of the radius only;
the other coordinates discard pairs in it; survivors are verified bit by bit. Buckets beyond ``bucket_rows`` are split into salted blocks of
rows of which every two meet in some task, so a hot bucket is spread and nothing is
capped. Tasks return spanning links, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, lean, materialize, new_column, release, ship, shuffle_width

SEED = 42
BITS = 64
#: Rows of a bucket that are compared in one piece; larger buckets are split.
BUCKET_ROWS = 2048
#: Reference fingerprints of the distance tables.
PIVOTS = 48


def fingerprint(text: str | None, words: int = 4) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words than
    a shingle is one shingle. A bit is 1 if set in over half the shingles' XXH64 values.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = len(parts)
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    body = memoryview(b" ".join(parts))
    lengths = np.fromiter(map(len, parts), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(body[a:b], SEED) for a, b in zip(starts[: n - words + 1].tolist(), ends[words - 1 :].tolist())],
        np.uint64,
    )
    return fingerprint_of(hashes)


def fingerprint_of(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: a bit is 1 if set in over half of them; none: 0."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):  # very long texts: a bounded piece at a time
        piece = hashes[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(piece, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, out: str, *, text: str = "text", words: int = 4) -> DataFrame:
    """``docs`` with the long column ``out``: the fingerprint's bits as a signed number."""
    ship(docs.sparkSession)

    @F.arrow_udf("long")
    @lean
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch), np.uint64, len(batch))
            yield pa.array(values.view(np.int64))

    return docs.withColumn(new_column(docs, out), signed.asNondeterministic()(F.col(text)))


def pivot_table(fingerprints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of every fingerprint (rows) to every pivot (columns), as bytes."""
    return np.bitwise_count(fingerprints[:, None] ^ pivots[None, :]).astype(np.int8)


def reference_fingerprints(n: int = PIVOTS) -> np.ndarray:
    """``n`` fixed pivots: XXH64 of the numbers from 0."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(n)], np.uint64)


def blocks_for(rows: int, radius: int) -> int:
    """Bit blocks such that a bucket of unrelated fingerprints holds about 16 rows at most."""
    for blocks in range(radius + 2, 4 * radius + 4):
        if rows / 2.0 ** (BITS * (blocks - radius) / blocks) <= 16:
            return blocks
    return 4 * radius + 4


def bucket_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - radius`` blocks."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(
    fingerprints: DataFrame, *, column: str = "fp", radius: int = 4, bucket_rows: int = BUCKET_ROWS, pivots: int = PIVOTS
) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct fingerprints at ``radius`` bits or fewer.

    Two fingerprints within the radius are connected by the links returned, which are
    themselves all within the radius; a pair may be represented by a path. Null
    fingerprints link with nothing.
    """
    spark = fingerprints.sparkSession
    ship(spark)
    fps = fingerprints.select(F.col(column).alias("fp")).where(F.col("fp").isNotNull())
    blocks = blocks_for(max(1, fps.count()), radius)
    masks = bucket_masks(radius, blocks)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    dealt = fps.select("fp", F.explode(keys).alias("bucket"))
    hot = (
        dealt.groupBy("bucket")
        .count()
        .where(F.col("count") > bucket_rows)
        .select("bucket", F.ceil(F.col("count") / bucket_rows).cast("int").alias("parts"))
    )
    # every row of a hot bucket goes to the pieces (its part, any part); any two parts share one piece
    own = F.pmod(F.xxhash64("fp"), F.col("parts").cast("long")).cast("int")
    pieces = (
        dealt.join(hot, "bucket", "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("own", own)
        .select("fp", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("fp", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("piece"))
    )
    table = reference_fingerprints(pivots)

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp, piece = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for b in batches:  # 16 bytes a row; a partition is one of many
            fp.append(b.column(0).to_numpy(zero_copy_only=False))
            piece.append(b.column(1).to_numpy(zero_copy_only=False))
        a, b = close_pairs(np.concatenate(fp).view(np.uint64), np.concatenate(piece), table, radius)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    width = max(shuffle_width(spark), 1)
    return pieces.repartition(width, "piece").mapInArrow(compare, "a long, b long")


def close_pairs(
    fp: np.ndarray, piece: np.ndarray, pivots: np.ndarray, radius: int, seen: dict[str, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links within the pieces: a window of the first pivot, the largest difference of all, then the bits.

    ``seen``, if given, gets the numbers of pairs in the windows, of those that the table
    leaves, and of those that are close.
    """
    first = pivot_table(fp, pivots[:1])[:, 0]
    order = np.lexsort((fp, first, piece))
    fp, piece = fp[order], piece[order]
    table = pivot_table(fp, pivots)
    few = min(8, len(pivots))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    counts = {"windows": 0, "left": 0, "close": 0}
    left, lag = np.arange(max(0, len(fp) - 1)), 1
    while len(left):
        left = left[left + lag < len(fp)]
        # in a piece the first coordinate ascends: beyond the first that is too far all are
        left = left[(piece[left] == piece[left + lag]) & (table[left + lag, 0] - table[left, 0] <= radius)]
        counts["windows"] += len(left)
        for i in range(0, len(left), 1 << 18):
            x = left[i : i + (1 << 18)]
            y = x + lag
            keep = np.abs(table[x, :few] - table[y, :few]).max(axis=1) <= radius
            x, y = x[keep], y[keep]
            keep = np.abs(table[x] - table[y]).max(axis=1) <= radius
            x, y = x[keep], y[keep]
            counts["left"] += len(x)
            keep = (np.bitwise_count(fp[x] ^ fp[y]) <= radius) & (fp[x] != fp[y])
            counts["close"] += int(keep.sum())
            if keep.any():
                found.append((fp[x[keep]], fp[y[keep]]))
        if sum(len(a) for a, _ in found) > 1 << 20:
            found = [spanning(found)]
        lag += 1
    if seen is not None:
        seen |= counts
    return spanning(found)


def spanning(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs given, out of these pairs."""
    if not pairs:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = find(x), find(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = 4, radius: int = 4,
    bucket_rows: int = BUCKET_ROWS, pivots: int = PIVOTS,
) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    ``component_id`` is the smallest key reachable over links of ``radius`` bits or fewer,
    the document's own included; if all keys reachable are null it is null. Null and empty
    texts have fingerprint zero and link like any other. Other columns of ``docs`` are not
    read. Repeated rows each give a row. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    marked = materialize(
        with_fingerprint(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "fp", words=words).select(
            "doc_id", "fp"
        ),
        "fingerprints",
    )
    low = marked.groupBy("fp").agg(F.min("doc_id").alias("low"))
    low = materialize(low, "distinct-fingerprints")
    found = links(low, radius=radius, bucket_rows=bucket_rows, pivots=pivots)
    roots = connected_components(found)
    grouped = low.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    answer = materialize(grouped.join(least, "root").select("fp", "component_id"), "classes")
    release(low)
    return marked.join(answer, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
