"""What the operators of this subpackage share: workspace tables, shipping, components.

Intermediate results that several jobs read are written as Parquet tables in the
shared folder named by ``spark.checkpoint.dir``: a lost executor costs the tasks it
ran, never a recomputation with another order of rows, and nothing lives on one
machine alone.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that a Python worker is given at once, and rows that a Parquet reader decodes at once: texts may be long.
BATCH_BYTES, READER_ROWS = 2 << 20, 256
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_DIRS: dict[str, str] = {}
_SHIPPED: set[str] = set()


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    ``spark.checkpoint.dir`` as the session gives it. Only where it is unset and one
    machine runs everything (tests) a temporary folder is made and set as the checkpoint
    directory; on a cluster that is an error, as machines do not see each other's.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_DIRS:
            _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="foliospark-")
            spark.sparkContext.setCheckpointDir(_LOCAL_DIRS[app])
        root = "file://" + _LOCAL_DIRS[app]
    return f"{root.rstrip('/')}/foliospark/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the workspace."""
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a path of any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear_workspace(spark: SparkSession) -> None:
    """Delete all that this application's queries stored; results not yet written are lost."""
    delete(spark, workspace(spark))


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within the block the session has the setting; afterwards it is as before."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


#: Options of a write of rows of megabytes: a row group each, as a writer holds a group, and a reader decodes one, at once.
LONG_ROWS = {"parquet.block.row.count.limit": "1"}


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the workspace and read it back: cuts the lineage, fixes the rows.

    The shuffle files of the write go when it is done.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with setting(spark, _CLEANUP, "true"):
        df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for t in tables:
        delete(t.sparkSession, t._stored_at)


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def new_column(docs: DataFrame, name: str) -> str:
    """``name``, unless ``docs`` has such a column already: that is an error, as it would be replaced."""
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")
    return name


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not have it installed.

    Also bounds what is decoded, and what goes to a Python worker, at once, as rows may be
    long: unless the session has bounds of its own, it keeps these.
    """
    own = spark.conf.getAll
    for bound, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READER_ROWS)):
        if bound not in own:
            spark.conf.set(bound, value)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    archive = os.path.join(tempfile.mkdtemp(prefix="foliospark-ship-"), f"{package}_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def trim() -> None:
    """Give memory that is free back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def lean(f: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """``f``, a task's generator, that trims the worker's memory when it ends."""

    @wraps(f)
    def run(*given):
        try:
            yield from f(*given)
        finally:
            trim()

    return run


#: Bits of the bitmap by which rows are picked before they are shuffled.
BITMAP = 1 << 25


def with_held(table: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """``table`` with the boolean ``out``: false only where ``names`` surely lacks the long in ``column``.

    By a bitmap of 4 MB at most, whatever the number of names.
    """
    place = F.pmod(F.col(column), F.lit(BITMAP)) + 1
    bits = names.select(place.alias("_p")).groupBy(F.bitmap_bucket_number("_p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte.cast("long"), (at % 8).cast("int")) == 1, F.lit(False))
    marked = table.withColumn("_bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_bucket", "left")
    return marked.select(*table.columns, held.alias(out))


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating star contraction.

    ``edges`` has two non-null orderable columns ``a`` and ``b`` of one type, in either
    orientation, repeated or self-looping as they come. The result has one row
    ``(node, root)`` per node that occurs in an edge between two different nodes; ``root``
    is the smallest node of its component.

    Each round is two grouped minimums and two joins, so a node with very many
    neighbours is pre-aggregated before the shuffle and its join partition can be split;
    no neighbour list is ever gathered. The number of rounds is logarithmic in the size
    of the largest component. No edges: an empty result.
    """
    e = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    for _ in range(max_rounds):
        if _settled(e):
            break
        e, last = materialize(_small_star(_large_star(e)), "edges"), e
        release(last)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def partial_components(edges: DataFrame, *, rounds: int = 2) -> DataFrame:
    """``(node, root)`` as :func:`connected_components` after a few rounds: nodes of one root are connected.

    Connected nodes may still have several roots. Nodes that are not larger than another
    in a remaining edge have no row: they are their own root.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        e, last = materialize(_small_star(_large_star(e)), "edges"), e
        release(last)
    return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, which has none itself: stars around the smallest of each component."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up > 0 and down > 0)").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest in its neighbourhood."""
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where(F.col("v") > F.col("u"))
        .join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, to the smallest of them."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = low.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where(F.col("u") != F.col("v")).distinct()
