"""Contiguous byte-balanced shards from global prefix sums.

Only ``(key, size, checksum)`` leave the one scan, never the text. Rows are range-partitioned
by key once; each range gives one total; the totals' prefix sums (as many rows as ranges)
turn a running sum inside each range into a global byte offset and row number, and the
offsets are cut at equal targets. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_width

#: Rows that one range holds at about this many at most, for the sort inside it.
ROWS_PER_RANGE = 1_000_000


def global_offsets(rows: DataFrame, key: list[str], size: str, *, ranges: int | None = None) -> DataFrame:
    """Add ``byte_start`` and ``row_start``: bytes and rows before each row in key order.

    There are as many ranges as shuffle partitions, or more for ``ROWS_PER_RANGE``.
    ``rows`` holds the columns of ``key`` and the long column ``size``; other columns
    travel along and should be narrow. Null keys come first. Rows equal in every column
    of ``key`` take consecutive places in no fixed order. Ranges are cut by all key
    columns, so give enough of them to tell repeated leading keys apart. Also added are
    ``total_bytes`` and ``total_rows``. An empty input gives an empty result.
    """
    spark = rows.sparkSession
    n = ranges or max(shuffle_width(spark), -(-rows.count() // ROWS_PER_RANGE))
    order = [F.col(k).asc_nulls_first() for k in key]
    ranged = materialize(
        rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("_range").agg(F.sum(size).alias("_bytes"), F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    prefix = totals.select(
        "_range",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte0"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row0"),
        F.sum("_bytes").over(everything).alias("total_bytes"),
        F.sum("_rows").over(everything).alias("total_rows"),
    )
    inside = Window.partitionBy("_range").orderBy(*order)
    run = inside.rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_run", F.sum(size).over(run))
        .withColumn("_nth", F.row_number().over(inside).cast("long"))
        .join(F.broadcast(prefix), "_range")  # as many rows as there are ranges
        .withColumn("byte_start", F.col("_byte0") + F.col("_run") - F.col(size))
        .withColumn("row_start", F.col("_row0") + F.col("_nth") - 1)
        .drop("_range", "_run", "_nth", "_byte0", "_row0")
    )


def shard_by_bytes(
    docs: DataFrame, *, shards: int = 16, key: str = "doc_id", text: str = "text", ranges: int | None = None
) -> DataFrame:
    """Put every document into one of ``shards`` contiguous shards of near-equal bytes.

    Size is the text's UTF-8 bytes plus one (null text: 1). A row goes to the shard in
    which its middle byte falls, so a shard differs from its target by less than the
    largest row, shards are contiguous in key order, and no row is ever cut. ``slot``
    counts from 0 without gaps in each shard. Law: ``bytes``; ``grown_shard`` is null, as
    adding a shard moves the cuts.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard`` and the global
    ``byte_start``; columns of ``docs`` other than key and text are not read, so their
    names cannot clash. Null keys come first; repeated keys are ordered by size and
    checksum; identical rows are interchangeable. Fewer rows than shards leave shards
    empty. An empty table gives an empty result.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
    )
    # written first: the range partitioner looks at its input twice, which must not be the texts;
    # the number only parts rows that are equal in all else, however many there are
    narrow = materialize(narrow.withColumn("_any", F.monotonically_increasing_id()), "sizes")
    placed = global_offsets(narrow, ["doc_id", "size", "text_crc32", "_any"], "size", ranges=ranges)
    # the middle byte, in whole numbers; decimals, as shards * bytes may pass a long
    shard = F.expr(
        f"cast(byte_start + size div 2 as decimal(28,0)) * cast({int(shards)} as decimal(10,0)) "
        "div cast(total_bytes as decimal(28,0))"
    )
    placed = materialize(placed.withColumn("shard", F.least(shard.cast("int"), F.lit(shards - 1))), "placed")
    release(narrow)
    first = placed.groupBy("shard").agg(F.min("row_start").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # at most ``shards`` rows
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row_start") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "byte_start",
    )
