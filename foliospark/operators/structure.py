"""From styled lines and tables of contents to chapters, sections and heading groups.

All tables hold many books; order is explicit (``line_no``, ``pos``), so every step is a
window or an aggregate by book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import UNKNOWN
from .sizes import broadcast_if_small


def body_size(lines: DataFrame) -> DataFrame:
    """``book_title, body_size``: the size of most lines; ties go to the size seen first."""
    counted = lines.groupBy("book_title", "size").agg(F.count("*").alias("n"), F.min(F.struct("page_number", "line_no")).alias("first"))
    return counted.groupBy("book_title").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "first")).alias("body_size"))


def heading_level(ratio: F.Column) -> F.Column:
    """``chapter`` from 1.5 times the body size on, ``section`` from 1.2 on, else null."""
    return F.when(ratio >= 1.5, "chapter").when(ratio >= 1.2, "section")


def heading_levels(lines: DataFrame, *, page_offset: int = 0) -> DataFrame:
    """``lines`` with ``level``; pages are shifted by ``page_offset``."""
    sized = lines.join(body_size(lines), "book_title")
    return sized.withColumn("level", heading_level(F.col("size") / F.col("body_size"))).withColumn(
        "page_number", F.col("page_number") + page_offset
    ).drop("body_size")


def heading_groups(levelled: DataFrame) -> DataFrame:
    """``book_title, group_index, chapter, section, page_number, text``: runs of body lines between headings.

    A chapter heading resets the section; of consecutive headings of one level the last
    counts; runs without lines make no group; the page is that of the first body line.
    """
    order = Window.partitionBy("book_title").orderBy("page_number", "line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    is_chapter, is_section = F.col("level") == "chapter", F.col("level") == "section"
    marked = (
        levelled.withColumn("chapter", F.coalesce(F.last(F.when(is_chapter, F.col("text")), ignorenulls=True).over(upto), F.lit(UNKNOWN)))
        .withColumn("section", F.coalesce(F.last(F.when(is_chapter, F.lit(UNKNOWN)).when(is_section, F.col("text")), ignorenulls=True).over(upto), F.lit(UNKNOWN)))
        .withColumn("island", F.sum(F.when(F.col("level").isNotNull(), 1).otherwise(0)).over(upto))
    )
    place = F.struct("page_number", "line_no")
    groups = marked.where("level is null").groupBy("book_title", "island").agg(
        F.first("chapter").alias("chapter"),
        F.first("section").alias("section"),
        F.min_by("page_number", place).alias("page_number"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "text"))), lambda s: s["text"]), " ").alias("text"),
    )
    nth = Window.partitionBy("book_title").orderBy("island")
    return groups.withColumn("group_index", F.row_number().over(nth) - 1).select(
        "book_title", "group_index", "chapter", "section", "page_number", "text"
    )


def toc_ranges(toc: DataFrame, pages: DataFrame) -> DataFrame:
    """``book_title, pos, title, start_page, end_page, level`` of TOC entries.

    An entry ends on the page before the next entry at its own or a shallower level, or
    with the book (``pages``: ``book_title, n_pages``), but never before it starts: one
    window for each level that occurs, no look-up of every pair.
    """
    levels = sorted(r[0] for r in toc.select("level").distinct().collect())  # a TOC's depth
    ahead = Window.partitionBy("book_title").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    following = F.lit(None).cast("int")
    for level in levels:
        start = F.first(F.when(F.col("level") <= level, F.col("start_page")), ignorenulls=True).over(ahead)
        following = F.when(F.col("level") == level, start).otherwise(following)
    ended = toc.withColumn("_next", following).join(pages, "book_title", "left")
    return ended.select(
        "book_title", "pos", "title", "start_page",
        F.greatest(F.coalesce(F.col("_next") - 1, "n_pages"), F.col("start_page")).alias("end_page"), "level",
    )


def heading_ranges(levelled: DataFrame, pages: DataFrame) -> DataFrame:
    """Chapter ranges from chapter headings, for books without a TOC; all are of level 1.

    Ends on the page before the next heading, or with the book. Not clamped: two headings
    on one page give the first an end before its start.
    """
    heads = levelled.where(F.col("level") == "chapter")
    order = Window.partitionBy("book_title").orderBy("page_number", "line_no")
    return (
        heads.withColumn("pos", F.row_number().over(order) - 1)
        .withColumn("next", F.lead("page_number").over(order) - 1)
        .join(pages, "book_title", "left")
        .select("book_title", "pos", F.col("text").alias("title"), F.col("page_number").alias("start_page"),
                F.coalesce("next", "n_pages").alias("end_page"), F.lit(1).alias("level"))
    )


def list_chapters(toc: DataFrame, levelled: DataFrame, pages: DataFrame) -> DataFrame:
    """TOC ranges for books that have a TOC, heading ranges for the others."""
    rest = levelled.join(broadcast_if_small(toc.select("book_title").distinct()), "book_title", "left_anti")
    return toc_ranges(toc, pages).unionByName(heading_ranges(rest, pages))


def content_start(toc: DataFrame, books: DataFrame) -> DataFrame:
    """``book_title, content_start``: the first page among entries at the top level; 1 without a TOC."""
    top = Window.partitionBy("book_title")
    first = toc.withColumn("top", F.min("level").over(top)).where(F.col("level") == F.col("top"))
    first = first.groupBy("book_title").agg(F.min("start_page").alias("start"))
    return books.select("book_title").distinct().join(first, "book_title", "left").select(
        "book_title", F.coalesce("start", F.lit(1)).alias("content_start")
    )


def content_chapters(ranges: DataFrame, *, whole_words: bool = False) -> DataFrame:
    """Top-level ranges of books with a TOC whose titles name no front or back matter."""
    top = Window.partitionBy("book_title")
    kept = ranges.withColumn("_top", F.min("level").over(top)).where(F.col("level") == F.col("_top")).drop("_top")
    return kept.where(X.is_real_chapter("title", whole_words=whole_words))


def leading_number_groups(ranges: DataFrame) -> DataFrame:
    """Ranges of books without a TOC, merged by the number that opens the titles.

    ``book_title, pos, title, start_page, end_page, level``: ``Chapter N`` from the first
    to the last page of its parts, in order of first appearance; others are dropped.
    """
    numbered = ranges.where(X.is_real_chapter("title")).withColumn("number", X.leading_number("title")).where("number is not null")
    merged = numbered.groupBy("book_title", "number").agg(
        F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.min("pos").alias("first")
    )
    order = Window.partitionBy("book_title").orderBy("first")
    return merged.select(
        "book_title", (F.row_number().over(order) - 1).alias("pos"), F.concat(F.lit("Chapter "), "number").alias("title"),
        "start_page", "end_page", F.lit(1).alias("level"),
    )


def reassign(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """``chunks`` with ``new_chapter`` and ``action``: kept, relabelled or removed.

    The first range (by ``pos``) that holds a chunk's page names it; a chunk in no range
    is removed. Chunks of books without ranges are kept as they are. Ranges of a book are
    few: they are gathered by book and looked up, so chunks are joined by book alone.
    """
    ranges = chapters.groupBy("book_title").agg(
        F.array_sort(F.collect_list(F.struct("pos", "start_page", "end_page", "title"))).alias("_ranges")
    )
    joined = chunks.join(broadcast_if_small(ranges, 20_000), "book_title", "left")
    hit = F.get(F.filter("_ranges", lambda r: F.col("page_number").between(r["start_page"], r["end_page"])), F.lit(0))["title"]
    action = (
        F.when(F.col("_ranges").isNull(), "kept")
        .when(hit.isNull(), "removed")
        .when(~hit.eqNullSafe(F.col("chapter")), "relabelled")
        .otherwise("kept")
    )
    return joined.withColumn("action", action).withColumn("new_chapter", F.when(F.col("action") == "kept", F.col("chapter")).otherwise(hit)).drop("_ranges")


def reassign_chapters(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """The library after :func:`reassign`: one table, so labels and vectors cannot part."""
    done = reassign(chunks, chapters).where("action != 'removed'")
    return done.withColumn("chapter", F.col("new_chapter")).select(*chunks.columns)


def reassign_summary(chunks: DataFrame, chapters: DataFrame) -> DataFrame:
    """``book_title, relabelled, removed``."""
    return reassign(chunks, chapters).groupBy("book_title").agg(
        F.count_if(F.col("action") == "relabelled").alias("relabelled"), F.count_if(F.col("action") == "removed").alias("removed")
    )


def page_slice(lines: DataFrame, start_page: int, end_page: int) -> DataFrame:
    """Lines of the pages from start to end, both included; pages keep their numbers."""
    return lines.where(F.col("page_number").between(start_page, end_page))


def single_chapter(lines: DataFrame, chapters: DataFrame) -> DataFrame:
    """The lines of each listed chapter as a book of its own, ``book — chapter``."""
    c = broadcast_if_small(chapters.select("book_title", "title", "start_page", "end_page"), 20_000)
    joined = lines.join(c, "book_title").where(F.col("page_number").between(F.col("start_page"), F.col("end_page")))
    return joined.withColumn("book_title", F.concat("book_title", F.lit(" — "), "title")).select(*lines.columns)


def chapter_labels(chapters: DataFrame) -> DataFrame:
    """``book_title, pos, label``: ``title (pages s-e)``, indented by level."""
    indent = F.repeat(F.lit("  "), F.col("level") - 1)
    return chapters.select(
        "book_title", "pos",
        F.concat(indent, F.col("title"), F.lit(" (pages "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"), F.lit(")")).alias("label"),
    )
