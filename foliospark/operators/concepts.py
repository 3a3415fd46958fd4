"""Concept extraction in resumable batches, and the term graph across books."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import EXTRACTION, EXTRACTION_BATCH, RELATED_CAP
from ..shipping import ship
from .sizes import broadcast_if_small

PROMPT = (
    "Extract 15 to 25 key terms of the text, each with a one-sentence definition, and the relations between them. "
    'Answer with JSON only: {"terms": [{"term": "", "definition": ""}], '
    '"relations": [{"source": "", "relation": "", "target": ""}]}\n\n'
)


def batches(chunks: DataFrame, *, size: int = EXTRACTION_BATCH) -> DataFrame:
    """``chunks`` with ``batch_id``: consecutive runs of ``size`` chunks of a book."""
    order = Window.partitionBy("book_title").orderBy("corpus_pos", "chunk_id")
    return chunks.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def batch_texts(batched: DataFrame) -> DataFrame:
    """``book_title, batch_id, cache_key, text_key, prompt``.

    ``cache_key`` is of the ids alone; ``text_key`` changes when a text does, so a book
    that is ingested again is not answered from a stale cache.
    """
    ordered = F.array_sort(F.collect_list(F.struct("corpus_pos", "chunk_id", "text")))
    texts = F.array_join(F.transform(ordered, lambda s: s["text"]), "\n---\n")
    return batched.groupBy("book_title", "batch_id").agg(
        X.list_key(F.collect_list("chunk_id")).alias("cache_key"), F.md5(texts).alias("text_key"), F.concat(F.lit(PROMPT), texts).alias("prompt")
    )


def parse(answers: DataFrame, column: str = "answer") -> DataFrame:
    """``answers`` with ``extraction`` (null if the JSON is bad) without the fence around it."""
    return answers.withColumn("extraction", F.from_json(X.fence_stripped(column), EXTRACTION))


CACHE = "text_key string, answer string"


def extraction_cache(spark: SparkSession, folder: str) -> DataFrame:
    """``text_key, answer`` of the batches that :func:`extract` has stored in a folder; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(CACHE).json(folder) if there else spark.createDataFrame([], CACHE)


def _is_extraction(answer: str | None) -> bool:
    try:
        return isinstance(json.loads(re.sub(r"^```json\s*|\s*```$", "", (answer or "").strip())), dict)
    except ValueError:
        return False


def extract(batch_prompts: DataFrame, folder: str, model: Callable[[str], str], *, pause: float = 0.0, callers: int | None = None) -> DataFrame:
    """Ask for the batches that the cache lacks; every answer is stored at once, so that a run that breaks off resumes.

    A row per batch asked for, ``book_title, batch_id, text_key, error``: a book's batches
    are asked for one after another, ``pause`` seconds apart, up to its first failure (an
    exception, or no JSON object), which has an ``error``; later ones are not asked for.
    ``callers`` tasks call at a time (None: as many as shuffle partitions). ``folder``,
    which all machines reach, holds one small file a batch. A task that runs again finds
    what it has stored. The calls are made when the result is read.
    """
    spark = batch_prompts.sparkSession
    ship(spark)
    todo = batch_prompts.join(extraction_cache(spark, folder).select("text_key"), "text_key", "left_anti")
    todo = todo.select("book_title", "batch_id", "text_key", "prompt")
    width = callers or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = todo.repartition(width, "book_title").sortWithinPartitions("book_title", "batch_id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        failed, called = set(), False
        for b in batches:
            rows = []
            for book, batch, key, prompt in zip(*(b.column(i).to_pylist() for i in range(4))):
                file = f"{path}/{key}.json"
                if book in failed or system.get_file_info(file).type == fs.FileType.File:
                    continue
                if called:
                    time.sleep(pause)
                called, error = True, None
                try:
                    answer = model(prompt)
                    if not _is_extraction(answer):
                        error = "no JSON object"
                except Exception as e:  # noqa: BLE001  what a model raises is its own
                    error = f"{type(e).__name__}: {e}"
                if error:
                    failed = {book}  # rows come by book
                else:
                    aside = f"{path}/_{uuid.uuid4().hex}"  # readers pass over names with an underscore
                    with system.open_output_stream(aside) as out:
                        out.write(json.dumps({"text_key": key, "answer": answer}).encode())
                    system.move(aside, file)
                rows.append((book, batch, key, error))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["book_title", "batch_id", "text_key", "error"]
            )

    return ordered.mapInArrow(ask, "book_title string, batch_id int, text_key string, error string")


def extracted(batch_prompts: DataFrame, cache: DataFrame) -> DataFrame:
    """``book_title, batch_id, text_key, answer, extraction`` of each book's batches up to the first that the cache lacks."""
    known = parse(cache.dropDuplicates(["text_key"]))
    rows = batch_prompts.select("book_title", "batch_id", "text_key").join(known, "text_key", "left")
    upto = Window.partitionBy("book_title").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    lacks = F.max(F.col("extraction").isNull()).over(upto)
    return rows.withColumn("_lacks", lacks).where(~F.col("_lacks")).select("book_title", "batch_id", "text_key", "answer", "extraction")


def _placed(extractions: DataFrame) -> DataFrame:
    """With ``book_pos``: books by title unless the rows have places of their own."""
    if "book_pos" in extractions.columns:
        return extractions
    books = extractions.select(F.col("book_title").alias("_book")).distinct()
    places = books.withColumn("book_pos", F.row_number().over(Window.orderBy("_book")) - 1)  # a row per book
    return extractions.join(places, F.col("book_title").eqNullSafe(F.col("_book"))).drop("_book")


def _rows(extractions: DataFrame, field: str, place: str) -> DataFrame:
    rows = _placed(extractions).select("book_title", "book_pos", "batch_id", F.posexplode(f"extraction.{field}").alias("at", "x"))
    return rows.select("book_title", "book_pos", (F.shiftleft(F.col("batch_id").cast("long"), 32) + F.col("at")).alias(place), "x.*")


def terms(extractions: DataFrame) -> DataFrame:
    """``book_title, book_pos, term_pos, term, definition``: all batches' terms in order, repeated as they come.

    ``extractions`` has ``book_title, batch_id, extraction`` and, if books have an order of
    their own, ``book_pos``. Terms without a name are left out; bad extractions have none.
    """
    return _rows(extractions, "terms", "term_pos").where("term is not null")


def relations(extractions: DataFrame) -> DataFrame:
    """``book_title, book_pos, rel_pos, source, relation, target``, as :func:`terms`; those without both ends are left out."""
    return _rows(extractions, "relations", "rel_pos").where("source is not null and target is not null")


def graph(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the term graph of some books' extractions."""
    found = nodes(terms(extractions))
    return found, edges(relations(extractions), found)


def calls_needed(chunks: DataFrame, *, size: int = 8) -> DataFrame:
    """``book_title, chapter, n_chunks, n_calls``: chunks of a chapter and the calls they would take."""
    return chunks.groupBy("book_title", "chapter").agg(F.count("*").alias("n_chunks")).withColumn(
        "n_calls", F.floor((F.col("n_chunks") + size - 1) / size).cast("long")
    )


def nodes(terms: DataFrame) -> DataFrame:
    """``term_id, label, definition, books, cross_referenced_in, pos`` of terms by identity.

    ``terms`` has ``book_title, book_pos, term_pos, term, definition``; label and
    definition are those seen first; terms of several books are cross-referenced.
    """
    place = F.struct("book_pos", "term_pos")
    grouped = terms.withColumn("term_id", X.term_id("term")).groupBy("term_id").agg(
        F.min_by(F.struct("term", "definition"), place).alias("first"),
        F.array_sort(F.collect_set("book_title")).alias("books"),
        F.min(place).alias("at"),
    )
    return grouped.select(
        "term_id", F.col("first.term").alias("label"), F.col("first.definition").alias("definition"), "books",
        F.when(F.size("books") > 1, F.col("books")).alias("cross_referenced_in"), F.col("at.book_pos").alias("book_pos"), F.col("at.term_pos").alias("term_pos"),
    )


def edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src, dst, relation, edge_type, book, book_pos, rel_pos``: one edge a pair.

    ``relations`` has ``book_title, book_pos, rel_pos, source, relation, target``. Both
    ends must be terms of any book; the relation seen last wins, the place is the first's.
    """
    ids = broadcast_if_small(nodes.select("term_id"))
    kept = (
        relations.withColumn("src", X.term_id("source")).withColumn("dst", X.term_id("target"))
        .join(ids.withColumnRenamed("term_id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("term_id", "dst"), "dst", "left_semi")
    )
    place = F.struct("book_pos", "rel_pos")
    grouped = kept.groupBy("src", "dst").agg(
        F.max_by(F.struct("relation", "book_title"), place).alias("last"), F.min(place).alias("at")
    )
    return grouped.select(
        "src", "dst", F.col("last.relation").alias("relation"), F.lit("INTERNAL_LINK").alias("edge_type"), F.col("last.book_title").alias("book"),
        F.col("at.book_pos").alias("book_pos"), F.col("at.rel_pos").alias("rel_pos"),
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``term_id, degree, max_degree, is_hub``; a loop counts twice, hubs need 2 at least."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("term_id")).groupBy("term_id").agg(F.count("*").alias("degree"))
    d = nodes.select("term_id").join(ends, "term_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = d.agg(F.max("degree").alias("max_degree"))
    return d.crossJoin(F.broadcast(top)).withColumn(  # one row
        "is_hub", F.col("degree") >= F.greatest(F.lit(2).cast("long"), F.col("max_degree"))
    )


def related(nodes: DataFrame, edges: DataFrame, *, cap: int = RELATED_CAP) -> DataFrame:
    """``term_id, n_related, related``: neighbours with their relations, outgoing edges first.

    ``related`` holds the first ``cap``, ``n_related`` counts all. The cut is made by a
    window before anything is gathered, so a hub's list stays short.
    """
    labels = nodes.select(F.col("term_id").alias("other"), F.col("label"))
    out = edges.select(F.col("src").alias("term_id"), F.col("dst").alias("other"), "relation", F.lit(0).alias("dir"), "book_pos", "rel_pos")
    into = edges.select(F.col("dst").alias("term_id"), F.col("src").alias("other"), "relation", F.lit(1).alias("dir"), "book_pos", "rel_pos")
    both = out.unionByName(into)
    counts = both.groupBy("term_id").agg(F.count("*").alias("n_related"))
    w = Window.partitionBy("term_id").orderBy("dir", "book_pos", "rel_pos", "other")
    first = both.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap).join(labels, "other", "left")
    lists = first.groupBy("term_id").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.coalesce("label", "other").alias("term"), "relation"))).alias("l")
    )
    joined = nodes.select("term_id").join(counts, "term_id", "left").join(lists, "term_id", "left")
    return joined.select(
        "term_id", F.coalesce("n_related", F.lit(0)).alias("n_related"),
        F.coalesce(F.transform("l", lambda s: F.struct(s["term"].alias("term"), s["relation"].alias("relation"))), F.array().cast("array<struct<term:string,relation:string>>")).alias("related"),
    )


def colours(nodes: DataFrame, *, palette: int = 5) -> DataFrame:
    """``term_id, primary_book, colour``: books take palette places in order of first appearance."""
    primary = nodes.withColumn("primary_book", F.coalesce(F.get("books", F.lit(0)), F.lit("Unknown")))
    first = primary.groupBy("primary_book").agg(F.min(F.struct("book_pos", "term_pos")).alias("at"))
    ranked = first.withColumn("colour", F.pmod(F.row_number().over(Window.orderBy("at")) - 1, F.lit(palette)))  # a row per book
    return primary.select("term_id", "primary_book").join(broadcast_if_small(ranked.drop("at")), "primary_book").select("term_id", "primary_book", "colour")


#: Neighbours of a node that one task looks at together.
HUB = 20_000


def two_hops(edges: DataFrame, selected: DataFrame, *, hub: int = HUB) -> DataFrame:
    """``selected, term_id, level``: 0 for the selected node, 1 and 2 for its neighbours' distance.

    What is reached is made distinct before the next hop. The neighbours of a node that has
    more than ``hub`` are dealt into pieces, and what stands at it goes to each of them, so no
    task holds all edges of a hub.
    """
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    hubs = both.groupBy("a").count().where(F.col("count") > hub).select("a", F.ceil(F.col("count") / hub).cast("int").alias("pieces"))
    hubs = broadcast_if_small(hubs)  # narrow: a node and a number
    piece = F.when(F.col("pieces").isNotNull(), F.pmod(F.xxhash64("b"), F.col("pieces"))).otherwise(0).cast("int")
    dealt = both.join(hubs, "a", "left").select("a", "b", piece.alias("piece"))

    def hop(reached: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0), F.coalesce("pieces", F.lit(1)) - 1)
        at = reached.distinct().join(hubs, reached["term_id"] == hubs["a"], "left").select("selected", F.col("term_id").alias("a"), F.explode(every).alias("piece"))
        return at.join(dealt, ["a", "piece"]).select("selected", F.col("b").alias("term_id"))

    start = selected.select(F.col("term_id").alias("selected"), "term_id").distinct()
    one = hop(start).distinct()
    level = lambda df, n: df.withColumn("level", F.lit(n))
    return level(start, 0).unionByName(level(one, 1)).unionByName(level(hop(one), 2)).groupBy("selected", "term_id").agg(F.min("level").alias("level"))


def filter_nodes(nodes: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """Nodes whose property is one of the values."""
    return nodes.where(F.col(prop).isin(values))


def filter_edges(edges: DataFrame, prop: str, values: list[str]) -> DataFrame:
    """``term_id`` of both ends of edges whose property is one of the values."""
    return edges.where(F.col(prop).isin(values)).select(F.explode(F.array("src", "dst")).alias("term_id")).distinct()


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: ``n_nodes, n_edges, n_shared``."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.count_if(F.size("books") > 1).alias("n_shared"))
    return n.crossJoin(edges.agg(F.count_if(F.col("edge_type") == "INTERNAL_LINK").alias("n_edges")))


def fill_kind(crossed: Column, hub: Column) -> Column:
    """What a node's colours tell: shared between books, a hub, or its book."""
    return F.when(crossed, "cross_ref").when(hub, "hub").otherwise("book")


def node_payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes as the page shows them; everything that goes into HTML is escaped."""
    joined = nodes.join(degrees(nodes, edges), "term_id").join(related(nodes, edges), "term_id").join(colours(nodes), "term_id")
    crossed = F.col("cross_referenced_in").isNotNull()
    return joined.select(
        F.col("term_id").alias("id"),
        F.concat(F.lit("<b>"), X.html_escaped("label"), F.lit("</b>\n<i>"), X.html_escaped(X.connections(F.col("n_related"))), F.lit("</i>")).alias("label"),
        F.col("label").alias("term"), F.coalesce("definition", F.lit("")).alias("definition"), "books", crossed.alias("isCrossRef"),
        fill_kind(crossed, F.col("is_hub")).alias("kind"), "colour", "related", "book_pos", "term_pos",
    )


def edge_payload(edges: DataFrame) -> DataFrame:
    return edges.select(
        F.col("src").alias("from"), F.col("dst").alias("to"), F.coalesce("relation", F.lit("")).alias("label"), F.lit("to").alias("arrows"),
        F.lit(True).alias("dashes"), "book_pos", "rel_pos",
    )
