"""Questions over a library: routed search, prompts, and the two debugging views."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import ASK_TOP_K
from ..shipping import ship
from . import fusion, routing
from .store import stored

REFUSAL = "Information not found in the provided context."
INSTRUCTIONS = (
    "Answer from the excerpts only, and cite each statement as (Chapter, Section, p.PAGE). "
    f"If they do not hold the answer, say: {REFUSAL}"
)


def contexts(results: DataFrame) -> DataFrame:
    """``query_id, context``: a query's excerpts in order, labelled, a rule between them."""
    block = X.context_block(F.col("chapter"), F.col("section"), F.col("page_number"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda s: s["block"]), "\n\n---\n\n").alias("context"))


def prompts(queries: DataFrame, results: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """``query_id, prompt`` for a text model."""
    c = queries.join(contexts(results), "query_id", "left")
    return c.select(
        "query_id",
        F.concat(
            F.lit(instructions + "\n\nEXCERPTS:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQUESTION: "), F.col("question"), F.lit("\n\nANSWER:")
        ).alias("prompt"),
    )


def call_model(prompts: DataFrame, model: Callable[[str], str], *, column: str = "prompt", out: str = "answer") -> DataFrame:
    """``prompts`` with ``out``: what ``model`` says to each; errors are null with a message in ``<out>_error``.

    ``model`` is any picklable callable; retries belong into it (see :func:`with_retry`).
    A null prompt gives a null answer.
    """
    return _called(prompts, model, [column], out)


def call_image_model(rows: DataFrame, model: Callable[[str, bytes, str], str], *, column: str = "prompt", image: str = "image", mime: str = "mime_type", out: str = "answer") -> DataFrame:
    """As :func:`call_model` for a model that is given a text, an image's bytes and their type (null: ``image/png``)."""
    typed = rows.withColumn(mime, F.coalesce(mime, F.lit("image/png")) if mime in rows.columns else F.lit("image/png"))
    return _called(typed, model, [column, image, mime], out)


def _called(rows: DataFrame, model: Callable[..., str], columns: list[str], out: str) -> DataFrame:
    ship(rows.sparkSession)

    @F.arrow_udf("struct<answer:string,error:string>")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            said = []
            for given in batch.to_pylist():
                given = list(given.values())
                try:
                    said.append({"answer": None if None in given else model(*given), "error": None})
                except Exception as e:  # noqa: BLE001  what a model raises is its own
                    said.append({"answer": None, "error": f"{type(e).__name__}: {e}"})
            yield pa.array(said, pa.struct([("answer", pa.string()), ("error", pa.string())]))

    called = rows.withColumn("_a", ask.asNondeterministic()(F.struct(*columns)))
    return called.withColumn(out, F.col("_a.answer")).withColumn(f"{out}_error", F.col("_a.error")).drop("_a")


def with_retry(call: Callable[[str], str], *, waits: tuple[float, ...] = (5, 10, 20, 40), retriable: Callable[[Exception], bool], sleep=None) -> Callable[[str], str]:
    """``call`` again after each wait while it fails in a way that may pass (such as 429 or 503)."""
    import time

    pause = sleep or time.sleep

    def tried(prompt: str) -> str:
        for i in range(len(waits)):
            try:
                return call(prompt)
            except Exception as e:  # noqa: BLE001
                if not retriable(e) or i + 1 == len(waits):
                    raise
                pause(waits[i])
        raise RuntimeError("no attempt was allowed")

    return tried


def may_pass(error: Exception) -> bool:
    """Whether an error is that of a service that is busy: 429 or 503 in its message."""
    return any(code in str(error) for code in ("429", "503"))


def ask(chunks: DataFrame, queries: DataFrame, profiles: DataFrame, vectors: DataFrame, *, top_k: int = ASK_TOP_K, force_all: bool = False, **options) -> DataFrame:
    """Routed hybrid search: results with their chunks and the filters that were used; ``options`` are those of :func:`fusion.search`."""
    # routing reads all profiles, and every search reads the routes
    routed = stored(routing.route(queries, profiles, vectors, force_all=force_all), "routed")
    found = fusion.hydrate(fusion.search(chunks, routed, top_k=top_k, **options), chunks.drop("embedding"))
    return found.join(routed.select("query_id", "book_filter", "chapter_filter"), "query_id")


def debug_queries(chunks: DataFrame, queries: DataFrame, profiles: DataFrame, *, top_k: int = 10, **options) -> DataFrame:
    """Book-routed results with a flag on chapters that look like front or back matter; ``options`` are those of :func:`fusion.search`."""
    booked = queries.join(routing.route_books(queries, profiles), "query_id")
    routed = stored(booked, "routed").withColumn("chapter_filter", F.lit(None).cast("string"))
    found = fusion.hydrate(fusion.search(chunks, routed, top_k=top_k, **options), chunks.drop("embedding"))
    return found.withColumn("polluted", X.is_polluted("chapter"))


def keyword_search(chunks: DataFrame, keyword: str, *, book: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks that hold the keyword literally, with a snippet and the number of hits in all.

    Ordered by corpus position; ``limit`` keeps the first so many (None: all).
    """
    rows = chunks if not book else chunks.where(F.col("book_title") == book)
    hits = rows.where(X.contains_ci("text", keyword)).select(
        "chunk_id", "book_title", "chapter", "page_number", "corpus_pos", X.snippet("text", F.lit(keyword)).alias("snippet")
    )
    if limit is None:
        return hits
    return hits.orderBy("corpus_pos", "chunk_id").limit(limit)


def nth_rows(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order."""
    return df.orderBy(*order).offset(offset).limit(limit)
