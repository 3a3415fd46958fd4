"""Retrieval metrics, judged metrics, and evaluation sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .query import call_model

JUDGES = {
    "faithfulness": "How far does the context support the answer? Reply with a number from 0 to 1.\n\nCONTEXT:\n{context}\n\nANSWER:\n{answer}",
    "relevance": "How well does the answer address the question? Reply with a number from 0 to 1.\n\nQUESTION:\n{question}\n\nANSWER:\n{answer}",
    "recall": "How much of the expected answer does the context hold? Reply with a number from 0 to 1.\n\nEXPECTED:\n{truth}\n\nCONTEXT:\n{context}",
}


def found_at(eval_set: DataFrame, results: DataFrame) -> DataFrame:
    """``query_id, pos, found_pos`` per evaluation item and truth; nulls where it was not found.

    ``eval_set`` has ``query_id, chunk_id``; several truths of a query give a row each.
    """
    r = results.select("query_id", "chunk_id", "pos", "found_pos")
    return eval_set.select("query_id", "chunk_id").join(r, ["query_id", "chunk_id"], "left")


def metrics(eval_set: DataFrame, results: DataFrame, *, ks: tuple[int, ...] = (1, 3, 5), depth: int = 10) -> DataFrame:
    """One row: ``hit_rate_<k>`` for each k and ``mrr``, of one retrieval at ``depth``.

    A query is hit if any of its truths is among the first k. Hits count places before
    orphans are dropped, reciprocal ranks places after. No items: nulls.
    """
    best = found_at(eval_set, results).groupBy("query_id").agg(F.min("pos").alias("pos"), F.min("found_pos").alias("found_pos"))
    hit = lambda k: F.avg(F.coalesce(F.col("pos") <= k, F.lit(False)).cast("double")).alias(f"hit_rate_{k}")
    reciprocal = F.when(F.col("found_pos") <= depth, 1.0 / F.col("found_pos"))
    return best.agg(*[hit(k) for k in ks], F.avg(F.coalesce(reciprocal, F.lit(0.0))).alias("mrr"))


def judge(items: DataFrame, model: Callable[[str], str], *, kind: str) -> DataFrame:
    """``items`` with ``score`` of one judged metric; answers without a number give null."""
    prompt: Column = F.lit(JUDGES[kind])
    for name in ("context", "answer", "question", "truth"):
        if name in items.columns:
            prompt = F.replace(prompt, F.lit("{" + name + "}"), F.coalesce(name, F.lit("")))
    return call_model(items.withColumn("_prompt", prompt), model, column="_prompt", out="judged").withColumn(
        "score", X.judge_score("judged")
    ).drop("_prompt")


def mean_scores(judged: DataFrame, by: list[str]) -> DataFrame:
    """Mean score; 0 where there is none."""
    return judged.groupBy(*by).agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score"))


def _excerpt(text: Column) -> Column:
    return F.substring(text, 1, 250)


def candidates_with_todo(chunks: DataFrame, *, limit: int = 5) -> DataFrame:
    """A template of an evaluation set: the first chunks that hold no contents or thanks."""
    text = F.col("text")
    kept = chunks.where(~F.contains(text, F.lit("....")) & ~F.contains(text, F.lit("Table of Contents")) & ~F.contains(text, F.lit("Acknowledgments")))
    first = kept.orderBy("corpus_pos", "chunk_id").limit(limit)
    nth = F.row_number().over(Window.orderBy("corpus_pos", "chunk_id"))  # at most ``limit`` rows
    return first.select(
        F.concat(F.lit("q"), nth.cast("string")).alias("id"),
        F.concat(F.lit("TODO: Write a question about "), F.coalesce("chapter", F.lit("this section"))).alias("question"),
        F.col("chunk_id").alias("ground_truth_chunk_id"),
        F.concat(X.strip(_excerpt(text)), F.lit("...")).alias("ground_truth_answer"),
    )


def generated_questions(chunks: DataFrame, *, limit: int | None = 20) -> DataFrame:
    """Questions made of chunks' own words; ``limit`` keeps the first so many (None: all, by position).

    Chunks of contents, or of fewer than 150 characters, are left out. The topic is the
    section, or the first line where that says nothing.
    """
    text = F.col("text")
    kept = chunks.where(~F.contains(text, F.lit("....")) & ~F.contains(text, F.lit("Table of Contents")) & (F.length(X.strip(text)) >= 150))
    rows = kept.withColumn("_lines", F.filter(F.transform(F.split(text, "\n"), X.strip), lambda x: x != "")).where(F.size("_lines") > 0)
    topic = F.when(F.col("section").isin("Unknown", "σ", ""), F.substring(F.col("_lines")[0], 1, 50)).otherwise(F.col("section"))
    lead = F.substring(F.array_join(F.slice("_lines", 1, 2), " "), 1, 60)
    made = rows.select(
        "corpus_pos", "chunk_id",
        F.concat(F.lit("According to the text on "), topic, F.lit(", what is explained about "), lead, F.lit("?")).alias("question"),
        F.concat(X.strip(F.replace(_excerpt(text), F.lit("\n"), F.lit(" "))), F.lit("...")).alias("ground_truth_answer"),
    )
    if limit is None:
        return made.select(F.concat(F.lit("q"), F.col("corpus_pos").cast("string")).alias("id"), "question", "ground_truth_answer", F.col("chunk_id").alias("ground_truth_chunk_id"))
    first = made.orderBy("corpus_pos", "chunk_id").limit(limit)
    nth = F.row_number().over(Window.orderBy("corpus_pos", "chunk_id"))  # at most ``limit`` rows
    return first.select(F.concat(F.lit("q"), nth.cast("string")).alias("id"), "question", "ground_truth_answer", F.col("chunk_id").alias("ground_truth_chunk_id"))


def sample_spread(chunks: DataFrame, *, n: int = 10) -> DataFrame:
    """``n`` chunks of each book, spread over it by page: every (count // n)-th from the first."""
    order = Window.partitionBy("book_title").orderBy("page_number", "corpus_pos")
    narrow = chunks.select("book_title", "chunk_id", "page_number", "corpus_pos")  # a large book is sorted without its texts
    counted = narrow.withColumn("_rn", F.row_number().over(order) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("book_title")))
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / F.least(F.lit(n), F.col("_n")))).cast("int")
    kept = counted.where((F.col("_rn") % step == 0) & (F.col("_rn") / step < n)) if n > 0 else counted.where(F.lit(False))
    picked = kept.select("book_title", "chunk_id", "corpus_pos", (F.col("_rn") / step).cast("int").alias("nth"))
    return chunks.join(picked, ["book_title", "chunk_id", "corpus_pos"])


GENERATION = ("faithfulness", "relevance", "recall")


def generation_metrics(items: DataFrame, model: Callable[[str], str]) -> DataFrame:
    """One row: the mean judged score of each kind, and ``error``: what a judge raised first, by kind and question.

    ``items`` has ``question, answer, context, truth``.
    """
    judged = None
    for n, kind in enumerate(GENERATION):
        one = judge(items, model, kind=kind).select(F.lit(kind).alias("kind"), F.lit(n).alias("n"), "question", "score", "judged_error")
        judged = one if judged is None else judged.unionByName(one)
    scores = [F.coalesce(F.avg(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)).alias(k) for k in GENERATION]
    first = F.min_by("judged_error", F.when(F.col("judged_error").isNotNull(), F.struct("n", "question")))
    return judged.agg(*scores, first.alias("error"))


def report(row: dict, *, when: str, size: int | None = None, generation: dict | None = None, skipped: str | None = None) -> str:
    """Markdown of one row of metrics: rates in percent, others with three decimals.

    ``generation`` adds the judged scores with two decimals; ``skipped`` says why there are none.
    """
    shown = lambda name, v: "-" if v is None else f"{v:.2%}" if name.startswith("hit_rate") else f"{v:.3f}"
    lines = [f"# Evaluation report\n\nGenerated: {when}\n"]
    if size is not None:
        lines.append(f"Questions: {size}\n")
    lines += ["## Retrieval\n", "| Metric | Value |", "|---|---|", *(f"| {n} | {shown(n, v)} |" for n, v in row.items())]
    if generation:
        lines += ["\n## Generation\n", "| Metric | Value |", "|---|---|", *(f"| {n} | {v:.2f} |" for n, v in generation.items())]
    elif skipped:
        lines += ["\n## Generation\n", f"Skipped: {skipped}"]
    return "\n".join(lines) + "\n"
