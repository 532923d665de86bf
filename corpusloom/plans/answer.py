"""A table of requests answered end to end: planned, searched, packed, cited, prompted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import context as ctx
from corpusloom.operators import retrieval, tasks
from corpusloom.session import materialize


def search(planned: DataFrame, chunks: DataFrame) -> DataFrame:
    """Merged hits of planned queries (see ``tasks.plan_queries``) that carry ``vector``."""
    ranked = retrieval.apply_threshold(retrieval.knn_exact(planned, chunks))
    if "similarity_threshold" in planned.columns:
        wanted = planned.select("query_id", F.col("similarity_threshold").alias("_t"))
        ranked = retrieval.apply_threshold(ranked.join(wanted, "query_id"), F.col("_t")).drop("_t")
    keys = planned.select("query_id", "task_id", "task", "query_no", "budget")
    return tasks.merge_task_hits(ranked.join(keys, "query_id").drop("query_id"))


def attach(hits: DataFrame, *tables: DataFrame) -> DataFrame:
    """Hits with the columns of the chunk tables, written once.

    Contexts, citations and reports all read the result, so the search and the chunk
    tables are gone through a single time, each with the ids of the same stored hits.
    """
    hits = materialize(hits, "merged-hits")
    for table in tables:
        known = [c for c in table.columns if c == "chunk_id" or c not in hits.columns]
        hits = retrieval.attach_chunks(hits, table.select(*known))
    return materialize(hits, "task-hits")


def contexts(hits: DataFrame) -> DataFrame:
    """Packed context per request; the two sides of a comparison have a budget each."""
    side = F.when(F.col("task") == "comparison", F.col("query_no")).otherwise(0)
    parts = ctx.pack_context(
        hits.withColumn("part", F.struct("task_id", side.alias("side"))),
        F.col("budget"), "part", "position",
    )
    joined = F.transform(
        F.array_sort(F.collect_list(F.struct("part.side", "context"))), lambda p: p["context"]
    )
    return parts.groupBy("part.task_id").agg(
        F.max(F.when(F.col("part.side") == 0, F.col("context"))).alias("first"),
        F.max(F.when(F.col("part.side") == 1, F.col("context"))).alias("second"),
        F.array_join(joined, "\n======\n").alias("context"),
        F.sum("chunks_used").alias("chunks_used"),
    )


def cited(hits: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Citations of each request as one array in rank order."""
    one = F.struct(
        "citation_no", "source_file", "page_number", "section", "relevance_score", "element_type",
        "content_type", "image_url", "image_description", "latex_source",
    )
    return ctx.citations(hits, "task_id", "position", images).groupBy("task_id").agg(
        F.array_sort(F.collect_list(one)).alias("citations"),
        F.count("*").alias("n_citations"),
    )


def answer_requests(
    requests: DataFrame,
    chunks: DataFrame,
    embed_queries: Callable[[DataFrame], DataFrame],
    *contents: DataFrame,
    images: DataFrame | None = None,
) -> DataFrame:
    """One row per request: context, prompt, citations, or the task's default answer.

    ``requests`` has ``task_id, task, question, source, second_source`` and optionally
    ``top_k`` and ``similarity_threshold``; ``images`` lists stored images; ``chunks`` holds
    vectors and metadata, ``contents`` further tables by chunk id. ``embed_queries`` adds
    ``vector`` to a table with ``query_text``, with the model the chunks were made with.
    """
    planned = materialize(embed_queries(tasks.plan_queries(requests)), "task-queries")
    hits = attach(search(planned, chunks), chunks, *contents)
    shell = ctx.answer_shell(
        requests.select("task_id", "task", "question", "source", "second_source"),
        contexts(hits), cited(hits, images),
    )
    prompts = ctx.assemble_prompt(shell).drop("first", "second", "source", "second_source")
    return prompts.withColumn("prompt", F.when(F.col("chunks_used") > 0, F.col("prompt")))
