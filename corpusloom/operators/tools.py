"""A table of tool requests answered at once: name and arguments to the text a reader gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import catalog as cat
from corpusloom.operators import context as ctx
from corpusloom.operators import retrieval, traces
from corpusloom.session import materialize

# What each tool searches, its arguments, and the heading of the paper list.
SEARCHED = {
    "search_text": "text", "search_tables": "table", "search_figures": "figure",
    "search_equations": "equation",
}
ARGUMENTS = {  # required, optional
    **{tool: (["query"], ["source_file"]) for tool in SEARCHED},
    "get_paper_preview": (["source_file"], []),
    "get_paper_list": ([], []),
}
LIST_HEADING = "Available research papers:\n"


def _problem(tool, given):
    """What is wrong with the arguments of a known tool; NULL if nothing is."""
    out = F.lit(None).cast("string")
    for name, (required, optional) in ARGUMENTS.items():
        missing = F.array_except(F.array(*[F.lit(a) for a in required]).cast("array<string>"), given)
        allowed = F.array(*[F.lit(a) for a in [*required, *optional]]).cast("array<string>")
        extra = F.array_sort(F.array_except(given, allowed))
        text = (
            F.when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))
            .when(F.size(extra) > 0, F.concat(F.lit("unexpected "), F.array_join(extra, ", ")))
        )
        out = F.when(tool == name, text).otherwise(out)
    return out


def run_tools(
    requests: DataFrame,
    embed_queries: Callable[[DataFrame], DataFrame],
    chunks: DataFrame,
    contents: DataFrame,
    papers: DataFrame,
    k: int = retrieval.TYPED_TOP_K,
) -> DataFrame:
    """``(request_id as text, observation)`` for ``requests`` (request_id, action, action_input map).

    Search tools take ``query`` and optionally ``source_file``: typed search with fallback,
    the ``k`` best. ``chunks`` holds vectors, ``contents`` the chunk rows to show, ``papers``
    the catalog; ``embed_queries`` adds ``vector`` to a table with ``query_text``. Unknown
    tools and wrong arguments get a message; the finish action is no tool and has no row.
    """
    tool = F.lower("action")
    asked = materialize(
        requests.where(tool != traces.FINISH).select(
            F.col("request_id").cast("string").alias("request_id"), "action", tool.alias("tool"),
            F.coalesce("action_input", F.create_map().cast("map<string,string>")).alias("args"),
        ).withColumn("problem", _problem(F.col("tool"), F.map_keys("args"))),
        "tool-requests")
    unknown = traces.validate_actions(asked).select("request_id", "observation")
    invalid = asked.where(F.col("problem").isNotNull()).select(
        "request_id",
        F.concat(F.lit("Invalid arguments for tool '"), "action", F.lit("': "), "problem")
        .alias("observation"))
    good = asked.where(F.col("problem").isNull())

    kind = ctx._pick(F.col("tool"), SEARCHED)
    searches = good.where(F.col("tool").isin(list(SEARCHED))).select(
        F.col("request_id").alias("query_id"), F.col("args")["query"].alias("query_text"),
        F.coalesce(F.col("args")["source_file"], F.lit("")).alias("filter_source"),
        kind.alias("filter_type"))
    queries = materialize(embed_queries(searches), "tool-queries")
    hits = materialize(retrieval.typed_search_with_fallback(queries, chunks, k), "tool-hits")
    shown = retrieval.attach_chunks(hits, contents)
    searched = ctx.format_observation(shown, queries.select(
        "query_id", F.col("filter_type").alias("content_type"),
        F.col("query_text").alias("question"),
    )).withColumnRenamed("query_id", "request_id")

    wanted = good.where(F.col("tool") == "get_paper_preview").select(
        "request_id", tx.strip(F.col("args")["source_file"]).alias("source_file"))
    previews = wanted.join(retrieval.paper_preview(contents, wanted), "source_file").select(
        "request_id", F.col("preview").alias("observation"))

    lines = cat.completed_papers(papers).agg(
        F.array_sort(
            F.collect_list(F.struct("ingested_at", "id", "line")),
            lambda a, b: F.when(a["ingested_at"] > b["ingested_at"], -1)
            .when(a["ingested_at"] < b["ingested_at"], 1)
            .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
        ).alias("papers"))
    listing = lines.select(
        F.lit("get_paper_list").alias("tool"),
        F.when(F.get("papers", F.lit(0))["id"].isNull(), F.lit(cat.NO_PAPERS)).otherwise(
            F.concat(F.lit(LIST_HEADING), F.array_join(
                F.transform("papers", lambda p: p["line"]), "\n"))).alias("observation"))
    lists = good.join(materialize(listing, "paper-list"), "tool").select("request_id", "observation")
    parts = [unknown, invalid, searched, previews, lists]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
