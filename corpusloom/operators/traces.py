"""Reason-act traces and chat history as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Fixed values.
TOOLS = [
    "search_text", "search_tables", "search_figures", "search_equations",
    "get_paper_preview", "get_paper_list",
]
FINISH = "finish"
STEP_CAP = 10
OBSERVATION_CUT = 2000
DIGEST_CUT = 500
HISTORY_TURNS = 4
HISTORY_CUT = 200


def parse_react(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Thought, action and argument map from raw model text.

    Arguments that are not readable JSON fall back to the quoted answer, then to the
    raw braces.
    """
    # The reply patterns of this function.
    has_action = F.col(raw).rlike("(?i)action:")
    before = F.regexp_extract(raw, r"(?is)^(.*?)\n?action:", 1)
    step = (
        df.withColumn("thought", tx.strip(F.when(has_action, before).otherwise(F.col(raw))))
        .withColumn("action", F.regexp_extract(raw, rf"(?iU)action:{tx.WS}*({tx.WORD}+)", 1))
        .withColumn(
            "_braces",
            F.nullif(F.regexp_extract(raw, rf"(?isU)action input:{tx.WS}*(\{{.*?\}})", 1), F.lit("")),
        )
    )
    parsed = F.from_json("_braces", "map<string,string>", {"allowSingleQuotes": "false"})
    answer = F.nullif(
        F.regexp_extract("_braces", rf'(?sU)"answer"{tx.WS}*:{tx.WS}*"(.*?)"', 1), F.lit("")
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return step.withColumn(
        "action_input",
        F.when(F.col("_braces").isNull(), empty)
        .when(parsed.isNotNull(), parsed)
        .when(answer.isNotNull(), F.create_map(F.lit("answer"), answer))
        .otherwise(F.create_map(F.lit("raw_input"), F.col("_braces"))),
    ).drop("_braces")


def history_window(messages: DataFrame) -> DataFrame:
    """Last four turns of each conversation as one block.

    The limit of four rows per conversation runs before the shuffle.
    """
    latest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.upper("role"), F.lit(": "), F.left("text", F.lit(HISTORY_CUT)))
    return (
        messages.withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= HISTORY_TURNS)
        .groupBy("conv_id")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))),
                    lambda r: r["line"],
                ),
                "\n",
            ).alias("_lines")
        )
        .select(
            "conv_id",
            F.concat(F.lit("\nPrevious conversation:\n"), "_lines", F.lit("\n")).alias("history"),
        )
    )


def trace_digest(steps: DataFrame) -> DataFrame:
    """All steps of a run as one text: (run_id, trace, n_steps).

    Observations are stored up to 2000 characters and shown up to 500. The agent stops at
    ``STEP_CAP``; a run that has more steps is shown with all of them.
    """
    stored = F.left("observation", F.lit(OBSERVATION_CUT))
    line = F.concat(
        F.lit("Step "), F.col("step_number").cast("string"), F.lit(": "), "thought",
        F.lit("\nAction: "), "action", F.lit("("), "action_input_json",
        F.lit(")\nObservation: "), F.left(stored, F.lit(DIGEST_CUT)), F.lit("...\n\n"),
    )
    return steps.groupBy("run_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("step_number", line.alias("line")))),
                lambda r: r["line"],
            ),
            "",
        ).alias("trace"),
        F.count("*").alias("n_steps"),
    )


def validate_actions(steps: DataFrame) -> DataFrame:
    """Steps whose lower-cased action is neither a tool nor the finish action."""
    known = F.lower("action").isin([*TOOLS, FINISH])
    listed = "[" + ", ".join(f"'{t}'" for t in TOOLS) + "]"
    return steps.where(~known).withColumn(
        "observation",
        F.concat(
            F.lit("Unknown tool '"), "action", F.lit(f"'. Available tools: {listed}")
        ),
    )


def agent_run_stats(steps: DataFrame) -> DataFrame:
    """Per hop count: runs, completion, mean steps and calls, share over the cap, accuracy."""
    runs = steps.groupBy("run_id").agg(
        F.max("hops").alias("hops"),
        F.bool_or(F.lower("action") == FINISH).alias("finished"),
        F.count("*").alias("n_steps"),
        F.count_if(F.lower("action").isin(TOOLS)).alias("n_calls"),
        F.bool_or("correct").alias("correct"),
    )
    return runs.groupBy("hops").agg(
        F.count("*").alias("n_runs"),
        F.avg(F.col("finished").cast("double")).alias("completion_rate"),
        F.avg("n_steps").alias("mean_steps"),
        F.avg("n_calls").alias("mean_tool_calls"),
        F.avg((F.col("n_steps") >= STEP_CAP).cast("double")).alias("share_at_cap"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )


def tool_mix(steps: DataFrame) -> DataFrame:
    return steps.groupBy(F.lower("action").alias("action")).agg(F.count("*").alias("n_calls"))
