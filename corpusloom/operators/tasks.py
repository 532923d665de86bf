"""The nine retrieval recipes as a parameter table joined to a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

# Query texts, k, filter and context budget per task. NULL text means the
# request's own question; side 1 / 2 means the first / second source of the request;
# "optional" means the request's source if it has one.
RECIPES = [
    # task, query_no, text, k, filter, budget
    ("question_answering", 0, None, 10, "optional", 4000),
    ("summarization", 0, "main contributions methodology results conclusions abstract", 20, "optional", 6000),
    ("comparison", 0, "methodology approach contributions results evaluation", 15, "first", 3000),
    ("comparison", 1, "methodology approach contributions results evaluation", 15, "second", 3000),
    ("literature_survey", 0, None, 30, "none", 8000),
    ("research_gaps", 0, "limitations future work challenges open problems", 10, "optional", 6000),
    ("research_gaps", 1, "conclusion future directions", 10, "optional", 6000),
    ("research_gaps", 2, "drawbacks weaknesses shortcomings", 10, "optional", 6000),
    ("concept_explanation", 0, None, 12, "optional", 5000),
    ("recommendation", 0, None, 20, "none", 6000),
    ("trend_analysis", 0, "methodology approach technique method architecture", 15, "none", 8000),
    ("trend_analysis", 1, "results performance accuracy benchmark evaluation", 15, "none", 8000),
    ("trend_analysis", 2, "dataset training evaluation metric comparison", 15, "none", 8000),
    ("multi_doc_reasoning", 0, None, 20, "none", 7000),
]
OWN_TOP_K = [  # tasks whose k a request may set
    "question_answering", "summarization", "literature_survey", "recommendation",
    "multi_doc_reasoning",
]
SURVEY_WITHOUT_TOPIC = "contributions methodology evaluation results"
TASKS = list(dict.fromkeys(r[0] for r in RECIPES))


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RECIPES, "task string, query_no int, recipe_text string, k int, filter string, budget int"
    )


def plan_queries(requests: DataFrame) -> DataFrame:
    """Expand requests ``(task_id, task, question, source, second_source)`` to queries.

    Optional request columns: ``top_k`` (NULL or 0: the recipe's; only for the tasks in
    ``OWN_TOP_K``) and ``similarity_threshold``, which every query of the task gets.
    The recipe table has 14 rows and is broadcast. Only the survey task has a stand-in
    for a missing question.
    """
    plan = F.broadcast(recipes(requests.sparkSession))
    text = F.coalesce(
        "recipe_text",
        F.when(
            (F.col("task") == "literature_survey")
            & ~tx.has_text(F.coalesce("question", F.lit(""))),
            SURVEY_WITHOUT_TOPIC,
        ),
        "question",
    )
    source = (
        F.when(F.col("filter").isin("optional", "first"), F.col("source"))
        .when(F.col("filter") == "second", F.col("second_source"))
    )
    have = requests.columns
    own = F.nullif(F.col("top_k"), F.lit(0)) if "top_k" in have else F.lit(None).cast("int")
    threshold = F.col("similarity_threshold") if "similarity_threshold" in have else F.lit(None)
    asked = requests.select(
        "task_id", "task", "question", "source", "second_source", own.alias("_own"),
        threshold.cast("double").alias("similarity_threshold"),
    )
    return asked.join(plan, "task").select(
        "task_id", "task", "query_no",
        F.concat_ws("#", "task_id", F.col("query_no").cast("string")).alias("query_id"),
        text.alias("query_text"),
        source.alias("filter_source"),
        F.coalesce(F.when(F.col("task").isin(OWN_TOP_K), F.col("_own")), F.col("k")).alias("k"),
        "budget", "similarity_threshold",
    )


def merge_task_hits(hits: DataFrame) -> DataFrame:
    """Results of a task's queries in order, with ``position``.

    Comparison concatenates its two sides as they are; every other task keeps a chunk
    only where it first appeared.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("task_id", "chunk_id").orderBy("query_no", "rank")
    order = Window.partitionBy("task_id").orderBy("query_no", "rank")
    return (
        hits.withColumn("_seen", F.row_number().over(first))
        .where((F.col("task") == "comparison") | (F.col("_seen") == 1))
        .drop("_seen")
        .withColumn("position", F.row_number().over(order))
    )
