"""From ranked hits to contexts, citations, visuals, prompts and answer rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.numbers import fixed, round_exact

# Fixed values.
CONTEXT_BUDGET = 4000
VISUAL_TYPES = ["figure", "table", "equation"]
VISUAL_CUT = 500
MIN_IMAGE_SIDE = 50
NEIGHBOUR_COUNT = 5
NEIGHBOUR_CUT = 600
NO_NEIGHBOURS = "(no surrounding text available)"
TABLE_PREVIEW_ROWS = 3
TABLE_PREVIEW_CUT = 120
UNKNOWN = "?"  # a hit whose chunk row is missing


def context_block() -> Column:
    """One hit as a cited block of text; what its chunk row lacks is shown as unknown."""
    section = F.coalesce("section_heading", F.lit(""))
    return F.concat(
        F.lit("[Source: "), F.coalesce("source_file", F.lit(UNKNOWN)), F.lit(", Page "),
        F.coalesce(F.col("page_number").cast("string"), F.lit(UNKNOWN)),
        F.when(section != "", F.concat(F.lit(", Section: "), section)).otherwise(""),
        F.lit("] (Relevance: "), fixed(F.col("score"), 2), F.lit(")\n"), F.coalesce("content", F.lit("")), F.lit("\n"),
    )


def pack_context(
    hits: DataFrame,
    budget: int | Column = CONTEXT_BUDGET,
    group: str = "query_id",
    order: str = "rank",
) -> DataFrame:
    """Blocks in order up to the first that would exceed the budget, joined.

    Lengths are positive, so stopping at the first overflow equals keeping the rows
    whose running length is within the budget. Separators are not counted.
    """
    limit = budget if isinstance(budget, Column) else F.lit(budget)
    running = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = hits.withColumn("_block", context_block()).withColumn(
        "_used", F.sum(F.length("_block")).over(running)
    )
    fits = F.col("_used") <= limit
    return blocks.groupBy(group).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(fits, F.struct(order, "_block")))),
                lambda b: b["_block"],
            ),
            "\n---\n",
        ).alias("context"),
        F.count_if(fits).alias("blocks_used"),
        F.count("*").alias("chunks_used"),
    )


def citations(hits: DataFrame, group: str = "query_id", order: str = "rank",
              images: DataFrame | None = None) -> DataFrame:
    """First hit per (source, page, kind, image name), numbered in rank order.

    Text hits of one page share a citation; so do two tables of one page, because both
    have no image. ``images`` lists the stored images (``image_path``): an image that is
    not among them is not linked. Without it every named image counts as stored.
    """
    visual = F.col("element_type").isin(VISUAL_TYPES)
    kind = F.when(visual, F.col("element_type")).otherwise("text")
    image = F.coalesce(tx.basename(F.col("image_path")), F.lit(""))
    first = Window.partitionBy(group, "source_file", "page_number", "_kind", "_image").orderBy(order)
    numbered = Window.partitionBy(group).orderBy(order)
    kept = (
        hits.withColumn("_kind", kind)
        .withColumn("_image", image)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
    )
    stored = F.lit(True)
    if images is not None:
        listed = images.select(F.col("image_path").alias("_path")).distinct()
        # most citations have no image: a key of their own each keeps them spread
        key = F.when(F.col("_image") != "", F.col("image_path")).otherwise(
            F.concat_ws(":", F.lit("no image"), group, "chunk_id"))
        kept = kept.withColumn("_key", key).join(listed, F.col("_key") == F.col("_path"), "left")
        stored = F.col("_path").isNotNull()
    return (
        kept.select(
            group,
            F.row_number().over(numbered).alias("citation_no"),
            "source_file",
            "page_number",
            F.col("section_heading").alias("section"),
            round_exact(F.col("score"), 3).alias("relevance_score"),
            "element_type",
            "content_type",
            F.when((F.col("_image") != "") & stored, F.concat(F.lit("/images/"), "_image"))
            .alias("image_url"),
            F.nullif("image_description", F.lit("")).alias("image_description"),
            "table_data",
            F.nullif("latex_source", F.lit("")).alias("latex_source"),
        )
    )


def visual_citations(cited: DataFrame) -> DataFrame:
    """Citations with something to show; image before table before formula."""
    kind = (
        F.when(F.col("image_url").isNotNull(), "image")
        .when(F.col("table_data").isNotNull(), "table")
        .when(F.col("latex_source").isNotNull(), "equation")
    )
    return cited.withColumn("display", kind).where(F.col("display").isNotNull())


def list_visuals(chunks: DataFrame, image_meta: DataFrame) -> DataFrame:
    """Figures, tables and equations to show, with small images left out.

    A figure needs a stored image. Any item whose stored image has a side under 50, or
    cannot be read (NULL size), goes.
    Most tables and formulas have no image: they get a join key of their own each, so
    that the empty path is not one hot key.
    """
    size = image_meta.select(F.col("image_path").alias("_key"), F.lit(True).alias("_stored"),
                             F.col("width").alias("image_width"),
                             F.col("height").alias("image_height"))
    path = F.coalesce("image_path", F.lit(""))
    key = F.when(path == "", F.concat(F.lit("no image:"), "chunk_id")).otherwise(path)
    stored = F.col("_stored").isNotNull()
    big = F.least(F.coalesce("image_width", F.lit(0)), F.coalesce("image_height", F.lit(0)))
    payload = [  # what the chunk table has of an item's own data
        (F.nullif(c, F.lit("")) if c != "table_data" else F.col(c)).alias(c)
        for c in ("image_description", "table_data", "latex_source") if c in chunks.columns
    ]
    type_order = (
        F.when(F.col("element_type") == "figure", 0)
        .when(F.col("element_type") == "table", 1)
        .otherwise(2)
    )
    return (
        chunks.where(F.col("element_type").isin(VISUAL_TYPES))
        .withColumn("_key", key)
        .join(size, "_key", "left")
        .where(F.when(stored, big >= MIN_IMAGE_SIDE).otherwise(F.col("element_type") != "figure"))
        .select(
            "chunk_id", "source_file", "element_type", "page_number", "section_heading",
            F.left(F.coalesce("content", F.lit("")), F.lit(VISUAL_CUT)).alias("content"),
            F.when(stored, F.concat(F.lit("/images/"), tx.basename(F.col("image_path")))).alias(
                "image_url"
            ),
            "image_width", "image_height",
            *payload,
            type_order.alias("type_order"),
        )
        .orderBy("source_file", "page_number", "type_order", "chunk_id")
    )


def visual_counts(visuals: DataFrame, element_type: str | None = None) -> DataFrame:
    if element_type:
        visuals = visuals.where(F.col("element_type") == element_type)
    return visuals.groupBy("source_file").agg(
        F.count_if(F.col("element_type") == "figure").alias("n_figures"),
        F.count_if(F.col("element_type") == "table").alias("n_tables"),
        F.count_if(F.col("element_type") == "equation").alias("n_equations"),
        F.count("*").alias("n_total"),
    )


def neighbor_context(visuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """Text around each visual: the first five paragraphs of pages within one.

    Which paragraphs surround a page depends on the page alone, so the answer is made
    once per (source, page) and then joined: visuals never meet all paragraphs of their
    page. A page's own first five are taken before pages are spread to their neighbours,
    and each row limit runs before its shuffle as well as after it.
    """
    page = ["source_file", "page_number"]
    order = Window.partitionBy(*page).orderBy("chunk_index", "chunk_id")

    def first_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(order)).where(
            F.col("_n") <= NEIGHBOUR_COUNT
        )

    texts = chunks.where((F.col("element_type") == "paragraph") & F.col("content").isNotNull())
    paragraphs = texts.select(
        *page, "chunk_index", "chunk_id", F.left("content", F.lit(NEIGHBOUR_CUT)).alias("content")
    )
    around = F.array(F.col("page_number") - 1, F.col("page_number"), F.col("page_number") + 1)
    near = (
        first_rows(
            first_rows(paragraphs).withColumn("page_number", F.explode(around)).drop("_n")
        )
        .groupBy(*page)
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_n", "content"))),
                    lambda c: c["content"],
                ),
                "\n\n",
            ).alias("_near")
        )
    )
    return visuals.join(near, page, "left").withColumn(
        "context", F.coalesce("_near", F.lit(NO_NEIGHBOURS))
    ).drop("_near")


# Prompt texts of our own, one per task and one per kind of visual.
TASK_TEMPLATES = {
    "question_answering": "Answer from the passages only and cite them.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
    "summarization": "Summarise the passages: aim, method, findings, limits.\n\nPassages:\n{context}\n\nSummary:",
    "comparison": "Compare the two papers point by point.\n\nFirst paper, {source}:\n{first}\n\nSecond paper, {second_source}:\n{second}\n\nComparison:",
    "literature_survey": "Write a survey on {question} from the passages.\n\nPassages:\n{context}\n\nSurvey:",
    "research_gaps": "Name open problems that the passages leave.\n\nPassages:\n{context}\n\nGaps:",
    "concept_explanation": "Explain {question} with the passages.\n\nPassages:\n{context}\n\nExplanation:",
    "recommendation": "Say which papers suit a reader interested in {question}.\n\nPassages:\n{context}\n\nPapers:",
    "trend_analysis": "Describe the trends that the passages show.\n\nPassages:\n{context}\n\nTrends:",
    "multi_doc_reasoning": "Answer across all papers and say where they agree.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
}
VISUAL_TEMPLATES = {
    "figure": "Explain what this figure shows and how it supports the text.",
    "table": "Explain what this table reports, row by row where it matters.",
    "equation": "Explain this formula symbol by symbol and what it is used for.",
}


def _pick(key: Column, options: dict[str, str]) -> Column:
    out = None
    for name, value in options.items():
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out


def assemble_prompt(rows: DataFrame) -> DataFrame:
    """Add ``prompt`` from ``task, context, question`` and, for comparisons, the names and
    contexts of the two sides (``source, second_source, first, second``).

    A survey without a topic is one on the uploaded papers.
    """
    topic = F.when(
        (F.col("task") == "literature_survey") & ~tx.has_text(F.coalesce("question", F.lit(""))),
        WITHOUT_TOPIC,
    ).otherwise(F.coalesce("question", F.lit("")))
    filled = F.replace(_pick(F.col("task"), TASK_TEMPLATES), F.lit("{question}"), topic)
    for name in ("source", "second_source", "first", "second", "context"):
        value = F.coalesce(name, F.lit("")) if name in rows.columns else F.lit("")
        filled = F.replace(filled, F.lit(f"{{{name}}}"), value)
    return rows.withColumn("prompt", filled)


def assemble_visual_prompt(rows: DataFrame) -> DataFrame:
    """Add ``prompt`` from ``element_type, page_number, context`` and optional extras."""
    def extra(col: str, label: str) -> Column:
        return F.when(
            tx.has_text(F.col(col)), F.concat(F.lit(f"\n{label}:\n"), F.col(col), F.lit("\n"))
        ).otherwise("")

    return rows.withColumn(
        "prompt",
        F.concat(
            F.coalesce(_pick(F.col("element_type"), VISUAL_TEMPLATES),
                       F.lit(VISUAL_TEMPLATES["equation"])),
            F.lit("\n\nText near page "), F.col("page_number").cast("string"), F.lit(":\n"),
            "context", F.lit("\n"),
            extra("image_description", "Stored description"),
            extra("question", "Reader's question"),
        ),
    )


# The label of a request in its answer row, and the stand-ins in it.
QUERY_LABELS = {
    "question_answering": "{question}",
    "summarization": "Summarize: {source}",
    "comparison": "Compare: {source} vs {second_source}",
    "literature_survey": "Literature survey: {question}",
    "research_gaps": "Research gap identification",
    "concept_explanation": "Explain: {question}",
    "recommendation": "Recommend for: {question}",
    "trend_analysis": "Research trend analysis",
    "multi_doc_reasoning": "{question}",
}
ALL_DOCUMENTS = "all documents"
ALL_PAPERS = "all papers"
WITHOUT_TOPIC = "the uploaded research papers"


def query_label(task: Column, question: Column, source: Column, second: Column) -> Column:
    """How an answer row names what was asked."""
    def filled(value: Column, stand_in: Column) -> Column:
        return F.when(tx.has_text(value), value).otherwise(stand_in)

    topic = filled(question, F.when(task == "literature_survey", ALL_PAPERS).otherwise(
        F.coalesce(question, F.lit(""))))
    name = filled(source, F.when(task == "summarization", ALL_DOCUMENTS).otherwise(
        F.coalesce(source, F.lit(""))))
    label = F.replace(_pick(task, QUERY_LABELS), F.lit("{question}"), topic)
    label = F.replace(label, F.lit("{second_source}"), F.coalesce(second, F.lit("")))
    return F.replace(label, F.lit("{source}"), name)


# The answer for a request without hits, per task.
DEFAULT_ANSWERS = {
    "question_answering": "I couldn't find relevant information in the uploaded documents. Please rephrase your question or upload relevant papers.",
    "summarization": "No documents found to summarize.",
    "comparison": "Could not find content for either paper. Make sure both are uploaded.",
    "literature_survey": "No documents available. Please upload research papers first.",
    "research_gaps": "No relevant content found. Please upload research papers first.",
    "concept_explanation": "No relevant content found for '{question}' in the uploaded papers.",
    "recommendation": "No papers available. Please upload research papers first.",
    "trend_analysis": "No documents available for trend analysis.",
    "multi_doc_reasoning": "No relevant content found across the uploaded papers.",
}


def default_answer(task: Column, question: Column) -> Column:
    return F.replace(
        _pick(task, DEFAULT_ANSWERS), F.lit("{question}"), F.coalesce(question, F.lit(""))
    )


def answer_shell(requests: DataFrame, packed: DataFrame, cited: DataFrame,
                 key: str = "task_id") -> DataFrame:
    """One row per request, also without hits.

    ``requests`` has ``task, question`` and may have ``source, second_source``; ``packed`` is the output of ``pack_context`` and
    ``cited`` has ``n_citations`` and whatever else is known of the citations.
    ``chunks_used`` counts the hits before packing.
    """
    extra = [c for c in cited.columns if c not in (key, "n_citations")]
    sides = [c for c in ("first", "second") if c in packed.columns]
    names = [F.col(c) if c in requests.columns else F.lit(None).cast("string")
             for c in ("source", "second_source")]
    return (
        requests.join(packed, key, "left")
        .join(cited, key, "left")
        .select(
            *requests.columns,
            query_label(F.col("task"), F.col("question"), *names).alias("query"),
            *sides,
            F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce("chunks_used", F.lit(0)).alias("chunks_used"),
            F.coalesce("n_citations", F.lit(0)).alias("n_citations"),
            *extra,
            F.when(F.col("chunks_used").isNull(), default_answer(F.col("task"), F.col("question")))
            .alias("default_answer"),
        )
    )


def format_observation(hits: DataFrame, requests: DataFrame) -> DataFrame:
    """Hits of a tool call as the text a reader sees; a fixed line when there are none.

    ``requests`` has ``query_id, content_type, question``.
    """
    section = F.coalesce("section_heading", F.lit(""))
    block = F.concat(
        F.lit("["), F.coalesce("source_file", F.lit(UNKNOWN)), F.lit(", p."),
        F.coalesce(F.col("page_number").cast("string"), F.lit(UNKNOWN)),
        F.when(section != "", F.concat(F.lit(", §"), section)).otherwise(""),
        F.lit("] (score="), fixed(F.col("score"), 2), F.lit(")\n"),
        F.coalesce("content", F.lit("")),
    )
    joined = hits.groupBy("query_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda r: r["b"]
            ),
            "\n\n",
        ).alias("_text")
    )
    # Fixed value: the line for no hits.
    return requests.join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce(
            "_text",
            F.concat(
                F.lit("No relevant "), "content_type", F.lit(" content found for query: '"),
                "question", F.lit("'."),
            ),
        ).alias("observation"),
    )


def table_preview(names: Column, raw: Column, rows: Column, cols: Column) -> Column:
    """Short text for a table: column names, else its first rows, else its shape."""
    lines = F.filter(
        F.transform(
            F.slice(raw, 1, TABLE_PREVIEW_ROWS),
            lambda r: F.array_join(
                F.filter(
                    F.transform(r, lambda c: tx.strip(F.coalesce(c, F.lit("")))),
                    lambda c: c != "",
                ),
                " | ",
            ),
        ),
        lambda line: line != "",
    )
    body = F.left(F.array_join(lines, "\n"), F.lit(TABLE_PREVIEW_CUT))
    header = F.array_join(F.transform(names, lambda c: F.coalesce(c, F.lit(""))), " | ")
    shape = F.concat(
        F.lit("Table · "), F.coalesce(rows.cast("string"), F.lit("?")), F.lit(" rows × "),
        F.coalesce(cols.cast("string"), F.lit("?")), F.lit(" cols"),
    )
    return (
        F.when(F.size(names) > 0, header)
        .when(F.size(lines) > 0, body)
        .when(rows.isNotNull() | cols.isNotNull(), shape)
        .otherwise("Table")
    )
