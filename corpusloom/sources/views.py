"""Working tables derived from the test tables by row-wise expressions.

They give the test data the shapes the operators take (pages, sections, chunk metadata,
catalog rows, traces, judgements). Every view covers its whole base table.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import tasks
from corpusloom.sources.readers import read_table, spread

SOURCE_VECTORS = 100  # vectors per source file
PAGE_VECTORS = 8  # and per page


def div(col: Column | str, n: int) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return F.floor(col / n)


def pick(col: Column, *values: str | None) -> Column:
    """Value number ``col`` of the list."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (col + 1).cast("int"))


# ----------------------------------------------------------------- vectors and queries


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``embeddings`` with provenance columns."""
    return _provenance(read_table(spark, d, "embeddings"), "embedding", "label")


def _provenance(df: DataFrame, *extra: str) -> DataFrame:
    """Metadata that follows from ``vec_id``: blocks of numbers make sources and pages."""
    v = F.col("vec_id")
    kind = pick(div(v, 7) % 4, "text", "table", "figure", "equation")
    no_image = F.lit("")
    return (
        df.withColumn("content_type", kind)
        .select(
            F.concat(F.lit("v"), v).alias("chunk_id"),
            F.concat(F.lit("paper_"), div(v, SOURCE_VECTORS)).alias("source_file"),
            (div(v % SOURCE_VECTORS, PAGE_VECTORS) + 1).cast("int").alias("page_number"),
            F.when(v % 7 == 0, "").otherwise(F.concat(F.lit("S"), v % 5)).alias("section_heading"),
            (v % SOURCE_VECTORS).alias("chunk_index"),
            "content_type",
            F.when(F.col("content_type") == "text", "paragraph")
            .otherwise(F.col("content_type"))
            .alias("element_type"),
            F.when((F.col("content_type") == "figure") | ((F.col("content_type") != "text") & (v % 5 == 0)),
                   F.concat(F.lit("store/fig_"), v, F.lit(".png")))
            .otherwise(no_image)
            .alias("image_path"),
            F.when(F.col("content_type") == "figure", F.concat(F.lit("figure "), v))
            .alias("image_description"),
            F.when(
                F.col("content_type") == "table",
                F.struct(
                    F.lit(2).alias("rows"),
                    F.lit(2).alias("cols"),
                    F.array(
                        F.array(F.lit("id"), F.lit("type")),
                        F.array(v.cast("string"), F.col("content_type")),
                    ).alias("raw"),
                ),
            ).alias("table_data"),
            F.when(F.col("content_type") == "equation", F.concat(F.lit("x_{"), v, F.lit("}")))
            .alias("latex_source"),
            *extra,
        )
    )


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Passage text per chunk id: the document with the vector's number."""
    return read_table(spark, d, "documents").select(
        F.concat(F.lit("v"), "doc_id").alias("chunk_id"), F.col("text").alias("content")
    )


def chunks_with_text(spark: SparkSession, d: str) -> DataFrame:
    """Every vector and every document: one without the other has no text or no label."""
    texts = read_table(spark, d, "documents").select(
        F.col("doc_id").alias("vec_id"), F.col("text").alias("content"))
    labels = read_table(spark, d, "embeddings").select("vec_id", "label")
    return _provenance(labels.join(texts, "vec_id", "full"), "label", "content")


def _mean_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean vector per key; every task sends one partial mean per key."""
    mean = Summarizer.mean(array_to_vector(F.col("embedding").cast("array<double>")))
    return vectors.groupBy(*keys).agg(vector_to_array(mean).alias("vector"))


def label_questions(spark: SparkSession, d: str) -> DataFrame:
    """One question vector per label (ten): the mean of its vectors."""
    return _mean_vectors(chunk_vectors(spark, d), ["label"]).withColumn(
        "query_id", F.concat(F.lit("label_"), "label")
    )


def questions(spark: SparkSession, d: str) -> DataFrame:
    """One question per (label, source), so questions grow with the table.

    Filters and thresholds rotate over unset, empty and set.
    """
    label = F.col("label")
    return _mean_vectors(chunk_vectors(spark, d), ["label", "source_file"]).select(
        F.concat(F.lit("q_"), "label", F.lit("_"), "source_file").alias("query_id"),
        "label",
        "vector",
        F.when(label % 4 >= 2, F.col("source_file")).when(label % 4 == 1, "").alias("filter_source"),
        F.when(label % 3 == 1, "text").when(label % 3 == 2, "").alias("filter_type"),
        F.when(label % 5 == 1, 0.0)
        .when(label % 5 == 2, 0.2)
        .when(label % 5 == 3, 0.6)
        .when(label % 5 == 4, 0.7)
        .alias("similarity_threshold"),
        "source_file",
    )


def task_requests(spark: SparkSession, d: str) -> DataFrame:
    """Every task once per source file."""
    sources = chunk_vectors(spark, d).select("source_file").distinct()
    number = F.substring("source_file", 7, 10).cast("int")
    return sources.select(
        "source_file",
        number.alias("source_no"),
        F.posexplode(F.array(*[F.lit(t) for t in tasks.TASKS])).alias("task_no", "task"),
    ).select(
        F.concat("task", F.lit(":"), "source_file").alias("task_id"),
        "task",
        "task_no",
        "source_no",
        F.concat(F.lit("topic "), "source_no").alias("question"),
        F.col("source_file").alias("source"),
        F.concat(F.lit("paper_"), F.col("source_no") + 1).alias("second_source"),
        F.when(F.col("source_no") % 3 == 1, 3).when(F.col("source_no") % 3 == 2, 25).alias("top_k"),
        F.when(F.col("task_no") % 4 == 1, 0.0).when(F.col("task_no") % 4 == 2, 0.55)
        .when(F.col("task_no") % 4 == 3, 0.6).alias("similarity_threshold"),
    ).withColumn(
        # a survey may come without a topic, a task without a source
        "question", F.when((F.col("task_no") == 3) & (F.col("source_no") % 2 == 0), "")
        .otherwise(F.col("question"))
    ).withColumn(
        "source", F.when((F.col("task_no") != 2) & (F.col("source_no") % 4 == 3), "")
        .otherwise(F.col("source"))
    )


def task_queries(spark: SparkSession, d: str) -> DataFrame:
    """Planned task queries with vectors; each recipe query uses one label's question."""
    requests = task_requests(spark, d)
    planned = tasks.plan_queries(requests).join(
        requests.select("task_id", "task_no", "source_no"), "task_id"
    )
    return planned.withColumn(
        "label", (F.col("task_no") * 3 + F.col("query_no") + F.col("source_no")) % 10
    ).join(label_questions(spark, d).select("label", "vector"), "label").drop(
        "label", "task_no", "source_no"
    )


def image_meta(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of stored images, sides 40 to 139; some could not be read (NULL), some are gone."""
    return (
        chunk_vectors(spark, d)
        .where(F.col("image_path") != "")
        .select("image_path", F.regexp_extract("image_path", r"(\d+)", 1).cast("long").alias("n"))
        .where(F.col("n") % 13 > 0)
        .select(
            "image_path",
            F.when(F.col("n") % 9 > 0, F.col("n") % 100 + 40).cast("int").alias("width"),
            F.when(F.col("n") % 9 > 0, F.col("n") * 7 % 100 + 40).cast("int").alias("height"),
        )
    )


# ------------------------------------------------------------------- documents, lines


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(read_table(spark, d, "documents")).select(
        F.concat(F.lit("doc_"), "doc_id").alias("source_file"), "doc_id", "text", "lang", "source",
        "n_chars",
    )


def doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines of the documents, the first as a title, with heading lines put in between."""
    raw = documents(spark, d).select(
        "source_file", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "raw")
    )
    turn = F.col("line_no") % 12
    heading = (
        F.when(turn == 4, "1. Introduction").when(turn == 7, "Results: ")
        .when(turn == 10, "2.3 Related Work ")
    )
    both = raw.select(
        "source_file", (div("line_no", 40) + 1).cast("int").alias("page_number"),
        F.col("line_no").alias("_n"), F.posexplode(F.array(heading, F.col("raw"))).alias("_p", "line"),
    )
    return both.select(
        "source_file", "page_number", (F.col("_n") * 2 + F.col("_p")).alias("line_no"),
        tx.strip(F.col("line")).alias("text"),
        F.when((F.col("_n") == 0) & (F.col("_p") == 1), 16.0).otherwise(11.0).alias("font_size"),
    ).where(F.col("text") != "")


def spans(spark: SparkSession, d: str) -> DataFrame:
    """Words of the document lines as spans, with gaps: no size, blanks, image blocks."""
    line = F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")
    lines = documents(spark, d).select("source_file", line)
    return lines.select(
        "source_file",
        (div("line_no", 40) + 1).cast("int").alias("page_number"),
        F.lit(0).alias("block_no"),
        (F.col("line_no") % 9 == 8).cast("int").alias("block_type"),
        "line_no",
        F.posexplode(F.split("line", " ")).alias("span_no", "text"),
    ).withColumn(
        "size",
        F.when(F.col("span_no") % 4 == 1, F.lit(None).cast("double")).otherwise(
            F.lit(9.0) + F.col("span_no") % 6
        ),
    )


def doc_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Document lines as text chunks; two documents share one file name."""
    return (
        read_table(spark, d, "documents")
        .select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("chunk_index", "content"))
        .where(tx.has_text(F.col("content")))
        .select(
            F.concat(F.lit("d"), "doc_id", F.lit("_"), "chunk_index").alias("chunk_id"),
            F.concat(F.lit("paper_"), div("doc_id", 2), F.lit(".pdf")).alias("source_file"),
            (div("chunk_index", 40) + 1).cast("int").alias("page_number"),
            F.when(F.col("chunk_index") % 6 == 0, "").otherwise("Body").alias("section_heading"),
            "chunk_index",
            F.lit("text").alias("content_type"),
            F.lit("paragraph").alias("element_type"),
            "content",
        )
    )


def raw_tables(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as small tables of cells: one table per order, some cells NULL.

    Orders without lines become empty tables.
    """
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag")
    rows = (
        read_table(spark, d, "lineitem")
        .groupBy("l_orderkey")
        .agg(  # the columns as they are go through the shuffle, the cells are made behind it
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", flag))
                ),
                lambda r: F.array(
                    r["l_linenumber"].cast("string"), r["l_partkey"].cast("string"), r["flag"]
                ),
            ).alias("cells")
        )
    )
    header = F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flag")))
    return (
        read_table(spark, d, "orders")
        .select("o_orderkey")
        .join(rows, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        .select(
            F.concat(F.lit("doc_"), div("o_orderkey", 10)).alias("source_file"),
            (div("o_orderkey", 5) % 2 + 1).cast("int").alias("page_number"),
            F.col("o_orderkey").alias("table_idx"),
            F.when(F.col("cells").isNotNull(), F.concat(header, F.col("cells")))
            .otherwise(F.array().cast("array<array<string>>"))
            .alias("raw"),
        )
    )


def page_images(spark: SparkSession, d: str) -> DataFrame:
    """Parts as page images: eight images per document on two pages."""
    p = F.col("p_partkey")
    return read_table(spark, d, "part").select(
        F.concat(F.lit("doc_"), div(p, 8)).alias("source_file"),
        (div(p, 4) % 2 + 1).cast("int").alias("page_number"),
        p.alias("seq"),
        pick(p % 3, "png", "jpeg", "jpg").alias("ext"),
    )


# -------------------------------------------------------------------------- catalog


def catalog(spark: SparkSession, d: str) -> DataFrame:
    """One row per document; two ids share a file name, failed rows have no counts."""
    doc = F.col("doc_id")
    failed = doc % 4 == 3
    return read_table(spark, d, "documents").select(
        F.concat(F.lit("d"), doc).alias("id"),
        F.concat(F.lit("paper_"), div(doc, 2), F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/store/d"), doc).alias("file_path"),
        F.lit("pdf").alias("file_type"),
        F.when(~failed, F.ceil(F.col("n_chars") / 2000)).cast("int").alias("total_pages"),
        F.when(~failed, F.ceil(F.col("n_chars") / 462)).cast("int").alias("total_chunks"),
        (
            F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
            + F.make_dt_interval(mins=div(doc, 3).cast("int"))
        )
        .cast("timestamp")
        .alias("ingested_at"),
        pick(doc % 4, "completed", "completed", "processing", "failed").alias("status"),
    )


def status_events(spark: SparkSession, d: str) -> DataFrame:
    """Event log as document lifecycle updates."""
    return read_table(spark, d, "events").select(
        F.concat(F.lit("d"), "user_id").alias("id"),
        F.when(F.col("event_type") == "signup", "pending")
        .when(F.col("event_type").isin("click", "view"), "processing")
        .when(F.col("event_type") == "purchase", "completed")
        .otherwise("failed")
        .alias("status"),
        F.when(F.col("event_type") == "purchase", F.floor("value").cast("int")).alias("total_chunks"),
        F.when(F.col("event_type") == "purchase", F.floor(F.col("value") / 10).cast("int")).alias(
            "total_pages"
        ),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("version"),
    )


def catalog_rows_from_events(spark: SparkSession, d: str) -> DataFrame:
    return status_events(spark, d).select(
        "id",
        F.concat(F.lit("paper_u_"), "id", F.lit(".pdf")).alias("filename"),
        F.concat(F.lit("/store/"), "id").alias("file_path"),
        F.lit("pdf").alias("file_type"),
        "total_pages",
        "total_chunks",
        F.date_trunc("second", "ts").alias("ingested_at"),
        "status",
        "version",
    )


def some_ids(spark: SparkSession, d: str) -> DataFrame:
    """Requested document ids from the label table; a part of them does not exist."""
    return read_table(spark, d, "labels").select(
        F.concat(F.lit("d"), F.col("doc_id") * 3).alias("id")
    )


# --------------------------------------------------------- traces, replies, judgements


def agent_steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as the steps of runs of ten."""
    e = F.col("event_id")
    return read_table(spark, d, "events").select(
        F.concat(F.lit("run_"), div(e, 10)).alias("run_id"),
        (e % 10 + 1).cast("int").alias("step_number"),
        F.concat(F.lit("look at "), "event_type").alias("thought"),
        F.when(F.col("event_type") == "signup", "search_text")
        .when(F.col("event_type") == "click", "Search_Tables")
        .when(F.col("event_type") == "view", "get_paper_preview")
        .when(F.col("event_type") == "error", "lookup")
        .otherwise("finish")
        .alias("action"),
        F.col("props").alias("action_input_json"),
        F.repeat(F.concat("props", F.lit(" ")), F.floor(F.col("value")).cast("int")).alias(
            "observation"
        ),
        (div(e, 10) % 3 + 2).cast("int").alias("hops"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 20)).alias("correct"),
    )


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Labels as 1 / 5 ratings of the documents' language on two dimensions."""
    known = F.when(F.col("doc_id") % 10 > 0, F.col("lang"))
    docs = read_table(spark, d, "documents").select("doc_id", known.alias("question_type"))
    labels = read_table(spark, d, "labels")
    return labels.join(docs, "doc_id").select(
        "question_type",
        F.explode(
            F.array(
                F.struct(F.lit("quality").alias("dimension"), (F.col("quality") * 4 + 1).alias("score")),
                F.struct(F.lit("safety").alias("dimension"), (F.lit(5) - F.col("toxic") * 4).alias("score")),
            )
        ).alias("r"),
    ).select("question_type", "r.dimension", "r.score")


def rewrite_versions(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as scored versions (pass 0 to 3) of texts; one version per pass."""
    o = F.col("o_orderkey")
    orders = read_table(spark, d, "orders").select(
        o.alias("text_id"), F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pass"),
        "o_totalprice", "o_custkey", "o_orderpriority",
    )
    o = F.col("text_id")
    score = F.floor(F.floor(F.col("o_totalprice") * 100 + o * 13) % 97 / (F.col("pass") + 1))
    return orders.select(
        "text_id",
        "pass",
        score.cast("double").alias("score"),
        ((F.col("o_custkey") + F.col("pass") * 37) % 90 / 100).alias("burstiness"),
        ((F.col("o_custkey") * 3 + F.col("pass") * 11) % 80 / 100).alias("ttr"),
        ((o + F.col("pass")) % 5).cast("int").alias("human_markers"),
        F.array(
            F.concat(F.lit("varied openings "), (F.col("pass") % 2).cast("string")),
            F.concat(F.lit("priority "), "o_orderpriority"),
            F.concat(F.lit("pass "), F.col("pass").cast("string")),
        ).alias("changes"),
    )
