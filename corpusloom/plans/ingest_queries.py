"""Ingest, text retrieval and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import chunking, elements, embedding, evaluation, retrieval, tasks
from corpusloom.plans import answer, ingest
from corpusloom.plans import retrieval_queries as rq
from corpusloom.plans import sqltext as sx
from corpusloom.plans.registry import cte, query
from corpusloom.session import materialize, new_table_path
from corpusloom.sources import readers, views
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import status


@query("chunk_text")
def chunk_text(spark, d):
    return ingest.chunk_documents(views.documents(spark, d)).select(
        "chunk_id", "source_file", "page_number", "section_heading", "chunk_index", "content"
    )


@query("split_chunks")
def split_chunks(spark, d):
    """The splitter from SQL, over whole documents: a lateral join with a table function."""
    chunking.register_split_chunks(spark)
    return spark.sql(
        """SELECT source_file, piece_no, content
        FROM {docs}, LATERAL split_chunks(text, 512, 50)""", docs=views.documents(spark, d))


WHOLE = 1 << 30  # no section is longer: a chunk per section, which SQL can state too

cte("plain_sections", sx.sections("(SELECT * REPLACE (12.0 AS font_size) FROM plain_lines)"),
    ("plain_lines",))
cte("ingested", """
SELECT source_file, 'text' AS content_type, page_number, section_heading, content,
  row_number() OVER (PARTITION BY source_file ORDER BY line_no) - 1 AS chunk_index
FROM plain_sections
UNION ALL
SELECT source_file, element_type, page_number, section_heading, content,
  coalesce(n, 0) + row_number() OVER (PARTITION BY source_file
    ORDER BY type_order, page_number, element_no) - 1
FROM elements_sql LEFT JOIN (SELECT source_file, count(*) AS n FROM plain_sections GROUP BY source_file)
  USING (source_file)
WHERE element_type <> 'text'
""", ("plain_sections", "elements_sql"))


def atomic(spark, d):
    """Tables and figures of the documents."""
    return elements.union_elements(
        elements.table_elements(views.raw_tables(spark, d)),
        elements.figure_elements(views.page_images(spark, d)),
        first=1,
    )


@query("ingest_batch", """
SELECT source_file, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END AS status,
  coalesce(n, 0) AS total_chunks, coalesce(p, 0) AS total_pages
FROM (SELECT 'doc_' || doc_id AS source_file FROM documents UNION SELECT source_file FROM ingested)
LEFT JOIN (SELECT source_file, max(page_number) AS p, count(*) AS n FROM ingested
           GROUP BY source_file) USING (source_file)
""", ("ingested",))
def ingest_batch(spark, d):
    """Text, tables and figures of all documents; a section is a chunk."""
    return ingest.ingest_batch(
        views.documents(spark, d), atomic=atomic(spark, d), size=WHOLE)[1]


@query("ingest_chunks", """
SELECT source_file, content_type, page_number, section_heading, content, chunk_index,
  sha256(source_file || '|' || chunk_index || '|' || content) AS chunk_id FROM ingested
""", ("ingested",))
def ingest_chunks(spark, d):
    return ingest.all_chunks(views.documents(spark, d), atomic(spark, d), WHOLE).select(
        "source_file", "content_type", "page_number", "section_heading", "content", "chunk_index",
        "chunk_id")


@query("store_batch_twice", """
SELECT content_type, count(*) AS n_chunks, count(DISTINCT source_file || '|' || chunk_index) AS n_ids,
  count(DISTINCT source_file) AS n_files, 'completed' AS status
FROM ingested GROUP BY content_type
""", ("ingested",))
def store_batch_twice(spark, d):
    """The store after the same batch came twice, with the catalog's status of its files."""
    store, catalog = new_table_path(spark, "store"), new_table_path(spark, "catalog")
    for _ in range(2):
        ingest.store_batch(views.documents(spark, d), store, catalog, atomic=atomic(spark, d),
                           size=WHOLE)
    listed = ingest.read_store(spark, catalog).select(
        F.col("filename").alias("source_file"), "status")
    chunks = stream.stored_chunks(spark, store).select(
        "source_file", "content_type", F.unhex("chunk_id").alias("id"))  # half as long
    return chunks.join(listed, "source_file").groupBy("content_type", "status").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("id").alias("n_ids"),
        F.count_distinct("source_file").alias("n_files"))


cte("after_edit", sx.sections("""(
  SELECT * REPLACE (12.0 AS font_size) FROM plain_lines
  WHERE CAST(substr(source_file, 5) AS BIGINT) % 4 <> 1
    AND (CAST(substr(source_file, 5) AS BIGINT) % 4 <> 0 OR line_no < 2))"""), ("plain_lines",))


@query("store_batch_changed", """
SELECT source_file, chunk_index, content, status, total_chunks FROM (
  SELECT 'doc_' || doc_id AS source_file FROM documents)
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_no) - 1 AS chunk_index
           FROM after_edit) USING (source_file)
JOIN (SELECT 'doc_' || doc_id AS source_file, CASE WHEN n IS NULL THEN 'failed' ELSE 'completed' END
        AS status, coalesce(n, 0) AS total_chunks
      FROM documents LEFT JOIN (SELECT source_file, count(*) AS n FROM after_edit GROUP BY source_file)
        ON source_file = 'doc_' || doc_id) USING (source_file)
""", ("after_edit",))
def store_batch_changed(spark, d):
    """The store after files came again: shortened, without any text, or edited and put right.

    Every file of the catalog with its chunks; a failed one has none left.
    """
    chunks, catalog = new_table_path(spark, "store"), new_table_path(spark, "catalog")
    docs = views.documents(spark, d)
    turn = F.col("doc_id") % 4
    shorter = F.concat_ws("\n", F.slice(F.split("text", "\n"), 1, 2))
    edits = (
        docs,
        docs.where(turn < 3).withColumn(
            "text", F.when(turn == 0, shorter).when(turn == 1, "")
            .otherwise(F.concat(F.col("text"), F.lit("\nan edit")))),
        docs.where(turn == 2),  # as they were at first
    )
    for batch in edits:
        ingest.store_batch(batch, chunks, catalog, size=WHOLE)
    listed = ingest.read_store(spark, catalog).select(
        F.col("filename").alias("source_file"), "status", "total_chunks")
    stored = stream.stored_chunks(spark, chunks).select("source_file", "chunk_index", "content")
    return listed.join(stored, "source_file", "left")


@query("delete_documents", """
SELECT d.id, f.source_file IS NOT NULL AS found, coalesce(n, 0) AS removed_chunks,
  (SELECT count(*) FROM ingested WHERE source_file NOT IN (SELECT 'doc_' || (doc_id * 3) FROM labels))
    AS chunks_left
FROM (SELECT DISTINCT sha256('doc_' || (doc_id * 3)) AS id, 'doc_' || (doc_id * 3) AS source_file
      FROM labels) d
LEFT JOIN (SELECT 'doc_' || doc_id AS source_file FROM documents UNION SELECT source_file FROM ingested) f
  USING (source_file)
LEFT JOIN (SELECT source_file, count(*) AS n FROM ingested GROUP BY source_file) USING (source_file)
""", ("ingested",))
def delete_documents(spark, d):
    """Documents of a store deleted by id; some ids are unknown."""
    store, catalog = new_table_path(spark, "store"), new_table_path(spark, "catalog")
    ingest.store_batch(views.documents(spark, d), store, catalog, atomic=atomic(spark, d), size=WHOLE)
    ids = readers.read_table(spark, d, "labels").select(
        F.sha2(F.concat(F.lit("doc_"), F.col("doc_id") * 3), 256).alias("id"))
    report = ingest.delete_documents(spark, ids, store, catalog)
    return report.withColumn("chunks_left", F.lit(stream.stored_chunks(spark, store).count()))


@query("embed_texts")
def embed_texts(spark, d):
    embedded, _, _ = ingest.ingest_batch(views.documents(spark, d))
    return embedded.select("chunk_id", "source_file", "chunk_index", "embedding")


_counts = ", ".join(f"length(text) - length(replace(text, '{c}', ''))" for c in "etaoinsr")


@query("embed_with_function", f"""
SELECT doc_id, 8 AS dim, round((v[1] / n)::FLOAT::DOUBLE, 4) AS first_value,
  round((v[8] / n)::FLOAT::DOUBLE, 4) AS last_value
FROM (SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-9) AS n
      FROM (SELECT doc_id, [{_counts}]::DOUBLE[] AS v FROM documents))
""")
def embed_with_function(spark, d):
    """A user's batch function in place of the default model."""

    def letter_shares(texts):
        out = []
        for t in texts:
            counts = [float(t.count(c)) for c in "etaoinsr"]
            size = sum(c * c for c in counts) ** 0.5 or 1.0
            out.append([c / size for c in counts])
        return out

    docs = readers.read_table(spark, d, "documents").select("doc_id", "text")
    return embedding.embed_with(docs, letter_shares, "text").select(
        "doc_id",
        F.size("embedding").alias("dim"),
        F.round(F.get("embedding", F.lit(0)).cast("double"), 4).alias("first_value"),
        F.round(F.get("embedding", F.lit(7)).cast("double"), 4).alias("last_value"),
    )


@query("text_search")
def text_search(spark, d):
    """Benchmark passages as questions against all document chunks."""
    chunks, _, model = ingest.ingest_batch(views.documents(spark, d))
    texts = readers.read_table(spark, d, "benchmark").select(
        F.concat(F.lit("item_"), "item_id").alias("query_id"), "text"
    )
    questions = materialize(model.embed(texts, "text", "vector").drop("text"), "questions")
    hits = materialize(retrieval.retrieve(questions, chunks, 10), "hits")
    return retrieval.attach_chunks(hits, chunks).select(
        "query_id", "rank", "score", "chunk_id", "source_file", "page_number", "content"
    )


@query("answer_requests")
def answer_requests(spark, d):
    """Every task for every benchmark passage as the question, over all document chunks."""
    chunks, _, model = ingest.ingest_batch(views.documents(spark, d), atomic=atomic(spark, d))
    item = F.col("item_id").cast("string")
    requests = readers.read_table(spark, d, "benchmark").select(
        F.explode(F.array(*[F.lit(t) for t in tasks.TASKS])).alias("task"),
        item.alias("item"),
        F.col("text").alias("question"),
        F.concat(F.lit("doc_"), item).alias("source"),
        F.concat(F.lit("doc_"), F.col("item_id") + 1).alias("second_source"),
    ).withColumn("task_id", F.concat("task", F.lit(":"), "item"))
    return answer.answer_requests(
        requests, chunks, lambda queries: model.embed(queries, "query_text", "vector")
    )


@query("ann_recall", """
SELECT query_id, round(avg((a.chunk_id IS NOT NULL)::INT), 6) AS recall
FROM hits_plain h LEFT JOIN (SELECT query_id, chunk_id FROM ann_hits) a USING (query_id, chunk_id)
GROUP BY query_id
""", ("hits_plain", "ann_hits"))
def ann_recall(spark, d):
    """Recall of the search over the labels' cells."""
    questions = rq.plain_asked(spark, d)
    exact = retrieval.knn_exact(questions, views.chunk_vectors(spark, d), 10)
    return evaluation.ann_recall(exact, rq.knn_ann_label_cells(spark, d)).withColumn(
        "recall", F.round("recall", 6))


# ------------------------------------------------------------------------- streaming


def _status_stream(spark, d):
    """The event file as a stream of lifecycle updates."""
    events = stream.table_stream(spark, d, "events", schemas.EVENTS)
    kind = F.col("event_type")
    done = kind == "purchase"
    return events.select(
        F.concat(F.lit("d"), "user_id").alias("id"),
        F.when(kind == "signup", "pending")
        .when(kind.isin("click", "view"), "processing")
        .when(done, "completed")
        .otherwise("failed")
        .alias("status"),
        F.when(done, F.floor("value")).alias("total_chunks"),
        F.when(done, F.floor(F.col("value") / 10)).alias("total_pages"),
        F.col("event_id").alias("version"),
    )


@query("stream_status", """
SELECT id, arg_max(status, version) AS status, count(*) AS n_updates FROM status_events GROUP BY id
""", ("status_events",))
def stream_status(spark, d):
    return status.run_to_end(spark, status.latest_status(_status_stream(spark, d)), "status", "id")


@query("stream_corpus_stats", """
SELECT status, count(*) AS n_documents,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN total_pages END), 0) AS BIGINT) AS n_pages,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN total_chunks END), 0) AS BIGINT) AS n_chunks
FROM (SELECT id, arg_max(status, version) AS status, max_by(r, version).p AS total_pages,
        max_by(r, version).c AS total_chunks
      FROM (SELECT *, {'p': total_pages, 'c': total_chunks} AS r FROM status_events) GROUP BY id)
GROUP BY status
""", ("status_events",))
def stream_corpus_stats(spark, d):
    rows = status.run_to_end(spark, status.latest_rows(_status_stream(spark, d)), "rows", "id")
    return status.corpus_totals(rows)


@query("stream_ingest", """
SELECT source_file, chunk_index, content, 'completed' AS status,
  sha256(source_file || '|' || chunk_index || '|' || content) AS chunk_id
FROM ingested WHERE content_type = 'text'
""", ("ingested",))
def stream_ingest(spark, d):
    docs = stream.table_stream(spark, d, "documents", schemas.DOCUMENTS).select(
        F.concat(F.lit("doc_"), "doc_id").alias("source_file"), "text"
    )
    store, catalog = new_table_path(spark, "stream-chunks"), new_table_path(spark, "stream-catalog")
    stream.stream_ingest(
        docs, store, catalog, new_table_path(spark, "stream-state"), size=WHOLE).awaitTermination()
    listed = ingest.read_store(spark, catalog).select(
        F.col("filename").alias("source_file"), "status")
    return stream.stored_chunks(spark, store).join(listed, "source_file").select(
        "chunk_id", "source_file", "chunk_index", "content", "status")
