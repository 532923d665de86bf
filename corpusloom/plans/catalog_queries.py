"""Queries over the document catalog and the chunk store."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog as cat
from corpusloom.plans.registry import cte, query
from corpusloom.plans.sqltext import strip  # noqa: F401  (loads the shared CTEs)
from corpusloom.sources import readers, views

STAMP = "yyyy-MM-dd HH:mm:ss"
SQL_STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def shown(df):
    return df.withColumn("ingested_at", F.date_format("ingested_at", STAMP))


def uploads(spark, d):
    """Documents as uploads: names repeat and extensions differ in case."""
    doc = F.col("doc_id")
    return readers.read_table(spark, d, "documents").select(
        F.concat(
            "source", F.lit("_"), "lang", F.lit("."), views.pick(doc % 4, "pdf", "PDF", "txt", "Pdf")
        ).alias("filename"),
        doc.alias("seq"),
        "n_chars",
    )


cte("uploads", """
SELECT source || '_' || lang || '.' || ['pdf', 'PDF', 'txt', 'Pdf'][doc_id % 4 + 1] AS filename,
  doc_id AS seq, n_chars FROM documents
""")


@query("scan_corpus", "SELECT * FROM uploads WHERE lower(filename) LIKE '%.pdf'", ("uploads",))
def scan_corpus(spark, d):
    return cat.accept_extension(uploads(spark, d))


@query("dedup_by_filename", """
SELECT filename, min(seq) AS seq, arg_min(n_chars, seq) AS n_chars FROM uploads GROUP BY filename
""", ("uploads",))
def dedup_by_filename(spark, d):
    return cat.dedup_by_filename(uploads(spark, d))


cte("event_rows", """
SELECT id, 'paper_u_' || id || '.pdf' AS filename, '/store/' || id AS file_path, 'pdf' AS file_type,
  total_pages, total_chunks, date_trunc('second', ts) AS ingested_at, status, version
FROM status_events
""", ("status_events",))


@query("catalog_upsert", f"""
SELECT * EXCLUDE (version, n) REPLACE ({SQL_STAMP.format('ingested_at')} AS ingested_at) FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS n FROM (
    SELECT *, -1 AS version FROM catalog UNION ALL BY NAME SELECT * FROM event_rows))
WHERE n = 1
""", ("catalog", "event_rows"))
def catalog_upsert(spark, d):
    return shown(cat.catalog_upsert(views.catalog(spark, d), views.catalog_rows_from_events(spark, d)))


@query("catalog_apply_status", f"""
SELECT c.id, c.filename, c.file_path, c.file_type,
  CASE WHEN u.id IS NULL THEN c.total_pages ELSE coalesce(u.total_pages, 0) END AS total_pages,
  CASE WHEN u.id IS NULL THEN c.total_chunks ELSE coalesce(u.total_chunks, 0) END AS total_chunks,
  {SQL_STAMP.format('c.ingested_at')} AS ingested_at, coalesce(u.status, c.status) AS status
FROM catalog c LEFT JOIN (
  SELECT id, arg_max(status, version) AS status, max_by(s, version).pages AS total_pages,
    max_by(s, version).chunks AS total_chunks
  FROM (SELECT *, {{'pages': total_pages, 'chunks': total_chunks}} AS s FROM status_events)
  GROUP BY id) u ON c.id = u.id
""", ("catalog", "status_events"))
def catalog_apply_status(spark, d):
    return shown(cat.catalog_apply_status(views.catalog(spark, d), views.status_events(spark, d)))


@query("catalog_lookup", f"""
SELECT * REPLACE ({SQL_STAMP.format('ingested_at')} AS ingested_at) FROM catalog
WHERE id IN (SELECT id FROM some_ids)
""", ("catalog", "some_ids"))
def catalog_lookup(spark, d):
    return shown(cat.catalog_lookup(views.catalog(spark, d), views.some_ids(spark, d)))


@query("catalog_list", f"""
SELECT * EXCLUDE (file_path) REPLACE ({SQL_STAMP.format('ingested_at')} AS ingested_at)
FROM catalog ORDER BY ingested_at DESC, id
""", ("catalog",))
def catalog_list(spark, d):
    return shown(cat.catalog_list(views.catalog(spark, d)))


def _cascade(spark, d):
    return cat.catalog_delete_cascade(
        views.catalog(spark, d), views.doc_chunks(spark, d), views.some_ids(spark, d)
    )


cte("doomed", "SELECT id, filename FROM catalog WHERE id IN (SELECT id FROM some_ids)",
    ("catalog", "some_ids"))


@query("catalog_delete_cascade", """
SELECT i.id, d.filename IS NOT NULL AS found, coalesce(n, 0) AS removed_chunks
FROM (SELECT DISTINCT id FROM some_ids) i LEFT JOIN doomed d USING (id)
LEFT JOIN (SELECT source_file, count(*) AS n FROM doc_chunks GROUP BY source_file) c
  ON c.source_file = d.filename
""", ("doomed", "doc_chunks"))
def catalog_delete_cascade(spark, d):
    return _cascade(spark, d)[2]


@query("catalog_after_delete", """
SELECT id, filename, status FROM catalog WHERE id NOT IN (SELECT id FROM some_ids)
""", ("catalog", "some_ids"))
def catalog_after_delete(spark, d):
    return _cascade(spark, d)[0].select("id", "filename", "status")


@query("chunks_after_delete", """
SELECT chunk_id, source_file FROM doc_chunks
WHERE source_file NOT IN (SELECT filename FROM doomed)
""", ("doc_chunks", "doomed"))
def chunks_after_delete(spark, d):
    return _cascade(spark, d)[1].select("chunk_id", "source_file")


def versioned_chunks(spark, d):
    """Chunks sent twice: the second time with a new section, some without a vector."""
    chunks = views.chunk_vectors(spark, d).withColumn(
        "version", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long")))
    )
    return chunks.withColumn(
        "embedding", F.when((F.col("version") == 0) | (F.col("label") != 3), F.col("embedding"))
    ).withColumn(
        "section_heading", F.concat("section_heading", F.lit("/"), F.col("version").cast("string"))
    )


@query("chunk_upsert", """
SELECT chunk_id, source_file, section_heading, content_type, image_path,
  coalesce(image_description, '') AS image_description, coalesce(latex_source, '') AS latex_source,
  CASE WHEN content_type = 'table' THEN '{"rows":2,"cols":2,"raw":[["id","type"],["' || vec_id ||
    '","' || content_type || '"]]}' ELSE '' END AS table_data_json
FROM (SELECT * REPLACE (section_heading || CASE WHEN label <> 3 THEN '/1' ELSE '/0' END
        AS section_heading) FROM cv)
""", ("cv",))
def chunk_upsert(spark, d):
    return cat.chunk_upsert(None, versioned_chunks(spark, d)).select(
        "chunk_id", "source_file", "section_heading", "content_type", "image_path",
        "image_description", "latex_source", "table_data_json",
    )


@query("list_sources", """
SELECT DISTINCT source_file FROM doc_chunks WHERE source_file <> '' ORDER BY source_file
""", ("doc_chunks",))
def list_sources(spark, d):
    return cat.list_sources(views.doc_chunks(spark, d))


@query("chunk_count", "SELECT count(*) AS n_chunks FROM doc_chunks", ("doc_chunks",))
def chunk_count(spark, d):
    return cat.chunk_count(views.doc_chunks(spark, d))


@query("chunks_by_ids", """
SELECT chunk_id, source_file, page_number, section_heading, content_type FROM cv
WHERE chunk_id IN (SELECT 'v' || doc_id FROM labels)
""", ("cv",))
def chunks_by_ids(spark, d):
    ids = readers.read_table(spark, d, "labels").select(F.concat(F.lit("v"), "doc_id").alias("chunk_id"))
    return cat.chunks_by_ids(views.chunk_vectors(spark, d), ids).select(
        "chunk_id", "source_file", "page_number", "section_heading", "content_type"
    )


@query("chunks_by_source", """
SELECT chunk_id, source_file, chunk_index, content FROM doc_chunks
WHERE source_file IN (SELECT 'paper_' || doc_id || '.pdf' FROM labels WHERE toxic = 1)
""", ("doc_chunks",))
def chunks_by_source(spark, d):
    wanted = readers.read_table(spark, d, "labels").where("toxic = 1").select(
        F.concat(F.lit("paper_"), "doc_id", F.lit(".pdf")).alias("source_file")
    )
    return cat.chunks_by_source(views.doc_chunks(spark, d), wanted).select(
        "chunk_id", "source_file", F.col("chunk_index").cast("int").alias("chunk_index"), "content"
    )


@query("completed_papers", """
SELECT id, '- ' || filename || '  (' || total_pages || ' pages, ' || total_chunks || ' chunks)' AS line
FROM catalog WHERE status = 'completed'
""", ("catalog",))
def completed_papers(spark, d):
    return cat.completed_papers(views.catalog(spark, d)).select("id", "line")


@query("corpus_stats", """
SELECT count(*) AS n_papers, CAST(sum(coalesce(total_pages, 0)) AS BIGINT) AS n_pages,
  CAST(sum(coalesce(total_chunks, 0)) AS BIGINT) AS n_chunks FROM catalog
""", ("catalog",))
def corpus_stats(spark, d):
    return cat.corpus_stats(views.catalog(spark, d))


@query("any_processing", """
SELECT coalesce(bool_or(status = 'processing'), false) AS any_processing FROM catalog
""", ("catalog",))
def any_processing(spark, d):
    return cat.any_processing(views.catalog(spark, d))


@query("comparable_pairs", """
SELECT a.id AS first, b.id AS second, a.filename AS first_file, b.filename AS second_file
FROM (SELECT doc_id, doc_id + 1 + 4 * quality AS other FROM labels) r
JOIN catalog a ON a.id = 'd' || r.doc_id JOIN catalog b ON b.id = 'd' || r.other
WHERE a.status = 'completed' AND b.status = 'completed' AND a.filename <> b.filename
""", ("catalog",))
def comparable_pairs(spark, d):
    requests = readers.read_table(spark, d, "labels").select(
        F.concat(F.lit("d"), "doc_id").alias("first"),
        F.concat(F.lit("d"), F.col("doc_id") + 1 + 4 * F.col("quality")).alias("second"),
    )
    return cat.comparable_pairs(views.catalog(spark, d), requests)


@query("ingest_outcome", """
SELECT d.source_file,
  CASE WHEN coalesce(n, 0) > 0 THEN 'completed' ELSE 'failed' END AS status,
  coalesce(n, 0) AS total_chunks,
  CASE WHEN coalesce(n, 0) > 0 THEN coalesce(p, 0) ELSE 0 END AS total_pages
FROM (SELECT 'doc_' || doc_id AS source_file FROM documents
      UNION SELECT 'doc_' || (doc_id * 3) FROM labels) d
LEFT JOIN (SELECT source_file, count(*) AS n, max(page_number) AS p FROM plain_lines
           GROUP BY source_file) l USING (source_file)
""", ("plain_lines",))
def ingest_outcome(spark, d):
    from corpusloom.operators import elements

    lines = elements.text_lines(views.documents(spark, d))
    asked = views.documents(spark, d).select("source_file").union(
        readers.read_table(spark, d, "labels").select(F.concat(F.lit("doc_"), F.col("doc_id") * 3))
    ).distinct()
    return cat.ingest_outcome(asked, lines, lines, elements.page_count(lines))


@query("status_latest", """
SELECT id, arg_max(status, version) AS status, count(*) AS n_updates FROM status_events GROUP BY id
""", ("status_events",))
def status_latest(spark, d):
    from corpusloom.streaming.status import latest_status

    return latest_status(views.status_events(spark, d))
