"""Queries over the vector tables: search, merging, tasks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import embedding, retrieval
from corpusloom.plans import answer
from corpusloom.plans import sqltext as sx
from corpusloom.plans.registry import cte, query
from corpusloom.session import materialize, new_table_path
from corpusloom.sources import readers, views


def asked(spark, d):
    """The question table, computed once: making its vectors reads the whole chunk table."""
    return materialize(views.questions(spark, d), "questions")


def plain_asked(spark, d):
    """The same without filters and thresholds."""
    return asked(spark, d).select("query_id", "label", "vector")


def asked_tasks(spark, d, task=None):
    planned = views.task_queries(spark, d)
    if task:
        planned = planned.where(F.col("task") == task)
    return materialize(planned, "task-queries")


@query("similarity", """
SELECT c.chunk_id, round((1 + list_cosine_similarity(l.vector, c.embedding)) / 2, 6) AS score
FROM cv c JOIN label_q l USING (label)
""", ("cv", "label_q"))
def similarity(spark, d):
    centre = materialize(views.label_questions(spark, d), "labels")
    centre = centre.select("label", "vector")
    return views.chunk_vectors(spark, d).join(centre, "label").select(
        "chunk_id",
        F.round(vectors.similarity(F.col("vector"), F.col("embedding")), 6).alias("score"),
    )


@query("l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(n, lambda x: x * x)), 6) AS unit_norm,
  round(n[1], 6) AS first_value, len(n) AS dim
FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS n
      FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS e FROM embeddings))
""")
def l2_normalize(spark, d):
    scaled = readers.read_table(spark, d, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: x.cast("double") * 3).alias("embedding")
    )
    n = embedding.l2_normalize(scaled)
    return n.select(
        "vec_id",
        F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("unit_norm"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
        F.size("embedding").cast("long").alias("dim"),
    )


@query("embedding_profile", """
SELECT count(*) AS n_rows, count(*) FILTER (embedding IS NULL) AS n_null,
  min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim,
  round(min(n), 5) AS min_norm, round(max(n), 5) AS max_norm
FROM (SELECT embedding, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n
      FROM embeddings)
""")
def embedding_profile(spark, d):
    p = embedding.embedding_profile(readers.read_table(spark, d, "embeddings"))
    return p.select(
        "n_rows", "n_null", F.col("min_dim").cast("long").alias("min_dim"),
        F.col("max_dim").cast("long").alias("max_dim"),
        F.round("min_norm", 5).alias("min_norm"), F.round("max_norm", 5).alias("max_norm"),
    )


@query("knn_exact", "SELECT query_id, chunk_id, score, rank FROM hits_plain", ("hits_plain",))
def knn_exact(spark, d):
    return retrieval.knn_exact(plain_asked(spark, d), views.chunk_vectors(spark, d), 10)


@query("knn_grid", "SELECT query_id, chunk_id, score, rank FROM hits_filtered", ("hits_filtered",))
def knn_grid(spark, d):
    """Filtered search in many question blocks."""
    return retrieval.knn_grid(asked(spark, d), views.chunk_vectors(spark, d), 10)


@query("knn_filtered", "SELECT query_id, chunk_id, score, rank FROM hits_filtered",
       ("hits_filtered",))
def knn_filtered(spark, d):
    return retrieval.knn_exact(asked(spark, d), views.chunk_vectors(spark, d), 10)


def hits_with(spark, d, *tables):
    """Filtered, thresholded hits of all questions with the columns of chunk tables."""
    questions = asked(spark, d)
    hits = retrieval.retrieve(questions, views.chunk_vectors(spark, d), 10)
    if tables:
        hits = materialize(hits, "hits")
    for table in tables:
        hits = retrieval.attach_chunks(hits, table)
    return hits


def full_hits(spark, d):
    return hits_with(spark, d, views.chunk_vectors(spark, d), views.chunk_texts(spark, d))


@query("knn_threshold", "SELECT query_id, chunk_id, score, rank FROM hits", ("hits",))
def knn_threshold(spark, d):
    return hits_with(spark, d)


@query("typed_search", f"""
SELECT query_id, chunk_id, score, rank FROM (
  {sx.knn('q', 'cv', '5', "c.content_type = 'table' AND (coalesce(q.filter_source, '') = '' OR q.filter_source = c.source_file)")}
) WHERE {sx.FLOOR}
""", ("q", "cv"))
def typed_search(spark, d):
    return retrieval.typed_search(asked(spark, d), views.chunk_vectors(spark, d), "table")


_wanted = "CASE WHEN label % 2 = 0 THEN 'handwritten' ELSE 'equation' END"


@query("typed_search_with_fallback", f"""
, tq AS (SELECT * REPLACE ({_wanted} AS filter_type) FROM q),
typed AS (SELECT * FROM ({sx.knn('tq', 'cv', '5', sx.BOTH_FILTERS)}) WHERE {sx.FLOOR}),
again AS (
  SELECT * FROM ({sx.knn("(SELECT * REPLACE ('' AS filter_type) FROM tq WHERE query_id NOT IN (SELECT query_id FROM typed))",
                         'cv', '5', sx.BOTH_FILTERS)}) WHERE {sx.FLOOR})
SELECT query_id, chunk_id, score, rank, false AS fallback FROM typed
UNION ALL SELECT query_id, chunk_id, score, rank, true AS fallback FROM again
""", ("q", "cv"))
def typed_search_with_fallback(spark, d):
    questions = asked(spark, d).withColumn(
        "filter_type", F.when(F.col("label") % 2 == 0, "handwritten").otherwise("equation")
    )
    return retrieval.typed_search_with_fallback(questions, views.chunk_vectors(spark, d))


def full_task_hits(spark, d, task=None):
    """Merged hits of the task requests (one task or all) with chunk metadata and text."""
    planned = asked_tasks(spark, d, task)
    chunks = views.chunk_vectors(spark, d)
    return answer.attach(
        answer.search(planned, chunks), chunks, views.chunk_texts(spark, d)
    )


@query("task_retrieval", """
SELECT task_id, task, query_no, chunk_id, score, rank, position FROM task_hits
""", ("task_hits",))
def task_retrieval(spark, d):
    return answer.search(asked_tasks(spark, d), views.chunk_vectors(spark, d)).drop("budget")


@query("multi_query_dedup", f"""
SELECT task_id, query_no, chunk_id, score, rank,
  row_number() OVER (PARTITION BY task_id ORDER BY query_no, rank) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY task_id, chunk_id ORDER BY query_no, rank) AS seen
      FROM task_hits_raw WHERE {sx.FLOOR})
WHERE seen = 1 AND task IN ('research_gaps', 'trend_analysis')
""", ("task_hits_raw",))
def multi_query_dedup(spark, d):
    planned = asked_tasks(spark, d).where(F.col("task").isin("research_gaps", "trend_analysis"))
    hits = retrieval.apply_threshold(
        retrieval.knn_exact(planned, views.chunk_vectors(spark, d))
    ).join(planned.select("query_id", "task_id", "query_no"), "query_id").drop("query_id")
    return retrieval.multi_query_dedup(hits)


@query("compare_sources", """
SELECT task_id, query_no + 1 AS side, source_file, chunk_id, score, rank
FROM task_meta WHERE task = 'comparison'
""", ("task_meta",))
def compare_sources(spark, d):
    planned = asked_tasks(spark, d, "comparison")
    hits = answer.search(planned, views.chunk_vectors(spark, d)).join(
        planned.select("task_id", "query_no", "filter_source"), ["task_id", "query_no"])
    return hits.select(
        "task_id", (F.col("query_no") + 1).alias("side"),
        F.col("filter_source").alias("source_file"), "chunk_id", "score", "rank",
    )


@query("recommend_sources", """
SELECT *, row_number() OVER (PARTITION BY task_id
    ORDER BY best_score DESC, n_hits DESC, source_file) AS source_rank
FROM (
  SELECT task_id, source_file, max(score) AS best_score, count(*) AS n_hits,
    coalesce(string_agg(DISTINCT section_heading, ', ' ORDER BY section_heading)
      FILTER (section_heading <> ''), '') AS sections
  FROM task_full WHERE task = 'recommendation' GROUP BY task_id, source_file)
""", ("task_full",))
def recommend_sources(spark, d):
    hits = full_task_hits(spark, d, "recommendation")
    ranked = retrieval.recommend_sources(hits.withColumnRenamed("task_id", "query_id"))
    return ranked.withColumnRenamed("query_id", "task_id")


@query("source_coverage", """
SELECT task_id, count(*) AS n_hits, count(DISTINCT source_file) AS n_sources,
  count(DISTINCT source_file || '#' || page_number) AS n_pages,
  count(DISTINCT source_file || '#' || section_heading) AS n_sections
FROM task_full WHERE task = 'multi_doc_reasoning' GROUP BY task_id
""", ("task_full",))
def source_coverage(spark, d):
    hits = full_task_hits(spark, d, "multi_doc_reasoning")
    return retrieval.source_coverage(
        hits.withColumnRenamed("task_id", "query_id")
    ).withColumnRenamed("query_id", "task_id")


@query("trend_terms", f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id
      ORDER BY n_sources DESC, n_passages DESC, term) AS term_rank
  FROM (
    SELECT task_id, term, count(DISTINCT source_file) AS n_sources, count(*) AS n_passages
    FROM (SELECT task_id, source_file, unnest(list_distinct({sx.letters_only('content')})) AS term
          FROM task_full WHERE task = 'trend_analysis')
    WHERE length(term) >= 4 GROUP BY task_id, term))
WHERE term_rank <= 20
""", ("task_full",))
def trend_terms(spark, d):
    return retrieval.trend_terms(
        full_task_hits(spark, d, "trend_analysis")
    )


@query("paper_preview", """
SELECT w.source_file, CASE WHEN body IS NULL
    THEN 'No preview available for paper ''' || w.source_file || '''.'
    ELSE 'Preview of top sections in ''' || w.source_file || ''':' || chr(10) || chr(10) || body
  END AS preview
FROM (SELECT DISTINCT 'paper_' || doc_id || '.pdf' AS source_file FROM documents) w
LEFT JOIN (
  SELECT source_file, string_agg('--- [Chunk ' || chunk_index || '] ---' || chr(10) || content
      || chr(10) || chr(10), '' ORDER BY chunk_index, content) AS body
  FROM doc_chunks WHERE chunk_index IN (0, 1, 2) GROUP BY source_file) b USING (source_file)
""", ("doc_chunks",))
def paper_preview(spark, d):
    wanted = readers.read_table(spark, d, "documents").select(
        F.concat(F.lit(" paper_"), "doc_id", F.lit(".pdf ")).alias("source_file")
    )
    return retrieval.paper_preview(views.doc_chunks(spark, d), wanted)


def ann_hits(spark, d, questions, share=0.25):
    """Approximate search over cells whose number follows the table; a share is probed."""
    chunks = views.chunk_vectors(spark, d)
    centres = retrieval.train_cells(chunks, retrieval.cell_count(chunks.count()))
    index = retrieval.write_index(chunks, centres, new_table_path(spark, "cells"))
    return retrieval.knn_ann(questions, index, centres, math.ceil(share * len(centres)), 10)


@query("knn_ann")
def knn_ann(spark, d):
    return ann_hits(spark, d, plain_asked(spark, d))


def label_cells(spark, d):
    """The labels' mean vectors as cell centres, which SQL can state too."""
    rows = views.label_questions(spark, d).orderBy("label").toArrow()  # one row per label
    return np.array(rows["vector"].to_pylist())


cte("cells", "SELECT label AS cell, vector FROM label_q", ("label_q",))
cte("placed", """
SELECT v.*, cell FROM cv v JOIN (
  SELECT chunk_id, cell, row_number() OVER (PARTITION BY chunk_id
      ORDER BY list_cosine_similarity(vector, embedding) DESC, cell) AS n FROM cv, cells) USING (chunk_id)
WHERE n = 1
""", ("cv", "cells"))
cte("probed", """
SELECT query_id, cell FROM (
  SELECT query_id, cell, row_number() OVER (PARTITION BY query_id
      ORDER BY list_cosine_similarity(c.vector, q.vector) DESC, cell) AS n FROM q, cells c) WHERE n <= 3
""", ("q", "cells"))
cte("ann_hits", sx.knn("(SELECT q.*, p.cell FROM q JOIN probed p USING (query_id))", "placed", "10",
                       "q.cell = c.cell"), ("q", "placed", "probed"))


@query("knn_ann_label_cells", "SELECT query_id, chunk_id, score, rank FROM ann_hits", ("ann_hits",))
def knn_ann_label_cells(spark, d):
    """Approximate search with three of the labels' cells probed."""
    centres = label_cells(spark, d)
    index = retrieval.write_index(
        views.chunk_vectors(spark, d), centres, new_table_path(spark, "cells"))
    return retrieval.knn_ann(plain_asked(spark, d), index, centres, 3, 10)


@query("knn_ann_all_cells", "SELECT query_id, chunk_id, score, rank FROM hits_plain", ("hits_plain",))
def knn_ann_all_cells(spark, d):
    """With every cell probed the index gives the exact answer."""
    return ann_hits(spark, d, plain_asked(spark, d), share=1.0)
