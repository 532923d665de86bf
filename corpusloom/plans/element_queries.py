"""Queries that turn lines, spans, cells and images into elements and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import chunking, elements
from corpusloom.plans import sqltext as sx
from corpusloom.plans.registry import cte, query
from corpusloom.sources import readers, views

TABLE_COLUMNS = ["source_file", "page_number", "section_heading", "content"]


@query("spans_to_lines", f"""
SELECT source_file, page_number, 0 AS block_no, line_no,
  string_agg({sx.strip('text')}, ' ' ORDER BY span_no) AS text, max(coalesce(size, 12::DOUBLE)) AS font_size
FROM spans WHERE block_type = 0 AND {sx.has_text('text')}
GROUP BY source_file, page_number, line_no
""", ("spans",))
def spans_to_lines(spark, d):
    return elements.spans_to_lines(views.spans(spark, d))


@query("page_lines", "SELECT source_file, page_number, line_no, text FROM plain_lines", ("plain_lines",))
def page_lines(spark, d):
    return elements.text_lines(views.documents(spark, d))


@query("html_lines")
def html_lines(spark, d):
    pages = readers.read_table(spark, d, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("source_file"), F.lit(1).alias("page_number"), "html"
    )
    return elements.detect_headings(elements.html_lines(pages))


@query("html_sections")
def html_sections(spark, d):
    """Web pages cut into headed sections, each page one document."""
    pages = readers.read_table(spark, d, "pages").select(
        F.concat(F.lit("page_"), "page_id").alias("source_file"), F.lit(1).alias("page_number"), "html"
    )
    return elements.sectionize(elements.html_lines(pages))


@query("detect_headings", f"""
SELECT source_file, page_number, line_no, text, font_size,
  {sx.is_heading('text', 'font_size')} AS is_heading FROM doc_lines
""", ("doc_lines",))
def detect_headings(spark, d):
    return elements.detect_headings(views.doc_lines(spark, d))


@query("sectionize", sx.sections("doc_lines"), ("doc_lines",))
def sectionize(spark, d):
    return elements.sectionize(views.doc_lines(spark, d))


@query("sectionize_documents", sx.sections("plain_lines"), ("plain_lines",))
def sectionize_documents(spark, d):
    return elements.sectionize_documents(views.documents(spark, d), first_line_font=16.0)


@query("page_count", """
SELECT source_file, max(page_number) AS total_pages FROM doc_lines GROUP BY source_file
""", ("doc_lines",))
def page_count(spark, d):
    return elements.page_count(views.doc_lines(spark, d))


@query("table_to_markdown", "SELECT table_idx, md AS markdown FROM table_md", ("table_md",))
def table_to_markdown(spark, d):
    return views.raw_tables(spark, d).select(
        "table_idx", elements.markdown_table(F.col("raw")).alias("markdown")
    )


@query("table_elements", """
SELECT source_file, page_number, 'Table ' || no AS section_heading, md AS content,
  len(raw)::INT AS n_rows, len(raw[1])::INT AS n_cols
FROM table_md WHERE len(raw) > 0
""", ("table_md",))
def table_elements(spark, d):
    return elements.table_elements(views.raw_tables(spark, d)).select(
        *TABLE_COLUMNS, F.col("table_data.rows").alias("n_rows"), F.col("table_data.cols").alias("n_cols")
    )


_figure_text = ("'[Figure on page ' || page_number || '] Image extracted from the document. Path: ' "
                "|| image_path")


@query("figure_elements", f"""
SELECT source_file, page_number, image_path, {_figure_text} AS content FROM figures
""", ("figures",))
def figure_elements(spark, d):
    return elements.figure_elements(views.page_images(spark, d)).select(
        "source_file", "page_number", "image_path", "content"
    )


def all_elements(spark, d):
    return elements.union_elements(
        elements.text_elements(elements.sectionize(views.doc_lines(spark, d))),
        elements.table_elements(views.raw_tables(spark, d)),
        elements.figure_elements(views.page_images(spark, d)),
    )


cte("elements_sql", f"""
SELECT source_file, 0 AS type_order, 'text' AS element_type, page_number, line_no::BIGINT AS element_no,
  section_heading, content, '' AS image_path FROM ({sx.sections('doc_lines')})
UNION ALL SELECT source_file, 1, 'table', page_number, table_idx, 'Table ' || no, md, ''
  FROM table_md WHERE len(raw) > 0
UNION ALL SELECT source_file, 2, 'figure', page_number, seq, '', {_figure_text}, image_path FROM figures
""", ("doc_lines", "table_md", "figures"))


@query("union_elements", """
SELECT source_file, type_order, element_type, page_number, element_no, section_heading, content
FROM elements_sql
""", ("elements_sql",))
def union_elements(spark, d):
    return all_elements(spark, d).select(
        "source_file", "type_order", "element_type", "page_number", "element_no", "section_heading",
        "content",
    )


@query("ocr_boxes_to_element", """
SELECT 'img_' || i.doc_id AS image, coalesce(content, '') AS content, 'text' AS element_type,
  'OCR Extraction' AS section_heading, coalesce(confidence, 0.0)::DOUBLE AS confidence
FROM documents i LEFT JOIN (
  SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS content,
    arg_min((turn + 5) / 20, turn) AS confidence
  FROM conversations GROUP BY conv_id) c ON c.conv_id = i.doc_id
""")
def ocr_boxes_to_element(spark, d):
    images = readers.read_table(spark, d, "documents").select(
        F.concat(F.lit("img_"), "doc_id").alias("image")
    )
    boxes = readers.read_table(spark, d, "conversations").select(
        F.concat(F.lit("img_"), "conv_id").alias("image"),
        F.col("turn").alias("box_no"),
        "text",
        ((F.col("turn") + 5) / 20).alias("confidence"),
    )
    return elements.ocr_boxes_to_elements(images, boxes)


@query("split_latex_response", f"""
SELECT doc_id, {sx.strip("replace(replace(split_part(raw, chr(10), 1), '```latex', ''), '```', '')")} AS latex,
  {sx.strip("CASE WHEN contains(raw, chr(10)) THEN substr(raw, instr(raw, chr(10)) + 1) ELSE '' END")} AS explanation
FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '```latex x_{{' || doc_id || '}}```' || chr(10) || text
        WHEN 1 THEN text ELSE '```latex' || chr(10) || text END AS raw FROM documents)
""")
def split_latex_response(spark, d):
    doc = F.col("doc_id")
    raw = (
        F.when(doc % 3 == 0, F.concat(F.lit("```latex x_{"), doc, F.lit("}```\n"), "text"))
        .when(doc % 3 == 1, F.col("text"))
        .otherwise(F.concat(F.lit("```latex\n"), "text"))
    )
    replies = readers.read_table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    return elements.split_latex_response(replies).drop("raw")


# ------------------------------------------------------------------------------ chunks


def mixed_elements(spark, d):
    """Tables and figures plus documents as equations, text and an unknown type."""
    doc = F.col("doc_id")
    docs = views.documents(spark, d).select(
        "source_file", doc.alias("element_no"),
        views.pick(doc % 3, "equation", "text", "sketch").alias("element_type"),
        F.explode(F.when(doc % 9 == 0, F.array(F.lit(" \n"), "text")).otherwise(F.array("text")))
        .alias("content"),
        F.lit(1).alias("page_number"), F.lit("").alias("section_heading"),
        F.lit(None).cast("string").alias("image_path"), F.lit(1.0).alias("confidence"),
    )
    blank = elements.text_elements(docs.withColumn("line_no", F.lit(0))).limit(0)
    tables = elements.table_elements(views.raw_tables(spark, d))
    figures = elements.figure_elements(views.page_images(spark, d))
    return (
        tables.unionByName(figures)
        .unionByName(docs.withColumn("table_data", F.lit(None).cast(blank.schema["table_data"].dataType)))
        .withColumn("type_order", F.lit(0))
    )


cte("mixed", f"""
SELECT 'doc_' || doc_id AS source_file, doc_id AS element_no,
  ['equation', 'text', 'sketch'][doc_id % 3 + 1] AS element_type,
  unnest(CASE WHEN doc_id % 9 = 0 THEN [' ' || chr(10), text] ELSE [text] END) AS content,
  '' AS image_path FROM documents
UNION ALL SELECT source_file, table_idx, 'table', md, '' FROM table_md WHERE len(raw) > 0
UNION ALL SELECT source_file, seq, 'figure', {_figure_text}, image_path FROM figures
""", ("table_md", "figures"))


@query("chunk_atomic", f"""
SELECT source_file, element_no, element_type AS content_type, content,
  CASE WHEN element_type = 'equation' THEN content END AS latex_source,
  CASE WHEN element_type = 'figure' THEN content END AS image_description,
  CASE WHEN element_type = 'figure' THEN image_path END AS image_path,
  element_type = 'table' AS has_table
FROM mixed WHERE element_type IN ('table', 'figure', 'equation') AND {sx.has_text('content')}
""", ("mixed",))
def chunk_atomic(spark, d):
    return chunking.chunk_atomic(mixed_elements(spark, d)).select(
        "source_file", "element_no", "content_type", "content", "latex_source", "image_description",
        "image_path", F.col("table_data").isNotNull().alias("has_table"),
    )


@query("drop_blank", f"""
SELECT source_file, element_no, element_type FROM mixed WHERE {sx.has_text('content')}
""", ("mixed",))
def drop_blank(spark, d):
    return chunking.drop_blank(mixed_elements(spark, d)).select(
        "source_file", "element_no", "element_type"
    )


@query("chunk_index", """
SELECT source_file, element_type, page_number, element_no,
  row_number() OVER (PARTITION BY source_file ORDER BY type_order, page_number, element_no) - 1
    AS chunk_index
FROM elements_sql
""", ("elements_sql",))
def chunk_index(spark, d):
    parts = all_elements(spark, d).withColumn("piece_no", F.lit(0))
    return chunking.chunk_index(parts).select(
        "source_file", "element_type", "page_number", "element_no", "chunk_index"
    )


@query("chunk_identity", """
SELECT source_file, chunk_index, sha256(source_file || '|' || chunk_index || '|' || content) AS chunk_id
FROM doc_chunks
""", ("doc_chunks",))
def chunk_identity(spark, d):
    return views.doc_chunks(spark, d).select(
        "source_file", "chunk_index",
        chunking.chunk_identity(F.col("source_file"), F.col("chunk_index"), F.col("content")).alias("chunk_id"),
    )


@query("chunk_elements")
def chunk_elements(spark, d):
    return chunking.chunk_elements(all_elements(spark, d)).select(
        "chunk_id", "source_file", "page_number", "section_heading", "chunk_index", "content_type",
        "element_type", "content",
    )


@query("chunk_elements_whole", """
SELECT source_file, page_number, section_heading, element_type AS content_type, content,
  CASE element_type WHEN 'text' THEN 'paragraph' ELSE element_type END AS element_type, chunk_index,
  sha256(source_file || '|' || chunk_index || '|' || content) AS chunk_id
FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY type_order, page_number, element_no) - 1
        AS chunk_index FROM elements_sql)
""", ("elements_sql",))
def chunk_elements_whole(spark, d):
    """With a size that no section exceeds, every element is one chunk."""
    return chunking.chunk_elements(all_elements(spark, d), size=1 << 30).select(
        "chunk_id", "source_file", "page_number", "section_heading", "chunk_index", "content_type",
        "element_type", "content",
    )


@query("chunk_quality", """
SELECT element_type AS content_type, count(*) AS n_chunks, round(avg(length(content)), 6) AS mean_length,
  avg(CASE WHEN regexp_matches(content, '[.!?]$') THEN 1.0 ELSE 0.0 END) AS boundary_share,
  avg(CASE WHEN section_heading <> '' THEN 1.0 ELSE 0.0 END) AS complete_share
FROM elements_sql GROUP BY element_type
""", ("elements_sql",))
def chunk_quality(spark, d):
    return chunking.chunk_quality(
        all_elements(spark, d).withColumn("content_type", F.col("element_type"))
    ).withColumn("mean_length", F.round("mean_length", 6))
