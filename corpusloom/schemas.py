"""Explicit schemas of the tables the operators exchange."""

from pyspark.sql import types as T

TABLE_DATA = T.StructType(
    [
        T.StructField("rows", T.IntegerType()),
        T.StructField("cols", T.IntegerType()),
        T.StructField("raw", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)

ELEMENTS = T.StructType(
    [
        T.StructField("source_file", T.StringType()),
        T.StructField("element_no", T.LongType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_heading", T.StringType()),
        T.StructField("table_data", TABLE_DATA),
        T.StructField("image_path", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
    ]
)

CHUNKS = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("page_number", T.IntegerType()),
        T.StructField("section_heading", T.StringType()),
        T.StructField("chunk_index", T.LongType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("element_type", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("table_data", TABLE_DATA),
        T.StructField("latex_source", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("image_description", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

CATALOG = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_type", T.StringType()),
        T.StructField("total_pages", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("ingested_at", T.TimestampType()),
        T.StructField("status", T.StringType()),
    ]
)

# Test-data tables, declared so that streams and scans never infer a schema.
DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)
