"""Chunks from elements: text is split, everything else stays whole."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import ordering
from corpusloom.session import materialize

# Default sizes and the separators in order of preference.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
ATOMIC_TYPES = ["table", "figure", "equation"]

Span = tuple[int, int]


def _cut(text: str, lo: int, hi: int, level: int) -> tuple[list[Span], int]:
    """Spans of text[lo:hi] at the first separator it contains, and that level.

    A separator stays at the front of the span that follows it.
    """
    while SEPARATORS[level] and text.find(SEPARATORS[level], lo, hi) < 0:
        level += 1
    separator = SEPARATORS[level]
    if not separator:
        return [(i, i + 1) for i in range(lo, hi)], level
    starts = [lo]
    at = text.find(separator, lo, hi)
    while at >= 0:
        if at > starts[-1]:
            starts.append(at)
        at = text.find(separator, at + len(separator), hi)
    return list(zip(starts, [*starts[1:], hi])), level


def _windows(spans: list[Span], size: int, overlap: int) -> list[Span]:
    """Merge neighbouring spans into windows of at most ``size`` characters.

    Neighbours touch, so a window is described by its first and last span. The next
    window starts at the earliest span that leaves at most ``overlap`` characters of
    the last one and still fits its first new span.
    """
    out, first = [], 0
    for i, (lo, hi) in enumerate(spans):
        if i > first and hi - spans[first][0] > size:
            out.append((spans[first][0], lo))
            while first < i and (
                lo - spans[first][0] > overlap or hi - spans[first][0] > size
            ):
                first += 1
    out.append((spans[first][0], spans[-1][1]))
    return out


def split_spans(text: str, size: int, overlap: int, lo: int = 0, hi: int | None = None,
                level: int = 0) -> list[Span]:
    """Chunk boundaries of a text: coarse separators first, finer ones where needed."""
    hi = len(text) if hi is None else hi
    pieces, level = _cut(text, lo, hi, level)
    out: list[Span] = []
    fitting: list[Span] = []
    for a, b in pieces:
        if b - a < size or (b - a == size and level == len(SEPARATORS) - 1):
            fitting.append((a, b))
            continue
        if fitting:
            out.extend(_windows(fitting, size, overlap))
            fitting = []
        out.extend(split_spans(text, size, overlap, a, b, level + 1))
    if fitting:
        out.extend(_windows(fitting, size, overlap))
    return out


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    if len(text) <= size:
        whole = text.strip()
        return [whole] if whole else []
    pieces = (text[a:b].strip() for a, b in split_spans(text, size, overlap))
    return [p for p in pieces if p]


def pieces(col: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """ARRAY<STRING> of chunk texts; sizes of 0 or None mean the defaults."""
    size, overlap = size or CHUNK_SIZE, overlap or CHUNK_OVERLAP

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t or "", size, overlap))

    return split(col)


def section_pieces(sections: Column, size: int | None = None, overlap: int | None = None) -> Column:
    """Pieces of an array of sections as one array in reading order.

    Only the section texts travel to Python and back; page and heading are added again
    by position in the JVM.
    """
    size, overlap = size or CHUNK_SIZE, overlap or CHUNK_OVERLAP

    @F.pandas_udf("array<array<string>>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda ts: [split_text(t, size, overlap) for t in ts])

    cut = split(F.transform(sections, lambda s: s["content"]))
    return F.flatten(
        F.zip_with(
            sections,
            cut,
            lambda s, parts: F.transform(
                parts,
                lambda c: F.struct(
                    s["page_number"].alias("page_number"),
                    s["section_heading"].alias("section_heading"),
                    c.alias("content"),
                ),
            ),
        )
    )


def chunk_text(elements: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Text elements cut into paragraph chunks; ``piece_no`` counts inside the element."""
    return (
        elements.where((F.col("element_type") == "text") & tx.has_text(F.col("content")))
        .select("*", F.posexplode(pieces(F.col("content"), size, overlap)).alias("piece_no", "_piece"))
        .withColumn("content", F.col("_piece"))
        .withColumn("content_type", F.lit("text"))
        .withColumn("element_type", F.lit("paragraph"))
        .withColumn("latex_source", F.lit(None).cast("string"))
        .withColumn("image_description", F.lit(None).cast("string"))
        .withColumn("image_path", F.lit(None).cast("string"))
        .drop("_piece")
    )


def chunk_atomic(elements: DataFrame) -> DataFrame:
    """Tables, figures and equations: one untouched chunk each. Other types vanish."""
    kind = F.col("element_type")
    return (
        elements.where(kind.isin(ATOMIC_TYPES) & tx.has_text(F.col("content")))
        .withColumn("piece_no", F.lit(0))
        .withColumn("content_type", kind)
        .withColumn("latex_source", F.when(kind == "equation", F.col("content")))
        .withColumn("image_description", F.when(kind == "figure", F.col("content")))
        .withColumn("image_path", F.when(kind == "figure", F.col("image_path")))
        .withColumn("table_data", F.when(kind == "table", F.col("table_data")))
    )


def drop_blank(elements: DataFrame) -> DataFrame:
    return elements.where(tx.has_text(F.col("content")))


def chunk_index(pieces_df: DataFrame, block_pages: int = 256) -> DataFrame:
    """Zero-based position per document over all types, in element order."""
    order = ["type_order", "page_number", "element_no", "piece_no"]
    block = F.col("type_order") * F.lit(1 << 40) + F.floor(F.col("page_number") / block_pages)
    numbered = ordering.row_number(pieces_df, ["source_file"], block, order, "_n")
    return numbered.withColumn("chunk_index", (F.col("_n") - 1).cast("long")).drop("_n")


def chunk_identity(source_file: Column, index: Column, content: Column) -> Column:
    """Content-derived id, so that a repeated ingest finds its own earlier rows."""
    return F.sha2(F.concat_ws("|", source_file, index.cast("string"), content), 256)


def chunk_elements(elements: DataFrame, size: int | None = None, overlap: int | None = None) -> DataFrame:
    """Elements (with ``type_order``) to indexed, identified chunks.

    The pieces are written once before they are numbered: numbering reads them twice,
    and splitting them is the expensive part.
    """
    parts = materialize(
        chunk_text(elements, size, overlap).unionByName(chunk_atomic(elements)), "pieces"
    )
    return (
        chunk_index(parts)
        .withColumn(
            "chunk_id",
            chunk_identity(F.col("source_file"), F.col("chunk_index"), F.col("content")),
        )
        .drop("type_order", "element_no", "piece_no")
    )


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Mean length, share ending at a sentence boundary, metadata completeness per type."""
    complete = (
        F.col("source_file").isNotNull() & (F.col("source_file") != "")
        & F.col("page_number").isNotNull()
        & F.col("section_heading").isNotNull() & (F.col("section_heading") != "")
        & F.col("element_type").isNotNull()
    )
    return chunks.groupBy("content_type").agg(
        F.count("*").alias("n_chunks"),
        F.avg(F.length("content")).alias("mean_length"),
        F.avg(F.col("content").rlike("[.!?]$").cast("double")).alias("boundary_share"),
        F.avg(complete.cast("double")).alias("complete_share"),
    )


@F.udtf(returnType="piece_no int, content string", useArrow=True)
class SplitChunks:
    """``split_text`` as a table function: a row per piece of a text, numbered from 0.

    NULL and blank texts have no rows; sizes and overlaps of 0 or NULL mean the defaults.
    """

    def eval(self, text: str, size: int, overlap: int):
        for number, piece in enumerate(
                split_text(text or "", size or CHUNK_SIZE, overlap or CHUNK_OVERLAP)):
            yield number, piece


def register_split_chunks(spark, name: str = "split_chunks") -> None:
    """Make the splitter callable from SQL: ``FROM docs, LATERAL split_chunks(text, 512, 50)``."""
    spark.udtf.register(name, SplitChunks)
