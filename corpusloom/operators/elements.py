"""From raw page content to headed text blocks, tables and figures."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import ordering
from corpusloom.schemas import ELEMENTS
from corpusloom.session import materialize

# Heading keywords and sizes.
HEADING_KEYWORDS = [
    "abstract", "introduction", "background", "related work",
    "methodology", "method", "methods", "approach", "proposed",
    "experiment", "experiments", "results", "evaluation",
    "discussion", "conclusion", "conclusions", "future work",
    "references", "appendix", "acknowledgment", "acknowledgments",
]
HEADING_FONT_SIZE = 14
HEADING_MAX_CHARS = 100
DEFAULT_FONT_SIZE = 12.0
OCR_HEADING = "OCR Extraction"

LINES_PER_PAGE = 40
HTML_PAGES = 64  # web pages whose lines a task holds at once

_ARROW_LINES = pa.schema([
    ("source_file", pa.string()), ("page_number", pa.int32()), ("line_no", pa.int32()),
    ("text", pa.string()), ("font_size", pa.float64())])


# ------------------------------------------------------------------------------ lines


_LINE = ["source_file", "page_number", "block_no", "line_no"]


def _joined_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run of neighbouring spans of a line, with their numbers and words."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.zeros(batch.num_rows, bool)
        starts[0] = True
        for name in _LINE:
            column = batch.column(name)
            null = column.is_null().to_numpy(zero_copy_only=False)
            other = pa.compute.not_equal(column[1:], column[:-1]).fill_null(False)
            starts[1:] |= other.to_numpy(zero_copy_only=False) | (null[1:] != null[:-1])
        first = np.flatnonzero(starts)
        offsets = pa.array([*first.tolist(), batch.num_rows], pa.int32())
        size = np.maximum.reduceat(batch.column("size").to_numpy(zero_copy_only=False), first)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(name).take(pa.array(first)) for name in _LINE),
             pa.ListArray.from_arrays(offsets, batch.column("span_no")),
             pa.ListArray.from_arrays(offsets, batch.column("word")),
             pa.array(size, pa.float64())],
            names=[*_LINE, "numbers", "words", "size"])


def spans_to_lines(spans: DataFrame) -> DataFrame:
    """Join the spans of each line; the largest span size is the line's font size.

    Spans that follow each other are one row before they are grouped, in any order alike.
    """
    rows = spans.where((F.col("block_type") == 0) & tx.has_text(F.col("text"))).select(
        *_LINE, "span_no", tx.strip(F.col("text")).alias("word"),
        F.coalesce("size", F.lit(DEFAULT_FONT_SIZE)).cast("double").alias("size"))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    runs = rows.mapInArrow(
        _joined_runs, ", ".join(f"{c} {kind[c]}" for c in _LINE)
        + f", numbers array<{kind['span_no']}>, words array<string>, size double")
    found = F.flatten(F.transform(
        F.collect_list(F.struct("numbers", "words")),
        lambda r: F.zip_with(r["numbers"], r["words"], lambda n, t: F.struct(
            n.alias("span_no"), t.alias("t")))))
    return runs.groupBy(*_LINE).agg(
        F.array_join(F.transform(F.array_sort(found), lambda s: s["t"]), " ").alias("text"),
        F.max("size").alias("font_size"),
    )


def text_lines(docs: DataFrame, text_col: str = "text", lines_per_page: int = LINES_PER_PAGE) -> DataFrame:
    """One row per non-blank line of a plain-text document; a shuffle-free explode.

    Plain text has no pages, so every ``lines_per_page`` lines count as one.
    """
    return (
        docs.select(
            "source_file", F.posexplode_outer(F.split(text_col, "\n")).alias("line_no", "raw")
        )
        .where(tx.has_text(F.col("raw")))
        .select(
            "source_file",
            (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int").alias("page_number"),
            "line_no",
            tx.strip(F.col("raw")).alias("text"),
        )
    )


class _VisibleLines(HTMLParser):
    """Collects visible text per block element with a nominal font size."""

    BLOCKS = {"p", "div", "li", "br", "tr", "td", "th", "section", "article", "ul", "ol", "table",
              "nav", "footer", "header", "aside", "main", "blockquote", "pre", "body", "title"}
    SIZES = {"h1": 24.0, "h2": 20.0, "h3": 18.0, "h4": 16.0, "h5": 15.0, "h6": 14.0}
    HIDDEN = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, float]] = []
        self.words: list[str] = []
        self.size = DEFAULT_FONT_SIZE
        self.hidden = 0

    def flush(self):
        line = " ".join("".join(self.words).split())
        if line:
            self.lines.append((line, self.size))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag in self.SIZES or tag in self.BLOCKS:
            self.flush()
            self.size = self.SIZES.get(tag, DEFAULT_FONT_SIZE)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.SIZES or tag in self.BLOCKS:
            self.flush()
            self.size = DEFAULT_FONT_SIZE

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def html_lines(pages: DataFrame) -> DataFrame:
    """Visible lines of ``(source_file, page_number, html)``; headings get larger sizes."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, HTML_PAGES):
                columns: list[list] = [[] for _ in range(5)]
                for page in batch.slice(at, HTML_PAGES).to_pylist():
                    parser = _VisibleLines()
                    parser.feed(page["html"] or "")
                    parser.close()
                    parser.flush()
                    for no, (line, size) in enumerate(parser.lines):
                        row = (page["source_file"], page["page_number"], no, line, size)
                        for column, value in zip(columns, row, strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _ARROW_LINES, strict=True)],
                    schema=_ARROW_LINES)

    return pages.select("source_file", F.col("page_number").cast("int"), "html").mapInArrow(
        parse,
        "source_file string, page_number int, line_no int, text string, font_size double",
    )


# --------------------------------------------------------------------------- headings


def is_heading(text: Column, font_size: Column) -> Column:
    """A known keyword (also numbered or followed by a colon), or short large text."""
    keyword = "^[0-9. ]*(" + "|".join(HEADING_KEYWORDS) + ")(:|$)"
    return (
        tx.strip(F.lower(text)).rlike(keyword)
        | ((font_size >= HEADING_FONT_SIZE) & (F.length(text) < HEADING_MAX_CHARS))
    )


def detect_headings(lines: DataFrame) -> DataFrame:
    return lines.withColumn("is_heading", is_heading(F.col("text"), F.col("font_size")))


def sectionize(lines: DataFrame) -> DataFrame:
    """Text elements from a table of lines ``(source_file, page_number, line_no, ...)``.

    A heading closes the block before it and names what follows, also on later pages of
    the document; a page end closes a block too. Blocks live inside one page, so lines
    are windowed by page only, and the headed blocks are written once. What crosses
    pages is the last heading of each page: one small row per page, read back without
    the texts and carried forward in two levels.
    """
    page = ["source_file", "page_number"]
    in_page = Window.partitionBy(*page).orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    body = F.array_sort(
        F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "text")))
    )
    blocks = materialize(
        detect_headings(lines)
        .withColumn("block_no", F.sum(F.col("is_heading").cast("int")).over(in_page))
        .groupBy(*page, "block_no")
        .agg(
            F.max(F.when(F.col("is_heading"), F.col("text"))).alias("heading"),
            F.min(F.when(~F.col("is_heading"), F.col("line_no"))).alias("line_no"),
            tx.strip(F.array_join(F.transform(body, lambda r: r["text"]), "\n")).alias("content"),
        ),
        "blocks",
    )
    per_page = blocks.groupBy(*page).agg(
        F.max_by("heading", F.when(F.col("heading").isNotNull(), F.col("block_no"))).alias("_last")
    )
    carried = ordering.carry_last(
        per_page, ["source_file"], "page_number", F.col("_last"), "_from_before"
    ).select(*page, "_from_before")
    return (
        blocks.where(tx.has_text(F.col("content")))
        .join(carried, page)
        .select(
            *page,
            "line_no",
            F.coalesce("heading", "_from_before", F.lit("")).alias("section_heading"),
            "content",
        )
    )


def sections_of_documents(
    docs: DataFrame,
    text_col: str = "text",
    lines_per_page: int = LINES_PER_PAGE,
    first_line_font: float = DEFAULT_FONT_SIZE,
) -> DataFrame:
    """Blocks as in ``sectionize`` for documents that are one row each: no shuffle.

    Returns ``(source_file, sections)`` with the sections in reading order. The lines of
    a document form an array; heading positions cut it into segments, page changes cut
    the segments into blocks, and every cut is a slice. Plain text has no font sizes,
    so only the first line may be given one.
    """
    font = F.lit(DEFAULT_FONT_SIZE)
    lines = F.transform(
        F.filter(
            F.transform(
                F.split(text_col, "\n"),
                lambda t, i: F.struct(
                    (F.floor(i / lines_per_page) + 1).cast("int").alias("page"),
                    i.alias("no"),
                    tx.strip(t).alias("text"),
                ),
            ),
            lambda r: r["text"] != "",
        ),
        lambda r: r.withField(
            "h", is_heading(r["text"], F.when(r["no"] == 0, first_line_font).otherwise(font))
        ),
    )
    heads = F.filter(
        F.sequence(F.lit(1), F.size("lines")), lambda p: (p == 1) | F.element_at("lines", p)["h"]
    )
    segments = F.transform(
        "heads",
        lambda p, i: F.struct(
            F.when(F.element_at("lines", p)["h"], F.element_at("lines", p)["text"])
            .otherwise("")
            .alias("heading"),
            F.slice(
                "lines",
                p + F.element_at("lines", p)["h"].cast("int"),
                F.coalesce(F.get("heads", i + 1), F.size("lines") + 1)
                - p
                - F.element_at("lines", p)["h"].cast("int"),
            ).alias("body"),
        ),
    )
    cut = F.transform(
        F.filter("segments", lambda s: F.size(s["body"]) > 0),
        lambda s: s.withField(
            "starts",
            F.filter(
                F.sequence(F.lit(1), F.size(s["body"])),
                lambda p: (p == 1)
                | (F.element_at(s["body"], p)["page"] != F.get(s["body"], p - 2)["page"]),
            ),
        ),
    )
    blocks = F.transform(
        "cut",
        lambda s: F.transform(
            s["starts"],
            lambda p, i: F.struct(
                F.element_at(s["body"], p)["page"].alias("page_number"),
                F.element_at(s["body"], p)["no"].alias("line_no"),
                s["heading"].alias("section_heading"),
                F.array_join(
                    F.transform(
                        F.slice(
                            s["body"],
                            p,
                            F.coalesce(F.get(s["starts"], i + 1), F.size(s["body"]) + 1) - p,
                        ),
                        lambda r: r["text"],
                    ),
                    "\n",
                ).alias("content"),
            ),
        ),
    )
    return (
        docs.where(tx.has_text(F.col(text_col)))
        .select("source_file", lines.alias("lines"))
        .select("source_file", "lines", heads.alias("heads"))
        .select("source_file", segments.alias("segments"))
        .select("source_file", cut.alias("cut"))
        .select("source_file", F.flatten(blocks).alias("sections"))
    )


def sectionize_documents(
    docs: DataFrame,
    text_col: str = "text",
    lines_per_page: int = LINES_PER_PAGE,
    first_line_font: float = DEFAULT_FONT_SIZE,
) -> DataFrame:
    """The blocks of ``sections_of_documents`` as rows."""
    nested = sections_of_documents(docs, text_col, lines_per_page, first_line_font)
    # Outer: a plain inline adds a filter on the array, which evaluates it twice.
    return nested.select("source_file", F.inline_outer("sections")).where(
        F.col("content").isNotNull()
    )


def page_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("source_file").agg(F.max("page_number").alias("total_pages"))


# ----------------------------------------------------------------- tables and figures


def markdown_table(raw: Column) -> Column:
    """Markdown text of ``ARRAY<ARRAY<STRING>>``; the first row is the header."""

    def row(cells: Column) -> Column:
        shown = F.transform(cells, lambda c: F.coalesce(c, F.lit("")))
        return F.concat(F.lit("| "), F.array_join(shown, " | "), F.lit(" |\n"))

    rule = row(F.transform(F.element_at(raw, 1), lambda _: F.lit("---")))
    rest = F.array_join(F.transform(F.slice(raw, 2, F.greatest(F.size(raw) - 1, F.lit(0))), row), "")
    return F.when(F.size(raw) > 0, F.concat(row(F.element_at(raw, 1)), rule, rest)).otherwise("")


def table_elements(tables: DataFrame, block_rows: int = 4096) -> DataFrame:
    """Non-empty tables as elements; headings are numbered per page.

    Empty tables are skipped but keep their number. ``table_idx`` orders a page.
    """
    numbered = ordering.row_number(
        tables,
        ["source_file", "page_number"],
        F.floor(F.col("table_idx") / block_rows),
        ["table_idx"],
        "_no",
    )
    return numbered.where(F.size("raw") > 0).select(
        "source_file",
        F.col("table_idx").cast("long").alias("element_no"),
        F.lit("table").alias("element_type"),
        markdown_table(F.col("raw")).alias("content"),
        "page_number",
        F.format_string("Table %d", F.col("_no").cast("int")).alias("section_heading"),
        F.struct(
            F.size("raw").alias("rows"), F.size(F.element_at("raw", 1)).alias("cols"), "raw"
        ).alias("table_data"),
        F.lit(None).cast("string").alias("image_path"),
        F.lit(1.0).alias("confidence"),
    )


def figure_elements(images: DataFrame, images_dir: str = "images", block_rows: int = 4096) -> DataFrame:
    """Figures named after document, page and position on the page (from 1)."""
    numbered = ordering.row_number(
        images,
        ["source_file", "page_number"],
        F.floor(F.col("seq") / block_rows),
        ["seq"],
        "_no",
    )
    path = F.concat(
        F.lit(images_dir + "/"), "source_file", F.lit("_p"), "page_number", F.lit("_img"),
        F.col("_no").cast("long"), F.lit("."), "ext",
    )
    return numbered.withColumn("image_path", path).select(
        "source_file",
        F.col("seq").cast("long").alias("element_no"),
        F.lit("figure").alias("element_type"),
        # Fixed value: the placeholder text.
        F.concat(
            F.lit("[Figure on page "), "page_number",
            F.lit("] Image extracted from the document. Path: "), "image_path",
        ).alias("content"),
        "page_number",
        F.lit("").alias("section_heading"),
        F.lit(None).cast(ELEMENTS["table_data"].dataType).alias("table_data"),
        "image_path",
        F.lit(1.0).alias("confidence"),
    )


def text_elements(sections: DataFrame) -> DataFrame:
    return sections.select(
        "source_file",
        F.col("line_no").cast("long").alias("element_no"),
        F.lit("text").alias("element_type"),
        "content",
        "page_number",
        "section_heading",
        F.lit(None).cast(ELEMENTS["table_data"].dataType).alias("table_data"),
        F.lit(None).cast("string").alias("image_path"),
        F.lit(1.0).alias("confidence"),
    )


def union_elements(*parts: DataFrame, first: int = 0) -> DataFrame:
    """Text, then tables, then figures; ``type_order`` keeps that order per document.

    It counts from ``first``: 1 for tables and figures without the text.
    """
    out = None
    for order, part in enumerate(parts, first):
        tagged = part.withColumn("type_order", F.lit(order))
        out = tagged if out is None else out.unionByName(tagged)
    return out


# ------------------------------------------------------------------- model replies


def ocr_boxes_to_elements(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """One text element per image: box texts in order, confidence of the first box."""
    read = boxes.groupBy("image").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("box_no", "text"))), lambda b: b["text"]
            ),
            " ",
        ).alias("content"),
        F.min_by("confidence", "box_no").alias("confidence"),
    )
    return images.select("image").join(read, "image", "left").select(
        "image",
        F.coalesce("content", F.lit("")).alias("content"),
        F.lit("text").alias("element_type"),
        F.lit(OCR_HEADING).alias("section_heading"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def split_latex_response(df: DataFrame, raw: str = "raw") -> DataFrame:
    """First line is the formula without code fences, the remainder its explanation."""
    first = F.substring_index(raw, "\n", 1)
    rest = F.when(
        F.instr(raw, "\n") > 0, F.expr(f"substring({raw}, instr({raw}, '\\n') + 1)")
    ).otherwise("")
    return df.withColumn(
        "latex", tx.strip(F.regexp_replace(first, "```(latex)?", ""))
    ).withColumn("explanation", tx.strip(rest))
