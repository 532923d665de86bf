"""Do the citations of an answer point at something that exists?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the form of a citation in an answer.
CITATION = r"\[Source: ([^,\]]+), Page (\d{1,9})(?:, Section ([^\]]+))?\]"
PAGES_PER_BIN = 16


def parse_citations(answers: DataFrame) -> DataFrame:
    """Every citation in the texts of ``answers`` (answer_id, text), in order.

    Gives answer_id, citation_no (from 1), source_file, page_number and section_heading,
    which is NULL where the citation names none.
    """
    found = answers.select("answer_id", F.posexplode(
        F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))).alias("_n", "_c"))

    def part(group: int):
        return F.regexp_extract("_c", CITATION, group)

    return found.select(
        "answer_id", (F.col("_n") + 1).alias("citation_no"), F.trim(part(1)).alias("source_file"),
        part(2).cast("int").alias("page_number"),
        F.nullif(F.trim(part(3)), F.lit("")).alias("section_heading"))


def section_spans(chunks: DataFrame) -> DataFrame:
    """source_file, section_heading, section_no, first_page, last_page of each section.

    A section is a run of chunks of one heading in reading order (page, number, id). It ends
    on the page on which the next one starts, the last on the file's last page.
    """
    order = Window.partitionBy("source_file").orderBy("page_number", "chunk_index", "chunk_id")
    whole = Window.partitionBy("source_file")
    heading = F.coalesce("section_heading", F.lit(""))
    starts = chunks.select(
        "source_file", heading.alias("section_heading"), "page_number", "chunk_index", "chunk_id",
        F.max("page_number").over(whole).alias("_end"),
        F.lag(heading).over(order).alias("_before")).where(
        F.col("_before").isNull() | (F.col("_before") != F.col("section_heading")))
    return starts.select(
        "source_file", "section_heading", F.row_number().over(order).alias("section_no"),
        F.col("page_number").alias("first_page"),
        F.coalesce(F.lead("page_number").over(order), "_end").alias("last_page"))


def _bin(page: str):
    return F.floor(F.col(page) / PAGES_PER_BIN)


def sections_of_pages(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Range and as-of join: ``pages`` (source_file, page_number) with the sections there.

    Gives per distinct page the headings on it (``headings``) and the section that is in
    force when the page begins (``in_force``): the last that began before it, or the first
    on it where none did. Sections are dealt to bins of pages, so the join is by equality.
    """
    binned = spans.select("*", F.explode(
        F.sequence(_bin("first_page"), _bin("last_page"))).alias("_bin"))
    asked = pages.select("source_file", "page_number").distinct().withColumn(
        "_bin", _bin("page_number"))
    met = asked.join(binned, ["source_file", "_bin"]).where(
        F.col("page_number").between(F.col("first_page"), F.col("last_page")))
    before = F.col("first_page") < F.col("page_number")
    return met.groupBy("source_file", "page_number").agg(
        F.collect_set("section_heading").alias("headings"),
        F.coalesce(
            F.max_by("section_heading", F.when(before, F.col("section_no"))),
            F.min_by("section_heading", "section_no")).alias("in_force"))


def check_citations(citations: DataFrame, files: DataFrame, spans: DataFrame) -> DataFrame:
    """``citations`` with file_exists, page_valid, section_on_page, in_force and verdict.

    ``files``: source_file and total_pages, one row per stored file; ``spans``: see
    ``section_spans``. A citation without a section is not held against the headings.
    """
    stored = files.select("source_file", F.col("total_pages").alias("_pages"),
                          F.lit(True).alias("_stored"))
    there = sections_of_pages(citations, spans)
    rows = citations.join(stored, "source_file", "left").join(
        there, ["source_file", "page_number"], "left")
    exists = F.coalesce("_stored", F.lit(False))
    valid = exists & F.coalesce(F.col("page_number").between(F.lit(1), F.col("_pages")), F.lit(False))
    named = F.col("section_heading")
    on_page = valid & F.when(named.isNull(), True).otherwise(
        F.coalesce(F.array_contains("headings", named), F.lit(False)))
    return rows.select(
        "answer_id", "citation_no", "source_file", "page_number", "section_heading",
        exists.alias("file_exists"), valid.alias("page_valid"), on_page.alias("section_on_page"),
        F.when(valid, F.col("in_force")).alias("in_force"),
        F.when(~exists, "unknown file").when(~valid, "no such page")
        .when(~on_page, "section not on page").otherwise("valid").alias("verdict"))
