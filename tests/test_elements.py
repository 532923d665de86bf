"""Lines, headings, sections, tables, figures and replies on small hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import elements
from corpusloom.sources import views


def test_spans_to_lines(spark):
    rows = [
        ("d", 1, 0, 0, 0, 1, "World ", 9.0), ("d", 1, 0, 0, 0, 0, " Hello", None),
        ("d", 1, 0, 0, 0, 2, "  ", 40.0),            # blank span: no text, no size
        ("d", 1, 0, 0, 1, 0, " ", 20.0),              # blank line vanishes
        ("d", 1, 1, 1, 0, 0, "image", 10.0),          # not a text block
        ("d", 1, 2, 0, 0, 0, "small", 8.0),
    ]
    df = spark.createDataFrame(rows, "source_file string, page_number int, block_no int, block_type int,"
                                     " line_no int, span_no int, text string, size double")
    got = {(r["block_no"], r["line_no"]): (r["text"], r["font_size"])
           for r in elements.spans_to_lines(df).collect()}
    assert got == {(0, 0): ("Hello World", 12.0), (2, 0): ("small", 8.0)}


@pytest.mark.parametrize("text, size, want", [
    ("Abstract", 10.0, True), ("introduction: why", 10.0, True), ("2.1 Method", 10.0, True),
    ("3. Results: all", 10.0, True), ("Methodical", 10.0, False), ("A Title", 14.0, True),
    ("A Title", 13.9, False), ("x" * 99, 14.0, True), ("x" * 100, 14.0, False),
    ("  RELATED WORK  ", 9.0, True), ("introduction to it", 9.0, False), ("1.2.3", 9.0, False),
])
def test_headings(spark, text, size, want):
    df = spark.createDataFrame([(text, size)], "text string, font_size double")
    assert elements.detect_headings(df).first()["is_heading"] is want


def brute_sections(lines):
    """Sections of one document from (page, line_no, text, is_heading) in order."""
    out, block, heading, page = [], [], "", None
    def close():
        if block:
            out.append((block[0][0], block[0][1], heading, "\n".join(b[2] for b in block)))
            block.clear()
    for p, no, text, is_heading in lines:
        if p != page or is_heading:
            close()
        page = p
        if is_heading:
            heading = text
        else:
            block.append((p, no, text))
    close()
    return out


def random_document(rng):
    n = rng.choice([0, 1, 5, 60, 130])
    pick = ["Introduction", "2. Results: x", "body text.", "more words here", "", "  ", " indented "]
    return "\n".join(rng.choice(pick) for _ in range(n))


def test_sections_match_brute_force(spark):
    rng = random.Random(4)
    docs = [(f"d{i}", random_document(rng)) for i in range(40)]
    df = spark.createDataFrame(docs, "source_file string, text string")
    want = set()
    for name, text in docs:
        lines = []
        for no, raw in enumerate(text.split("\n")):
            t = raw.strip()
            if t:
                key = t.lower().lstrip("0123456789. ")
                heading = key == "introduction" or key.startswith("results:") or (no == 0 and len(t) < 100)
                lines.append((no // 10 + 1, no, t, heading))
        want |= {(name, *s) for s in brute_sections(lines)}
    nested = elements.sectionize_documents(df, lines_per_page=10, first_line_font=16.0)
    cols = ["source_file", "page_number", "line_no", "section_heading", "content"]
    assert {tuple(r) for r in nested.select(cols).collect()} == want
    lines = elements.text_lines(df, lines_per_page=10).withColumn(
        "font_size", F.when(F.col("line_no") == 0, 16.0).otherwise(12.0))
    assert {tuple(r) for r in elements.sectionize(lines).select(cols).collect()} == want


def test_heading_crosses_many_pages(spark):
    rows = [("d", p, 0, "Methods" if p == 1 else f"text {p}", 10.0) for p in range(1, 3000)]
    df = spark.createDataFrame(rows, "source_file string, page_number int, line_no int, text string,"
                                     " font_size double")
    got = elements.sectionize(df)
    assert got.count() == 2998
    assert got.where("section_heading <> 'Methods'").count() == 0


TABLES = "source_file string, page_number int, table_idx long, raw array<array<string>>"


def test_tables(spark):
    rows = [("d", 1, 0, [["a", None], ["1", "2"], ["3", "4"]]), ("d", 1, 1, []), ("d", 1, 2, [["x"]]),
            ("d", 2, 3, [["y", "z"]])]
    got = {r["element_no"]: r for r in elements.table_elements(spark.createDataFrame(rows, TABLES)).collect()}
    assert sorted(got) == [0, 2, 3]
    assert got[0]["content"] == "| a |  |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |\n"
    assert [got[i]["section_heading"] for i in (0, 2, 3)] == ["Table 1", "Table 3", "Table 1"]
    assert (got[0]["table_data"]["rows"], got[0]["table_data"]["cols"]) == (3, 2)
    assert got[2]["content"] == "| x |\n| --- |\n"


def test_figures_are_numbered_from_one(spark):
    df = spark.createDataFrame([("d", 3, 7, "png"), ("d", 3, 9, "jpg"), ("d", 4, 10, "png")],
                               "source_file string, page_number int, seq long, ext string")
    rows = elements.figure_elements(df, "img").orderBy("element_no").collect()
    assert [r["image_path"] for r in rows] == ["img/d_p3_img1.png", "img/d_p3_img2.jpg", "img/d_p4_img1.png"]
    assert rows[0]["content"] == ("[Figure on page 3] Image extracted from the document. "
                                  "Path: img/d_p3_img1.png")


def test_ocr_boxes(spark):
    images = spark.createDataFrame([("a",), ("none",)], "image string")
    boxes = spark.createDataFrame([("a", 1, "two", 0.9), ("a", 0, "one", 0.4)],
                                  "image string, box_no int, text string, confidence double")
    got = {r["image"]: (r["content"], r["confidence"])
           for r in elements.ocr_boxes_to_elements(images, boxes).collect()}
    assert got == {"a": ("one two", 0.4), "none": ("", 0.0)}


def test_split_latex_response(spark):
    raws = ["```latex x^2```\n It is a square. ", "x", "```latex\nx^2\n```"]
    df = spark.createDataFrame([(r,) for r in raws], "raw string")
    got = [(r["latex"], r["explanation"]) for r in elements.split_latex_response(df).collect()]
    assert got == [("x^2", "It is a square."), ("x", ""), ("", "x^2\n```")]


def test_html_lines(spark):
    html = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
            "<h1>Big &amp; bold</h1><p>one <b>two</b><br>three<ul><li>four</li></ul><h3>Sub</h3>tail")
    df = spark.createDataFrame([("p", 1, html), ("e", 1, None)], "source_file string, page_number int, html string")
    got = [(r["text"], r["font_size"]) for r in elements.html_lines(df).orderBy("line_no").collect()]
    assert got == [("T", 12.0), ("Big & bold", 24.0), ("one two", 12.0), ("three", 12.0), ("four", 12.0),
                   ("Sub", 18.0), ("tail", 12.0)]


def test_spans_are_grouped_as_runs_in_any_order(spark):
    rng = random.Random(4)
    rows = [(f"d{d}" if d else None, 1, b, 0, n, i, f" w{i}", None if i % 3 else 9.0 + i)
            for d in range(3) for b in range(2) for n in range(4) for i in range(20)]
    names = "source_file string, page_number int, block_no int, block_type int, line_no int, span_no int, text string, size double"
    want = {(r[0], 1, r[2], r[4], " ".join(f"w{i}" for i in range(20)), 27.0) for r in rows}
    for turned in (rows, rng.sample(rows, len(rows))):
        lines = elements.spans_to_lines(spark.createDataFrame(turned, names).coalesce(2))
        assert {tuple(r) for r in lines.collect()} == want and lines.count() == len(want)
    assert "MapInArrow" in lines._jdf.queryExecution().executedPlan().toString()


def test_order_lines_move_as_columns_not_as_cells(spark, tmp_path):
    lines = [(1, 2, 20, 5, "N"), (1, 1, 10, 5, "R"), (1, 1, 10, 5, "N"), (1, 1, 9, 7, None)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    tables = views.raw_tables(spark, str(tmp_path))
    raw = {r["table_idx"]: r["raw"] for r in tables.collect()}
    assert raw == {1: [["line", "part", "flag"], ["1", "9", None], ["1", "10", None], ["1", "10", "R"],
                       ["2", "20", None]], 2: []}
    plan = tables._jdf.queryExecution().executedPlan().toString()
    collected = [line for line in plan.splitlines() if "partial_collect_list(" in line]
    assert collected and not any("array(" in line for line in collected)
