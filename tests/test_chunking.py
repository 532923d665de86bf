"""Chunk boundaries against a plain recursive splitter, and chunk numbering."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import chunking
from corpusloom.plans import ingest

SEPS = ["\n\n", "\n", ". ", " ", ""]


def plain_split(text, size, overlap, seps=SEPS):
    """Textbook recursive splitting on strings, separators kept in front."""
    sep = next(s for s in seps if s == "" or s in text)
    rest = seps[seps.index(sep) + 1:]
    if sep == "":
        parts = list(text)
    else:
        head, *tail = text.split(sep)
        parts = [p for p in [head, *[sep + t for t in tail]] if p]
    out, good = [], []

    def merge():
        current, total = [], 0
        for p in good:
            if total + len(p) > size and current:
                out.append("".join(current))
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(current.pop(0))
            current.append(p)
            total += len(p)
        if current:
            out.append("".join(current))
        good.clear()

    for p in parts:
        if len(p) < size:
            good.append(p)
            continue
        if good:
            merge()
        if rest:
            out.extend(plain_split(p, size, overlap, rest))
        else:
            out.append(p)
    if good:
        merge()
    return out


def expected(text, size, overlap):
    return [p.strip() for p in plain_split(text, size, overlap) if p.strip()] if text else []


pieces = st.lists(st.sampled_from(["\n\n", "\n", ". ", " ", "a", "word", "longerword" * 3, ".", "é", "x" * 45]),
                  max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces, st.sampled_from([(20, 5), (40, 10), (13, 0), (30, 29)]))
def test_split_matches_plain_splitter(text, sizes):
    size, overlap = sizes
    got = chunking.split_text(text, size, overlap)
    assert got == expected(text, size, overlap)
    assert all(0 < len(c) <= size for c in got)


@settings(max_examples=100, deadline=None)
@given(pieces)
def test_every_visible_character_is_covered_in_order(text):
    spans = chunking.split_spans(text, 25, 6) if text else []
    covered = set()
    last = -1
    for lo, hi in spans:
        assert hi - lo <= 25 and lo > last
        last = lo
        covered |= set(range(lo, hi))
    assert covered == set(range(len(text)))


def test_defaults_apply_to_falsy_sizes(spark):
    df = spark.createDataFrame([("word " * 400,)], "text string")
    a = df.select(chunking.pieces(F.col("text"), 0, None)).first()[0]
    assert a == chunking.split_text("word " * 400, 512, 50)
    assert max(map(len, a)) <= 512


def test_documents_are_chunked_like_their_sections(spark):
    rng = random.Random(2)
    docs = [(f"d{i}", "\n".join(rng.choice(["Introduction", "word " * rng.randint(1, 200), ""])
                                for _ in range(rng.randint(0, 60)))) for i in range(12)]
    df = spark.createDataFrame(docs, "source_file string, text string")
    got = ingest.chunk_documents(df).collect()
    from corpusloom.operators import elements
    sections = elements.sectionize_documents(df).collect()
    want = {}
    for s in sorted(sections, key=lambda r: (r["source_file"], r["line_no"])):
        parts = want.setdefault(s["source_file"], [])
        parts += [(s["page_number"], s["section_heading"], c) for c in expected(s["content"], 512, 50)]
    have = {}
    for r in sorted(got, key=lambda r: (r["source_file"], r["chunk_index"])):
        have.setdefault(r["source_file"], []).append((r["page_number"], r["section_heading"], r["content"]))
    assert have == want
    assert len({r["chunk_id"] for r in got}) == len(got)


ELEMENTS = ("source_file string, element_no long, element_type string, content string, page_number int,"
            " section_heading string, table_data struct<rows:int,cols:int,raw:array<array<string>>>,"
            " image_path string, confidence double, type_order int")


def test_chunk_elements(spark):
    rows = [
        ("d", 0, "text", "word " * 150, 1, "S", None, None, 1.0, 0),
        ("d", 1, "text", " \n ", 1, "S", None, None, 1.0, 0),
        ("d", 0, "table", "| a |\n" * 200, 1, "Table 1", (1, 1, [["a"]]), None, 1.0, 1),
        ("d", 0, "figure", " fig text ", 2, "", None, "i.png", 1.0, 2),
        ("d", 1, "equation", "x^2", 2, "", None, None, 0.5, 2),
        ("d", 2, "sketch", "dropped", 2, "", None, None, 1.0, 2),
        ("e", 0, "figure", "only", 1, "", None, "j.png", 1.0, 2),
    ]
    got = chunking.chunk_elements(spark.createDataFrame(rows, ELEMENTS)).orderBy("source_file", "chunk_index").collect()
    assert [(r["source_file"], r["chunk_index"], r["content_type"]) for r in got] == [
        ("d", 0, "text"), ("d", 1, "text"), ("d", 2, "table"), ("d", 3, "figure"), ("d", 4, "equation"),
        ("e", 0, "figure")]
    assert got[0]["element_type"] == "paragraph"
    assert got[2]["content"] == "| a |\n" * 200 and got[2]["table_data"]["raw"] == [["a"]]
    assert got[3]["content"] == " fig text " and got[3]["image_description"] == " fig text "
    assert got[4]["latex_source"] == "x^2" and got[4]["image_path"] is None


@pytest.mark.parametrize("block_pages", [1, 3, 256])
def test_chunk_index_does_not_depend_on_blocks(spark, block_pages):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < .5 else "s", t, rng.randint(1, 40), n, 0)
            for n, t in enumerate(rng.choices([0, 1, 2], k=300))]
    df = spark.createDataFrame(rows, "source_file string, type_order int, page_number int, element_no long, piece_no int")
    got = chunking.chunk_index(df, block_pages).collect()
    for source in ("hot", "s"):
        mine = sorted((r for r in got if r["source_file"] == source),
                      key=lambda r: (r["type_order"], r["page_number"], r["element_no"]))
        assert [r["chunk_index"] for r in mine] == list(range(len(mine)))


def test_table_function_equals_the_operator(spark):
    rows = [(1, "One two three. " * 90), (2, "short"), (3, None), (4, " \n "), (5, "x" * 1500),
            (6, "a\n\nb c\n" * 200)]
    docs = spark.createDataFrame(rows, "id int, text string")
    chunking.register_split_chunks(spark)
    got = spark.sql("SELECT id, piece_no, content FROM {docs}, LATERAL split_chunks(text, 200, 20)",
                    docs=docs).collect()
    elements_ = docs.selectExpr("id", "text AS content", "'text' AS element_type")
    want = chunking.chunk_text(elements_, 200, 20).select("id", "piece_no", "content").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20
    default = spark.sql("SELECT id, piece_no, content FROM {docs}, LATERAL split_chunks(text, NULL, 0)",
                        docs=docs).collect()
    want = chunking.chunk_text(elements_).select("id", "piece_no", "content").collect()
    assert sorted(map(tuple, default)) == sorted(map(tuple, want))
