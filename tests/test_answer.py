"""Requests answered end to end on a tiny corpus whose scores can be read off."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.operators import context as ctx
from corpusloom.operators import retrieval
from corpusloom.plans import answer, ingest


#: chunk id, source, page, section, direction on the circle in degrees, length of its text
CHUNKS = [
    ("c0", "p1", 1, "S", 0, 20), ("c1", "p1", 1, "S", 10, 20), ("c2", "p1", 2, "", 20, 3990),
    ("c3", "p2", 5, "T", 30, 20), ("c4", "p2", 6, "T", 90, 20), ("c5", "p3", 1, "", 180, 20),
]
#: the direction of each query text
ASKED = {"alpha": 0, "beta": 90, "gamma": 180}


def corpus(spark):
    rows = [(c, s, page, section, "text", "paragraph", c + "x" * (n - 2),
             [math.cos(math.radians(at)), math.sin(math.radians(at))])
            for c, s, page, section, at, n in CHUNKS]
    df = spark.createDataFrame(rows, "chunk_id string, source_file string, page_number int, section_heading string,"
                                     " content_type string, element_type string, content string, embedding array<double>")
    return df.select("*", F.lit("").alias("image_path"), F.lit("").alias("image_description"),
                     F.lit("").alias("latex_source"), F.lit(None).cast(schemas.TABLE_DATA).alias("table_data"))


def ask(spark, *requests):
    """Answer rows by id of requests (id, task, question, source, second, top_k, threshold)."""
    df = spark.createDataFrame(
        list(requests), "task_id string, task string, question string, source string,"
        " second_source string, top_k int, similarity_threshold double")
    at = F.lit(0.0)
    for text, degrees in ASKED.items():
        at = F.when(F.col("query_text") == text, F.radians(F.lit(float(degrees)))).otherwise(at)
    vector = F.array(F.cos(at), F.sin(at))
    rows = answer.answer_requests(df, corpus(spark), lambda q: q.withColumn("vector", vector))
    return {r["task_id"]: r for r in rows.collect()}


def block(chunk, relevance):
    c, s, page, section, _, n = next(x for x in CHUNKS if x[0] == chunk)
    section = f", Section: {section}" if section else ""
    return f"[Source: {s}, Page {page}{section}] (Relevance: {relevance})\n{c}{'x' * (n - 2)}\n"


def test_question(spark):
    got = ask(spark, ("all", "question_answering", "alpha", "", None, None, None),
              ("two", "question_answering", "alpha", None, None, 2, None),
              ("close", "question_answering", "alpha", None, None, None, 0.98),
              ("none", "question_answering", "alpha", "absent", None, None, None))
    # c5 points the other way: score 0, below the floor of 0.3; c2 overruns the budget
    assert got["all"]["chunks_used"] == 5 and got["all"]["default_answer"] is None
    assert got["all"]["context"] == block("c0", "1.00") + "\n---\n" + block("c1", "0.99")
    assert [(c["source_file"], c["page_number"], c["relevance_score"])
            for c in got["all"]["citations"]] == [
        ("p1", 1, 1.0), ("p1", 2, 0.97), ("p2", 5, 0.933), ("p2", 6, 0.5)]
    assert got["two"]["chunks_used"] == 2 and got["close"]["chunks_used"] == 2
    assert got["none"]["context"] == "" and got["none"]["prompt"] is None
    assert got["none"]["default_answer"] == ctx.DEFAULT_ANSWERS["question_answering"]
    assert got["all"]["prompt"].endswith("Question: alpha\nAnswer:")


def test_comparison_names_both_papers(spark):
    got = ask(spark, ("ab", "comparison", None, "p1", "p2", 1, None),
              ("a", "comparison", None, "p2", "absent", None, None))
    assert got["ab"]["chunks_used"] == 5  # its k is not the request's to set
    assert got["ab"]["context"] == (
        block("c0", "1.00") + "\n---\n" + block("c1", "0.99") + "\n======\n"
        + block("c3", "0.93") + "\n---\n" + block("c4", "0.50"))
    assert got["ab"]["query"] == "Compare: p1 vs p2"
    prompt = got["a"]["prompt"]
    assert "First paper, p2:\n" + block("c3", "0.93") in prompt
    assert "Second paper, absent:\n\n" in prompt


def test_labels_and_stand_ins(spark):
    got = ask(spark, ("survey", "literature_survey", "", None, None, None, None),
              ("topic", "literature_survey", "beta", None, None, 1, None),
              ("sum", "summarization", None, "", None, None, None),
              ("sum3", "summarization", None, "p3", None, None, None),
              ("explain", "concept_explanation", "gamma", "absent", None, None, None),
              ("gaps", "research_gaps", None, "p1", None, 1, 0.98))
    assert got["survey"]["query"] == "Literature survey: all papers"
    assert "survey on the uploaded research papers" in got["survey"]["prompt"]
    assert got["topic"]["query"] == "Literature survey: beta" and got["topic"]["chunks_used"] == 1
    assert got["topic"]["citations"][0]["page_number"] == 6
    assert got["sum"]["query"] == "Summarize: all documents"
    assert got["sum3"]["query"] == "Summarize: p3" and got["sum3"]["chunks_used"] == 0
    assert got["explain"]["default_answer"] == (
        "No relevant content found for 'gamma' in the uploaded papers.")
    # three queries with the same hits: each chunk counts once
    assert got["gaps"]["chunks_used"] == 2 and got["gaps"]["query"] == "Research gap identification"


def test_a_hit_without_its_chunk_row_is_kept(spark):
    hits = spark.createDataFrame([("q", "c0", 0.9, 1), ("q", "gone", 0.8, 2)],
                                 "query_id string, chunk_id string, score double, rank int")
    full = retrieval.attach_chunks(hits, corpus(spark))
    assert {r["chunk_id"]: r["content"] is None for r in full.collect()} == {"c0": False, "gone": True}
    packed = ctx.pack_context(full, 4000).first()
    assert packed["chunks_used"] == 2 and packed["context"].startswith("[Source: p1")


def elements_of(spark, rows):
    return spark.createDataFrame(
        [(f, 1, kind, text, 1, "", None, "img.png" if kind == "figure" else None, 1.0, order)
         for f, kind, text, order in rows],
        T.StructType([*schemas.ELEMENTS.fields, T.StructField("type_order", T.IntegerType())]))


def stored(spark, tmp_path):
    chunks = ingest.read_store(spark, str(tmp_path / "store")).collect()
    listed = ingest.read_store(spark, str(tmp_path / "catalog")).collect()
    return chunks, {r["filename"]: (r["status"], r["total_chunks"], r["total_pages"]) for r in listed}


def test_store_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Abstract\nalpha beta. gamma"), ("blank", " \n "), ("b", "beta")],
                                 "source_file string, text string")
    atomic = elements_of(spark, [("a", "table", "| x |", 1), ("a", "figure", "a figure", 2),
                                 ("c", "equation", "x_1", 3)])
    where = [str(tmp_path / "store"), str(tmp_path / "catalog")]
    first = ingest.store_batch(docs, *where, atomic=atomic)
    want = {("a", 0, "text", "alpha beta. gamma"), ("a", 1, "table", "| x |"),
            ("a", 2, "figure", "a figure"), ("b", 0, "text", "beta"), ("c", 0, "equation", "x_1")}
    status = {"a": ("completed", 3, 1), "b": ("completed", 1, 1), "blank": ("failed", 0, 0),
              "c": ("completed", 1, 1)}
    for _ in range(2):  # the second time nothing changes
        chunks, listed = stored(spark, tmp_path)
        assert len(chunks) == 5 and listed == status
        assert {(r["source_file"], r["chunk_index"], r["content_type"], r["content"]) for r in chunks} == want
        again = ingest.store_batch(docs, *where, atomic=atomic)
    assert again.weights == first.weights  # one model for all batches
    other = spark.createDataFrame([("d", "delta alpha")], "source_file string, text string")
    assert ingest.store_batch(other, *where).weights == first.weights
    assert len(stored(spark, tmp_path)[0]) == 6


def test_delete_documents(spark, tmp_path):
    docs = spark.createDataFrame([(n, f"text of {n}") for n in "abcdef"], "source_file string, text string")
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    ingest.store_batch(docs, store, catalog)
    ids = spark.createDataFrame([("a",), ("e",), ("zz",)], "n string").select(F.sha2("n", 256).alias("id"))
    report = ingest.delete_documents(spark, ids, store, catalog).collect()
    assert sorted((r["found"], r["removed_chunks"]) for r in report) == [(False, 0), (True, 1), (True, 1)]
    chunks, listed = stored(spark, tmp_path)
    assert {r["source_file"] for r in chunks} == set(listed) == set("bcdf")


def test_atomic_chunks_move_once(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one"), ("a", "two"), ("b", "three")],
                                 "source_file string, text string")
    folder = str(tmp_path / "elements")
    elements_of(spark, [("a", "figure", "fig", 2), ("a", "table", "| x |", 1), ("c", "equation", "x", 3),
                        ("b", "table", "| y |", 1)]).write.parquet(folder)
    chunks = ingest.atomic_chunks(spark.read.parquet(folder), ingest.chunk_documents(docs))
    assert sorted((r["source_file"], r["chunk_index"], r["content"]) for r in chunks.collect()) == [
        ("a", 2, "| x |"), ("a", 3, "fig"), ("b", 1, "| y |"), ("c", 0, "x")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:  # the texts' counts meet the row per block, not the contents
        plan = chunks.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(wide) > 1 and plan.count("SortMergeJoin") == 2
    tail = plan[plan.index("SortMergeJoin"):]
    assert tail.index("Window") < tail.index("Exchange")  # numbered where they are joined


def test_failed_ingest_stays_listed_as_processing(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha")], "source_file string, text string")
    with pytest.raises(Exception):  # noqa: B017
        ingest.store_batch(docs, str(tmp_path / "store"), str(tmp_path / "catalog"),
                           atomic=docs)  # not a table of elements
    assert [r["status"] for r in ingest.read_store(spark, str(tmp_path / "catalog")).collect()] == ["processing"]
