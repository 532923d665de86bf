"""Catalog rules, contexts, citations, visuals and trace parsing on small frames."""

from pyspark.sql import functions as F

from corpusloom.operators import catalog as cat
from corpusloom.operators import context as ctx
from corpusloom.operators import evaluation as ev
from corpusloom.operators import traces

CATALOG = ("id string, filename string, file_path string, file_type string, total_pages int,"
           " total_chunks int, ingested_at timestamp, status string")


def catalog(spark):
    import datetime
    t = datetime.datetime(2024, 1, 1)
    rows = [("1", "a.pdf", "p1", "pdf", 3, 9, t, "completed"), ("2", "a.pdf", "p2", "pdf", 4, 8, t, "completed"),
            ("3", "b.pdf", "p3", "pdf", None, None, t, "processing")]
    return spark.createDataFrame(rows, CATALOG)


def test_failed_status_zeroes_counts(spark):
    updates = spark.createDataFrame([("1", "completed", 5, 6, 1), ("1", "failed", None, None, 2)],
                                    "id string, status string, total_chunks int, total_pages int, version long")
    rows = {r["id"]: (r["status"], r["total_chunks"], r["total_pages"])
            for r in cat.catalog_apply_status(catalog(spark), updates).collect()}
    assert rows == {"1": ("failed", 0, 0), "2": ("completed", 8, 4), "3": ("processing", None, None)}


def test_delete_takes_chunks_of_same_filename(spark):
    chunks = spark.createDataFrame([("x", "a.pdf"), ("y", "a.pdf"), ("z", "b.pdf")], "chunk_id string, source_file string")
    ids = spark.createDataFrame([("1",), ("nope",)], "id string")
    kept, kept_chunks, report = cat.catalog_delete_cascade(catalog(spark), chunks, ids)
    assert {r["id"] for r in kept.collect()} == {"2", "3"}
    assert {r["chunk_id"] for r in kept_chunks.collect()} == {"z"}
    assert {tuple(r) for r in report.collect()} == {("1", True, 2), ("nope", False, 0)}


def test_completed_papers_default_line(spark):
    empty = catalog(spark).where("status = 'x'")
    assert [r["line"] for r in cat.completed_papers(empty).collect()] == [cat.NO_PAPERS]
    assert {r["line"] for r in cat.completed_papers(catalog(spark)).collect()} == {
        "- a.pdf  (3 pages, 9 chunks)", "- a.pdf  (4 pages, 8 chunks)"}


def test_corpus_stats_and_processing(spark):
    assert tuple(cat.corpus_stats(catalog(spark)).first()) == (3, 7, 17)
    assert cat.any_processing(catalog(spark)).first()[0] is True
    assert cat.any_processing(catalog(spark).limit(0)).first()[0] is False


def test_chunk_upsert_is_idempotent(spark):
    schema = ("chunk_id string, embedding array<float>, image_path string, image_description string,"
              " latex_source string, table_data struct<rows:int,cols:int,raw:array<array<string>>>, version long")
    rows = [("a", [1.0], None, None, None, (1, 1, [["x"]]), 1), ("b", None, "p", "q", "r", None, 1)]
    once = cat.chunk_upsert(None, spark.createDataFrame(rows, schema))
    twice = cat.chunk_upsert(once, spark.createDataFrame(rows, schema))
    for df in (once, twice):
        [r] = df.collect()
        assert (r["chunk_id"], r["image_path"], r["table_data_json"]) == ("a", "", '{"rows":1,"cols":1,"raw":[["x"]]}')


HITS = ("query_id string, rank int, score double, source_file string, page_number int, section_heading string,"
        " content string, element_type string, content_type string, image_path string, image_description string,"
        " table_data struct<rows:int,cols:int,raw:array<array<string>>>, latex_source string")


def hit(rank, score, page, kind="paragraph", heading="", content="x", image="", table=None, latex=None):
    return ("q", rank, score, "f", page, heading, content, kind, "text" if kind == "paragraph" else kind,
            image, "", table, latex)


def test_packing_stops_at_first_overflow(spark):
    rows = [hit(1, 0.875, 1, heading="H", content="a" * 10), hit(2, 0.5, 2, content="b" * 500),
            hit(3, 0.4, 3, content="c")]
    r = ctx.pack_context(spark.createDataFrame(rows, HITS), 200).first()
    assert r["context"] == "[Source: f, Page 1, Section: H] (Relevance: 0.88)\n" + "a" * 10 + "\n"
    assert (r["blocks_used"], r["chunks_used"]) == (1, 3)


def test_score_text_is_rounded_half_even(spark):
    rows = [hit(1, 0.125, 1), hit(2, 0.635, 1)]
    text = ctx.pack_context(spark.createDataFrame(rows, HITS)).first()["context"]
    assert f"{0.125:.2f}" in text and f"{0.635:.2f}" in text


def test_citations(spark):
    t = (1, 1, [["x"]])
    rows = [hit(1, 0.91234, 1), hit(2, 0.9, 1), hit(3, 0.8, 1, "table", table=t), hit(4, 0.7, 1, "table", table=t),
            hit(5, 0.6, 1, "figure", image="s/a.png"), hit(6, 0.5, 1, "figure", image="t/a.png"),
            hit(7, 0.4, 1, "figure", image="s/b.png"), hit(8, 0.3, 2, "equation", latex="x")]
    cited = ctx.citations(spark.createDataFrame(rows, HITS))
    got = [(r["citation_no"], r["relevance_score"], r["element_type"], r["image_url"])
           for r in cited.orderBy("citation_no").collect()]
    assert got == [(1, 0.912, "paragraph", None), (2, 0.8, "table", None), (3, 0.6, "figure", "/images/a.png"),
                   (4, 0.4, "figure", "/images/b.png"), (5, 0.3, "equation", None)]
    shown = [(r["citation_no"], r["display"]) for r in ctx.visual_citations(cited).orderBy("citation_no").collect()]
    assert shown == [(2, "table"), (3, "image"), (4, "image"), (5, "equation")]


def test_list_visuals_drops_small_and_unknown_images(spark):
    chunks = spark.createDataFrame(
        [("a", "f", "figure", 2, "", "x" * 600, "i/a.png"), ("b", "f", "figure", 1, "", "x", "i/b.png"),
         ("c", "f", "figure", 1, "", "x", "i/none.png"), ("d", "f", "table", 2, "", "x", ""),
         ("e", "f", "equation", 1, "", "x", "i/b.png"), ("p", "f", "paragraph", 1, "", "x", "")],
        "chunk_id string, source_file string, element_type string, page_number int, section_heading string,"
        " content string, image_path string")
    meta = spark.createDataFrame([("i/a.png", 50, 50), ("i/b.png", 49, 90)], "image_path string, width int, height int")
    got = [(r["chunk_id"], len(r["content"])) for r in ctx.list_visuals(chunks, meta).collect()]
    assert got == [("a", 500), ("d", 1)]


def test_neighbor_context_on_a_hot_page(spark):
    rows = [(f"p{i:04d}", "hot", "paragraph", 5, i, f"text {i} " + "z" * 700) for i in range(2000)]
    rows += [("n", "hot", "paragraph", 6, -1, "next page"), ("far", "hot", "paragraph", 8, -2, "far page")]
    chunks = spark.createDataFrame(rows, "chunk_id string, source_file string, element_type string,"
                                         " page_number int, chunk_index int, content string")
    visuals = spark.createDataFrame([("v", "hot", 5), ("w", "hot", 20)], "chunk_id string, source_file string, page_number int")
    got = {r["chunk_id"]: r["context"] for r in ctx.neighbor_context(visuals, chunks).collect()}
    want = ["next page"] + [(f"text {i} " + "z" * 700)[:600] for i in range(4)]
    assert got == {"v": "\n\n".join(want), "w": "(no surrounding text available)"}


def test_table_preview(spark):
    long = [["c" * 50, "d" * 50], ["e" * 50, "f"]]
    rows = [(["a", None], None, 1, 1), (None, [[" x ", None, " "], [" "], ["y"], ["z"]], 4, 1), (None, long, 2, 2),
            (None, [[" "]], 1, None), ([], None, None, None)]
    df = spark.createDataFrame(rows, "names array<string>, raw array<array<string>>, r int, c int")
    got = [r[0] for r in df.select(ctx.table_preview(F.col("names"), F.col("raw"), F.col("r"), F.col("c"))).collect()]
    joined = "\n".join(" | ".join(r) for r in long)
    assert got == ["a | ", "x\ny", joined[:120], "Table · 1 rows × ? cols", "Table"]


def test_answer_shell_has_every_request(spark):
    requests = spark.createDataFrame([("1", "summarization", ""), ("2", "concept_explanation", "entropy")],
                                     "task_id string, task string, question string")
    packed = spark.createDataFrame([("1", "ctx", 1, 7)], "task_id string, context string, blocks_used long, chunks_used long")
    cites = spark.createDataFrame([("1", 3)], "task_id string, n_citations long")
    got = {r["task_id"]: r for r in ctx.answer_shell(requests, packed, cites).collect()}
    assert (got["1"]["chunks_used"], got["1"]["default_answer"]) == (7, None)
    assert (got["2"]["context"], got["2"]["chunks_used"], got["2"]["n_citations"]) == ("", 0, 0)
    assert got["2"]["default_answer"] == "No relevant content found for 'entropy' in the uploaded papers."


def test_parse_react(spark):
    raws = ['Think hard.\nAction: search_text\nAction Input: {"query": "x", "n": 3}', "only words ",
            'go action: finish action input: {"answer": "two\nlines", oops}', "Action: finish\nAction Input: {nope}"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "id int, raw string")
    got = [(r["thought"], r["action"], r["action_input"]) for r in traces.parse_react(df).orderBy("id").collect()]
    assert got == [("Think hard.", "search_text", {"query": "x", "n": "3"}), ("only words", "", {}),
                   ("go", "finish", {"answer": "two\nlines"}), ("", "finish", {"raw_input": "{nope}"})]


def test_mrr_and_hit_rate_example(spark):
    queries = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    judged = spark.createDataFrame([("a", 1, True), ("b", 3, True), ("b", 4, True), ("c", 2, True), ("d", 11, True)],
                                   "query_id string, rank int, relevant boolean")
    per_query = ev.per_query_quality(queries, judged, 10)
    assert abs(ev.mrr(per_query).first()["mrr"] - (1 + 1 / 3 + 1 / 2) / 4) < 1e-12
    assert ev.hit_rate(per_query).first()["hit_rate"] == 0.75


def test_percentiles_are_exact(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    values = np.round(rng.exponential(20, 501), 2)
    df = spark.createDataFrame([("e", float(v)) for v in values] + [("one", 3.5)], "endpoint string, latency_s double")
    got = {r["endpoint"]: r for r in ev.latency_percentiles(df, block_width=5.0).collect()}
    for share in (0.5, 0.9, 0.99):
        assert abs(got["e"][f"p{round(share * 100)}"] - np.quantile(values, share)) < 1e-9
    assert got["one"]["p99"] == 3.5


def test_percentile_sketch_is_within_its_error(spark):
    import numpy as np
    values = np.sort(np.random.default_rng(1).exponential(20, 5000))
    df = spark.createDataFrame([("e", float(v)) for v in values], "endpoint string, latency_s double")
    got = ev.latency_percentiles_approx(df, accuracy=100).first()
    for share in (0.5, 0.9, 0.99):
        rank = np.searchsorted(values, got[f"p{round(share * 100)}"], side="right") / len(values)
        assert abs(rank - share) <= 1 / 100 + 1 / len(values)


def test_answer_f1(spark):
    df = spark.createDataFrame([(1, "a a b", "a b c"), (2, "", ""), (3, "x", "y"), (4, None, "y")],
                               "id int, predicted string, truth string")
    got = {r["id"]: r["f1"] for r in ev.answer_f1(df).collect()}
    assert abs(got[1] - 2 * 2 / 6) < 1e-12 and (got[2], got[3], got[4]) == (0.0, 0.0, 0.0)


def test_char_error_rate(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", "")], "a string, b string")
    got = [r[0] for r in df.select(ev.char_error_rate(F.col("a"), F.col("b"))).collect()]
    assert got == [3 / 7, None]


def test_ties_are_settled_after_the_shuffle(spark):
    rows = spark.createDataFrame(
        [("a", 1, "old"), ("a", 2, "y"), ("a", 2, "x"), ("b", None, "n"), (None, 3, "q"), (None, 3, "p")],
        "id string, version long, text string")
    last = cat.last_version(rows, "version")
    plan = last._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "json" in above.lower() and "json" not in below.lower()
    assert sorted(map(tuple, last.collect()), key=str) == [
        ("a", 2, "x"), ("b", None, "n"), (None, 3, "p")]
