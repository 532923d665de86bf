"""Tool requests: every kind of observation, read off a tiny corpus."""

from pyspark.sql import functions as F

from corpusloom.operators import tools, traces

CHUNKS = [
    ("c0", "p1", 1, "S", 0, "text", "first text", [1.0, 0.0]),
    ("c1", "p1", 2, "", 1, "table", "a table", [0.6, 0.8]),
    ("c2", "p2", 1, "", 0, "text", None, [0.0, 1.0]),
]


def ask(spark, *requests, papers=()):
    chunks = spark.createDataFrame(
        CHUNKS, "chunk_id string, source_file string, page_number int, section_heading string,"
        " chunk_index long, content_type string, content string, embedding array<double>")
    catalog = spark.createDataFrame(
        list(papers), "id string, filename string, total_pages int, total_chunks int, status string,"
        " ingested_at timestamp")
    rows = spark.createDataFrame(
        [(str(i), *r) for i, r in enumerate(requests)],
        "request_id string, action string, action_input map<string,string>")
    vector = F.array(F.lit(1.0), F.lit(0.0))
    got = tools.run_tools(rows, lambda q: q.withColumn("vector", vector), chunks, chunks, catalog)
    return {int(r["request_id"]): r["observation"] for r in got.collect()}


def test_observations(spark):
    got = ask(
        spark,
        ("search_text", {"query": "x"}),
        ("SEARCH_TABLES", {"query": "x", "source_file": "p1"}),
        ("search_figures", {"query": "x", "source_file": "p2"}),  # falls back to any type
        ("search_equations", {"query": "x", "source_file": "absent"}),
        ("get_paper_preview", {"source_file": " p1 "}),
        ("get_paper_preview", {"source_file": "none"}),
        ("finish", {"answer": "done"}),
    )
    assert got[0] == "[p1, p.1, §S] (score=1.00)\nfirst text\n\n[p2, p.1] (score=0.50)\n"
    assert got[1] == "[p1, p.2] (score=0.80)\na table"
    assert got[2] == "[p2, p.1] (score=0.50)\n"
    assert got[3] == "No relevant equation content found for query: 'x'."
    assert got[4] == ("Preview of top sections in 'p1':\n\n--- [Chunk 0] ---\nfirst text\n\n"
                      "--- [Chunk 1] ---\na table\n\n")
    assert got[5] == "No preview available for paper 'none'."
    assert 6 not in got


def test_messages(spark):
    got = ask(
        spark, ("lookup", {}), ("search_text", {}), ("search_text", None),
        ("search_tables", {"query": "x", "depth": "2", "b": "1"}), ("get_paper_list", {"x": "1"}),
        ("get_paper_list", {}),
    )
    assert got[0].startswith("Unknown tool 'lookup'. Available tools: ['search_text', ")
    assert got[1] == got[2] == "Invalid arguments for tool 'search_text': missing query"
    assert got[3] == "Invalid arguments for tool 'search_tables': unexpected b, depth"
    assert got[4] == "Invalid arguments for tool 'get_paper_list': unexpected x"
    assert got[5] == "No papers have been uploaded and processed yet."


def test_paper_list(spark):
    import datetime

    day = datetime.datetime(2024, 1, 1)
    papers = [("a", "old.pdf", 3, 9, "completed", day),
              ("b", "new.pdf", 1, 2, "completed", day + datetime.timedelta(days=1)),
              ("c", "bad.pdf", 0, 0, "failed", day)]
    got = ask(spark, ("get_paper_list", {}), papers=papers)
    assert got[0] == ("Available research papers:\n- new.pdf  (1 pages, 2 chunks)\n"
                      "- old.pdf  (3 pages, 9 chunks)")


def test_digest_has_all_steps(spark):
    rows = [("long", i, f"t{i}", "search_text", "{}", "o" * 600) for i in range(14, 0, -1)]
    rows += [("short", 2, "b", "finish", "{}", "done"), ("short", 1, "a", "search_text", "{}", "seen"),
             (None, 1, "n", "finish", "{}", "x")]
    steps = spark.createDataFrame(
        rows, "run_id string, step_number int, thought string, action string,"
        " action_input_json string, observation string")
    got = {r["run_id"]: r for r in traces.trace_digest(steps).collect()}
    assert {k: r["n_steps"] for k, r in got.items()} == {"long": 14, "short": 2, None: 1}
    assert got["short"]["trace"] == (
        "Step 1: a\nAction: search_text({})\nObservation: seen...\n\n"
        "Step 2: b\nAction: finish({})\nObservation: done...\n\n")
    shown = [line for line in got["long"]["trace"].split("\n") if line.startswith("Step ")]
    assert shown == [f"Step {i}: t{i}" for i in range(1, 15)]
    assert "o" * 500 + "..." in got["long"]["trace"] and "o" * 501 not in got["long"]["trace"]
