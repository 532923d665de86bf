"""Nearest-neighbour search against a brute-force answer."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import retrieval

CHUNKS = "chunk_id string, source_file string, content_type string, embedding array<float>"
QUESTIONS = ("query_id string, vector array<float>, filter_source string, filter_type string, "
             "k int, similarity_threshold double")


def data(n=300, q=17, dim=8, seed=5):
    rng = np.random.default_rng(seed)
    vectors = rng.normal(size=(n, dim)).astype(np.float32)
    vectors[50:60] = vectors[40]  # exact copies: ties
    chunks = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        vector = None if i == 7 else [0.0] * dim if i == 8 else vectors[i].tolist()
        chunks.append((f"c{i:03d}", source, ["text", "table", "figure"][i % 3 % 2], vector))
    questions = []
    for j in range(q):
        questions.append((
            f"q{j:02d}", (vectors[40] if j == 0 else rng.normal(size=dim)).tolist(),
            [None, "", "hot", "s1", "missing"][j % 5], [None, "", "table"][j % 3],
            [3, 10, 25][j % 3], [None, 0.0, 0.1, 0.55][j % 4],
        ))
    return chunks, questions


def brute(chunks, questions):
    out = set()
    for qid, v, source, kind, k, _ in questions:
        v = np.array(v, dtype=np.float64)
        scored = []
        for cid, s, t, e in chunks:
            if e is None or (source and s != source) or (kind and t != kind):
                continue
            e = np.array(e, dtype=np.float32).astype(np.float64)
            if not e.any():
                continue
            cos = v @ e / np.linalg.norm(v) / np.linalg.norm(e)
            scored.append((-round((1 + cos) / 2, 6), cid))
        for rank, (score, cid) in enumerate(sorted(scored)[:k], 1):
            out.add((qid, cid, round(-score, 6), rank))
    return out


def frames(spark):
    chunks, questions = data()
    # float query vectors: what Spark stores is what is compared
    questions = [(a, [float(np.float32(x)) for x in v], *rest) for a, v, *rest in questions]
    return (chunks, questions, spark.createDataFrame(chunks, CHUNKS).repartition(4),
            spark.createDataFrame(questions, QUESTIONS))


def rows(df):
    return {(r["query_id"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in df.collect()}


def test_scan_matches_brute_force(spark):
    chunks, questions, c, q = frames(spark)
    assert rows(retrieval.knn_exact(q, c)) == brute(chunks, questions)


def test_question_blocks_match_brute_force(spark):
    chunks, questions, c, q = frames(spark)
    assert rows(retrieval.knn_exact(q, c, block_rows=4)) == brute(chunks, questions)
    plan = retrieval.knn_grid(q, c)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line and "embedding" in line]
    assert not moved


def test_small_blocks_share_a_scan(spark):
    chunks, questions, c, q = frames(spark)
    assert rows(retrieval.knn_exact(q, c, step=4)) == brute(chunks, questions)
    many = q.crossJoin(spark.range(20)).withColumn("query_id", F.concat("query_id", "id")).drop("id")
    plan = retrieval.knn_grid(many, c)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1  # 340 questions: once per 64 it was


def test_scores_of_a_full_block_are_bounded():
    rng = np.random.default_rng(3)
    n = retrieval.QUESTION_BLOCK

    def table(ids, name, count):
        vectors = pa.array(rng.normal(size=(count, 4)).tolist(), pa.list_(pa.float64()))
        return pa.table({ids: [str(i) for i in range(count)], name: vectors})

    asked = table("query_id", "vector", n)
    for name in ("filter_source", "filter_type"):
        asked = asked.append_column(name, pa.nulls(n, pa.string()))
    questions = retrieval._Questions(asked, 10)
    chunks = table("chunk_id", "embedding", 8000)
    tracemalloc.start()
    questions.offer(chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and questions.hits().num_rows == 10 * n


def test_no_questions_and_no_chunks(spark):
    _, _, c, q = frames(spark)
    assert retrieval.knn_exact(q.limit(0), c).count() == 0
    assert retrieval.knn_exact(q, c.limit(0)).count() == 0


def test_small_score_buffer(spark):
    chunks, questions = data()
    import pyarrow as pa
    table = pa.table({"query_id": [q[0] for q in questions], "vector": [q[1] for q in questions],
                      "filter_source": [q[2] for q in questions],
                      "filter_type": [q[3] for q in questions]})
    stored = pa.table({"chunk_id": [c[0] for c in chunks], "source_file": [c[1] for c in chunks],
                       "content_type": [c[2] for c in chunks],
                       "embedding": pa.array([c[3] for c in chunks], pa.list_(pa.float32()))})
    whole = retrieval._Questions(table, 5)
    whole.offer(stored)
    parts = retrieval._Questions(table, 5)
    for at in range(0, stored.num_rows, 11):
        parts.offer(stored.slice(at, 11))
    assert whole.hits().sort_by([("query_id", "ascending"), ("chunk_id", "ascending")]).equals(
        parts.hits().sort_by([("query_id", "ascending"), ("chunk_id", "ascending")]))


def test_all_probes_make_ann_exact(spark, tmp_path):
    chunks, questions, c, q = frames(spark)
    centres = retrieval.train_cells(c, 6)
    index = retrieval.write_index(c, centres, str(tmp_path / "index"))
    got = retrieval.knn_ann(q, index, centres, probes=6, block_rows=5)
    assert rows(got) == brute(chunks, questions)


def test_unprobed_cells_are_not_read(spark, tmp_path):
    _, _, c, q = frames(spark)
    centres = retrieval.train_cells(c, 6)
    index = retrieval.write_index(c, centres, str(tmp_path / "index"))
    plan = retrieval.knn_ann(q.limit(1), index, centres, probes=1)._jdf.queryExecution()
    plan = plan.executedPlan().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell#", "cell").replace("(", "") or (
        "PartitionFilters: [isnotnull(cell" in plan)
    assert not [x for x in plan.splitlines() if "Exchange" in x and "embedding" in x]


def test_few_probes_keep_most(spark, tmp_path):
    chunks, questions, c, q = frames(spark)
    exact = brute(chunks, questions)
    centres = retrieval.train_cells(c, 6)
    index = retrieval.write_index(c, centres, str(tmp_path / "index"))
    got = rows(retrieval.knn_ann(q, index, centres, probes=4))
    found = {(a, b) for a, b, _, _ in got} & {(a, b) for a, b, _, _ in exact}
    assert len(found) >= 0.6 * len(exact)


def test_threshold_runs_after_top_k(spark):
    chunks, questions, c, q = frames(spark)
    wanted = {x[0]: max(0.3, x[5] or 0.0) for x in questions}
    want = {r for r in brute(chunks, questions) if r[2] >= wanted[r[0]]}
    assert rows(retrieval.retrieve(q, c)) == want


def test_fallback_keeps_source_filter(spark):
    _, _, c, _ = frames(spark)
    q = spark.createDataFrame(
        [("a", [1.0] * 8, "hot", "handwritten"), ("b", [1.0] * 8, None, "text")],
        "query_id string, vector array<double>, filter_source string, filter_type string")
    hits = retrieval.typed_search_with_fallback(q, c).join(c, "chunk_id").collect()
    assert {r["source_file"] for r in hits if r["query_id"] == "a"} == {"hot"}
    assert all(r["fallback"] == (r["query_id"] == "a") for r in hits)
    assert {r["content_type"] for r in hits if r["query_id"] == "b"} == {"text"}


def test_mixed_dimensions_are_rejected(spark):
    c = spark.createDataFrame([("a", "s", "text", [1.0, 0.0]), ("b", "s", "text", [1.0])], CHUNKS)
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vector array<double>")
    with pytest.raises(Exception, match="mixed dimension"):
        retrieval.knn_exact(q, c.coalesce(1)).collect()


def test_first_query_keeps_its_score(spark):
    hits = spark.createDataFrame(
        [("t", 0, "x", 0.5, 1), ("t", 0, "y", 0.4, 2), ("t", 1, "x", 0.9, 1), ("t", 1, "z", 0.8, 2)],
        "task_id string, query_no int, chunk_id string, score double, rank int")
    got = [(r["chunk_id"], r["score"], r["position"])
           for r in retrieval.multi_query_dedup(hits).orderBy("position").collect()]
    assert got == [("x", 0.5, 1), ("y", 0.4, 2), ("z", 0.8, 3)]


def test_chunk_columns_are_pruned(spark, tmp_path):
    _, _, c, q = frames(spark)
    c.withColumn("content", F.lit("long text")).write.parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    plan = retrieval.typed_search(q, stored, "table")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(content_type,table)" in plan
    scans = [line for line in plan.splitlines() if "ReadSchema" in line]
    assert scans and all("content:string" not in line for line in scans)


def test_trend_terms_count_in_as_many_tasks_as_hits_need(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "TERM_HITS", 3)
    hits = [(f"t{i % 4}", f"f{i % 3}", f"alpha word{i % 2} alpha abc") for i in range(24)]
    rows = spark.createDataFrame(
        [*hits, ("t0", "f9", None)], "task_id string, source_file string, content string")
    found = retrieval.trend_terms(rows, top=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # hits, no terms
    assert "hashpartitioning(task_id#" in plan and ", 9)" in plan
    assert {tuple(r) for r in found.collect()} == {
        (f"t{t}", "alpha", 3, 6, 1) for t in range(4)}


def asked_table(vectors, sources, kinds, k=5):
    return pa.table({
        "query_id": [f"q{i:04d}" for i in range(len(vectors))],
        "vector": pa.array(vectors.tolist(), pa.list_(pa.float64())),
        "filter_source": pa.array(sources, pa.string()), "filter_type": pa.array(kinds, pa.string())})


def count_products(monkeypatch):
    made = []
    plain = retrieval._Questions._offer_part
    monkeypatch.setattr(retrieval._Questions, "_offer_part", lambda self, batch, rows, asked: (
        made.append(len(rows) * len(asked)), plain(self, batch, rows, asked))[1])
    return made


def test_the_same_question_is_scored_once_and_sources_apart(monkeypatch):
    rng = np.random.default_rng(6)
    made = count_products(monkeypatch)
    n = 400
    chunks = pa.table({
        "chunk_id": [f"c{i}" for i in range(n)], "source_file": [f"s{i % 20}" for i in range(n)],
        "content_type": ["text"] * n,
        "embedding": pa.array(rng.normal(size=(n, 6)).tolist(), pa.list_(pa.float32()))})
    vector = rng.normal(size=6)
    # thirty times one question of all chunks, twenty times it again of a source each
    asked = asked_table(np.tile(vector, (50, 1)), [None] * 30 + [f"s{i}" for i in range(20)], [None] * 50)
    questions = retrieval._Questions(asked, 5)
    questions.offer(chunks)
    assert sum(made) == n + n  # 50 x 400 it was
    hits = questions.hits().to_pylist()
    assert len(hits) == 50 * 5
    by_id = {f"q{i:04d}": {h["chunk_id"] for h in hits if h["query_id"] == f"q{i:04d}"} for i in range(50)}
    assert all(by_id[f"q{i:04d}"] == by_id["q0000"] for i in range(30))
    assert all(int(c[1:]) % 20 == i for i in range(20) for c in by_id[f"q{30 + i:04d}"])


@pytest.mark.parametrize("cells, batch, first", [(1_000_000, 4_000_000, 32), (300, 500, 1), (90, 64, 2)])
def test_crowds_of_equal_scores(monkeypatch, cells, batch, first):
    for name, value in (("SCORE_CELLS", cells), ("BATCH_VALUES", batch), ("FIRST_ROWS", first),
                        ("WAITING_HITS", 20)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(7)
    few = np.eye(4)[:, [0, 1, 2, 3, 0]]
    vectors = few[rng.integers(0, 4, 600)]  # scores of 0.5 and 1 alone
    vectors[5] = 0
    chunks = [(f"c{i}", f"s{i % 3}", ["text", "table"][i % 2], None if i == 9 else v.tolist())
              for i, v in enumerate(vectors)]
    asked = rng.normal(size=(12, 5)).round() + few[0]
    asked[3] = 0
    sources, kinds = [None, "s1", "", "gone"] * 3, [None, None, "table"] * 4
    questions = retrieval._Questions(asked_table(asked, sources, kinds), 7)
    order = rng.permutation(600)
    for at in range(0, 600, 150):
        some = [chunks[i] for i in order[at : at + 150]]
        questions.offer(pa.table({
            name: pa.array([c[j] for c in some], kind) for j, (name, kind) in enumerate([
                ("chunk_id", pa.string()), ("source_file", pa.string()), ("content_type", pa.string()),
                ("embedding", pa.list_(pa.float32()))])}))
    with np.errstate(invalid="ignore"):
        want = {row[:3] for row in brute(chunks, [
            (f"q{i:04d}", v, sources[i], kinds[i], 7, None) for i, v in enumerate(asked) if v.any()])}
    assert {(h["query_id"], h["chunk_id"], round(h["score"], 6)) for h in questions.hits().to_pylist()} == want
