"""Keyword search, fusion, diversity, the question cache and citation checks."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cache, keyword, rerank, verification

CHUNKS = "chunk_id string, source_file string, chunk_index long, content string"
ASKED = "query_id string, question string"
HITS = "query_id string, chunk_id string, score double, rank int"


def bag(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute_bm25(chunks, questions, k):
    bags = {c[0]: bag(c[3]) for c in chunks if bag(c[3])}
    mean = sum(map(len, bags.values())) / max(len(bags), 1)
    out = []
    for q, text in questions:
        found = []
        for c, words in bags.items():
            points = 0
            for t in set(bag(text)):
                tf = words.count(t)
                if tf:
                    df = sum(t in b for b in bags.values())
                    idf = math.log(1 + (len(bags) - df + 0.5) / (df + 0.5))
                    part = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (len(words) / mean)))
                    points += bag(text).count(t) * math.floor(1_000_000 * (idf * part))
            if points:
                found.append((-points, c))
        out += [(q, c, -p / 1_000_000, n + 1) for n, (p, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the"] * 40 + [f"t{int(rng.paretovariate(0.8)) % 90}" for _ in range(400)]
    chunks = []
    for f in range(25):
        topic = [f"t{f}", f"topic{f}"]
        for i in range(rng.choice([1, 2, 30])):
            text = " ".join(rng.choices(words + topic * 20, k=rng.randrange(3, 25)))
            chunks.append((f"c{f}_{i}", f"f{f}", i, text))
    chunks += [("blank", "f0", 90, " .-"), ("none", "f0", 91, None), ("case", "f1", 92, "ResNet-50 The"),
               ("tie_a", "f2", 93, "twin"), ("tie_b", "f3", 94, "twin"), ("no_file", None, None, "twin the")]
    questions = [(f"q{i}", " ".join(rng.choices(words, k=4))) for i in range(12)]
    questions += [("name", "resnet 50"), ("twins", "TWIN"), ("repeat", "the the topic3"),
                  ("unknown", "zzz"), ("empty", ""), ("null", None), ("common", "the")]
    return chunks, questions


@pytest.mark.parametrize("seed, block, first", [(0, 128, 4), (1, 4, 1), (2, 3, 2)])
def test_bm25_equals_scoring_every_chunk(spark, monkeypatch, seed, block, first):
    monkeypatch.setattr(keyword, "BLOCK", block)
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", first)
    chunks, questions = corpus(seed)
    index = keyword.build_index(spark.createDataFrame(chunks, CHUNKS))
    got = keyword.bm25_search(index, spark.createDataFrame(questions, ASKED), 5)
    assert sorted(map(tuple, got.collect())) == brute_bm25(chunks, questions, 5)


def test_blocks_that_cannot_matter_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK", 4)
    monkeypatch.setattr(keyword, "FIRST_BLOCKS", 1)
    chunks = [(f"c{i}", f"f{i // 4}", i, "rare the" if i == 77 else "the and so on") for i in range(160)]
    index = keyword.build_index(spark.createDataFrame(chunks, CHUNKS))
    scored = []
    plain = keyword._score
    monkeypatch.setattr(keyword, "_score", lambda pairs, *rest: (
        scored.append(pairs.count()), plain(pairs, *rest))[1])
    question = spark.createDataFrame([("q", "rare the")], ASKED)
    got = keyword.bm25_search(index, question, 1).collect()
    assert [r["chunk_id"] for r in got] == ["c77"]
    n_blocks = index.postings.select("block").distinct().count()
    assert sum(scored) <= 2 < n_blocks


def test_a_common_term_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(keyword, "BLOCK", 8)
    chunks = [(f"c{i}", "one file", i, "the") for i in range(100)]
    index = keyword.build_index(spark.createDataFrame(chunks, CHUNKS))
    rows = index.postings.collect()
    assert len(rows) == 13 and max(len(r["postings"]) for r in rows) == 8
    assert index.terms.collect()[0]["n_chunks"] == 100
    empty = keyword.build_index(spark.createDataFrame([], CHUNKS))
    assert keyword.bm25_search(empty, spark.createDataFrame([("q", "the")], ASKED)).count() == 0


def test_bounded_tasks_find_the_same(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("TASK_TERMS", 300), ("ASKED_ROWS", 9), ("SCORE_CELLS", 40),
                        ("KEPT_ROWS", 5)):
        monkeypatch.setattr(keyword, name, value)
    chunks, questions = corpus(3)
    index = keyword.build_index(spark.createDataFrame(chunks, CHUNKS))
    files = index.postings.select("block", F.input_file_name().alias("file")).distinct()
    assert files.select("file").distinct().count() > 4
    assert files.count() == files.select("block").distinct().count()  # no block is in two files
    got = keyword.bm25_search(index, spark.createDataFrame(questions, ASKED), 5)
    assert sorted(map(tuple, got.collect())) == brute_bm25(chunks, questions, 5)


def test_fusion_keeps_one_sided_hits(spark):
    near = spark.createDataFrame(
        [("q", "a", 0.9, 1), ("q", "b", 0.8, 2), ("r", "x", 0.5, 1)], HITS)
    found = spark.createDataFrame([("q", "b", 7.0, 1), ("q", "c", 3.0, 2), ("s", "y", 1.0, 1)], HITS)
    ranks = {(r["query_id"], r["chunk_id"]): r for r in rerank.fuse_ranks(near, found).collect()}
    assert set(ranks) == {("q", "a"), ("q", "b"), ("q", "c"), ("r", "x"), ("s", "y")}
    assert ranks["q", "b"]["score"] == pytest.approx(0.7 / 62 + 0.3 / 61, abs=1e-9)
    assert ranks["q", "a"]["score"] == pytest.approx(0.7 / 61, abs=1e-9)
    assert ranks["q", "c"]["vector_rank"] is None and ranks["q", "c"]["keyword_rank"] == 2
    assert [ranks["q", c]["rank"] for c in "bac"] == [1, 2, 3]
    scores = {(r["query_id"], r["chunk_id"]): r["score"]
              for r in rerank.fuse_scores(near, found).collect()}
    assert scores == {("q", "a"): 0.7, ("q", "b"): 0.3, ("q", "c"): 0.0, ("r", "x"): 0.7,
                      ("s", "y"): 0.3}
    assert rerank.fuse_ranks(near, found, k=1).count() == 3


def test_mmr_avoids_near_copies(spark):
    hits = spark.createDataFrame(
        [("q", "a", 0.9, 1), ("q", "b", 0.89, 2), ("q", "c", 0.7, 3), ("q", "d", 0.6, 4),
         ("r", "a", 0.5, 1)], HITS)
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [-1.0, 0.2]), ("d", None)],
        "chunk_id string, embedding array<double>")
    rows = sorted(rerank.mmr(hits, vectors, 3).collect(), key=lambda r: (r["query_id"], r["position"]))
    # after a: b is worth 0.7 * 0.89 - 0.3 * 1, c 0.7 * 0.7 - 0.3 * 0.01, d 0.42
    assert [(r["query_id"], r["chunk_id"]) for r in rows] == [
        ("q", "a"), ("q", "c"), ("q", "d"), ("r", "a")]
    assert [r["rank"] for r in rows] == [1, 3, 4, 1]


def test_cache_is_exact_and_grows(spark, tmp_path):
    rng = np.random.default_rng(1)
    past = rng.standard_normal((300, 8))
    new = past[:150] + rng.uniform(0, 0.6, (150, 1)) * rng.standard_normal((150, 8))
    schema = "query_id string, vector array<double>"
    rows = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(past)] + [("null", None)]
    asked = [(f"n{i:03d}", v.tolist()) for i, v in enumerate(new)]
    asked += [("zero", [0.0] * 8), ("null", None), ("far", (-past.sum(axis=0)).tolist())]
    store = cache.build_cache(spark.createDataFrame(rows, schema), str(tmp_path / "cache"))
    questions = spark.createDataFrame(asked, schema)

    def want(known):
        unit = known / np.linalg.norm(known, axis=1, keepdims=True)
        out = {}
        for q, v in asked:
            score = np.zeros(len(unit)) if not v or not any(v) else unit @ v / np.linalg.norm(v)
            best = int(np.round((1 + score) / 2, 6).argmax())
            out[q] = f"p{best:03d}" if score[best] >= 0.95 else None
        return out

    got = {r["query_id"]: (r["cached_id"], r["hit"]) for r in cache.cache_lookup(store, questions).collect()}
    first = want(past)
    assert got == {q: (p, p is not None) for q, p in first.items()}
    assert 10 < sum(p is not None for p in first.values()) < 140
    more = spark.createDataFrame([("p300", (-past.sum(axis=0)).tolist())], schema)
    store = cache.add_to_cache(store, more)
    again = {r["query_id"]: r["cached_id"] for r in cache.cache_lookup(store, questions).collect()}
    assert again == want(np.vstack([past, -past.sum(axis=0)])) and again["far"] == "p300"


def test_cache_skips_cells(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = np.eye(10)
    past = np.repeat(centres, 30, axis=0) + 0.01 * rng.standard_normal((300, 10))
    schema = "query_id string, vector array<double>"
    store = cache.build_cache(spark.createDataFrame(
        [(f"p{i}", v.tolist()) for i, v in enumerate(past)], schema), str(tmp_path / "cells"))
    marks = cache.cells_within(store, centres, 0.95)
    assert marks.any(axis=1).all() and marks.sum(axis=1).max() < marks.shape[1] / 2


def test_citations(spark):
    answers = spark.createDataFrame([
        ("a", "One [Source: f, Page 1, Section S1] two [Source: f, Page 2, Section S1]."),
        ("b", "[Source: f, Page 3, Section S1][Source: f, Page 3][Source: g, Page 1]"
              "[Source: f, Page 99, Section S1] [Source: broken]"),
        ("c", "nothing cited"), ("d", None)], "answer_id string, text string")
    chunks = spark.createDataFrame([
        ("c1", "f", 1, 0, "S1"), ("c2", "f", 2, 1, "S2"), ("c3", "f", 2, 2, "S2"), ("c4", "f", 60, 3, None)],
        "chunk_id string, source_file string, page_number int, chunk_index long, section_heading string")
    spans = verification.section_spans(chunks)
    assert {(r["section_heading"], r["first_page"], r["last_page"]) for r in spans.collect()} == {
        ("S1", 1, 2), ("S2", 2, 60), ("", 60, 60)}
    files = spark.createDataFrame([("f", 60), ("h", None)], "source_file string, total_pages int")
    cites = verification.parse_citations(answers)
    got = {(r["answer_id"], r["citation_no"]): (r["verdict"], r["in_force"])
           for r in verification.check_citations(cites, files, spans).collect()}
    assert got == {
        ("a", 1): ("valid", "S1"), ("a", 2): ("valid", "S1"),  # S1 ends on page 2
        ("b", 1): ("section not on page", "S2"), ("b", 2): ("valid", "S2"),
        ("b", 3): ("unknown file", None), ("b", 4): ("no such page", None)}


def test_questions_of_the_same_terms_are_searched_once(spark, monkeypatch):
    chunks, _ = corpus(4)
    index = keyword.build_index(spark.createDataFrame(chunks, CHUNKS))
    questions = [("b", "topic3 the"), ("a", "The topic3!"), ("c", "the, topic3"), ("d", "the the topic3"),
                 ("e", "topic4"), ("none", None)]
    asked = []
    plain = keyword._score
    monkeypatch.setattr(keyword, "_score", lambda pairs, *rest: (
        asked.extend(r["query_id"] for r in pairs.select("query_id").distinct().collect()),
        plain(pairs, *rest))[1])
    rows = spark.createDataFrame([*questions, (None, "topic3 the")], ASKED)
    got = keyword.bm25_search(index, rows, 5)
    assert sorted(map(tuple, got.collect())) == brute_bm25(chunks, questions, 5)
    assert {"a", "d"} <= set(asked) and not {"b", "c"} & set(asked)
    twice = spark.createDataFrame([("x", "the"), ("x", "topic3 the"), ("d", "the the topic3")], ASKED)
    hits = {q: [r["chunk_id"] for r in keyword.bm25_search(index, twice, 5).collect()
                if r["query_id"] == q] for q in "xd"}
    assert len(hits["x"]) == 5 and sorted(hits["x"]) == sorted(hits["d"])  # rows of an id are one question
