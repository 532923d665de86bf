import math

import numpy as np
import pytest

from corpusloom.llm import ann, maxscore

SF = "/root/testdata/sf0.01/embeddings.parquet"
SCHEMA = "vec_id long, embedding array<float>, score long"


def rows_of(n, dim=6, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, rng.integers(-8, 9, dim).astype(float).tolist(), 1) for i in range(n)]


def odd(spark, n=130):
    rows = rows_of(n)
    rows[3] = (3, rows[2][1], 1)  # a tie
    rows += [(None, [1.0] * 6, 1), (500, None, 1), (600, [], 1), (700, [math.nan] + [1.0] * 5, 1),
             (800, [math.inf] * 6, 1), (900, [None] + [1.0] * 5, 1), (1001, [1.0, 2.0], 1),
             (100, rows[100 % n][1], 1), (1000, [0.0] * 6, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(df, k, every, score, zero):
    rows = []
    for r in df.collect():
        v = r.embedding
        if r.vec_id is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        if zero or any(v):
            rows.append((r.vec_id, [*v, *[0.0] * (6 - len(v))]))
    out = {}
    for q, v in rows:
        if q % every == 0:
            found = sorted((-score(v, w), c) for c, w in rows if c != q)[:k]
            out[q] = [(c, -s) for s, c in found]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("k, scale", [(10, 1024), (3, 1), (500, 7)])
def test_exact_top_k_equals_brute_force(spark, k, scale):
    df = odd(spark)
    quantised = lambda v, w: sum(
        math.floor(scale * a) * math.floor(scale * b) for a, b in zip(v, w, strict=True))
    got = listed(maxscore.top_k(df.repartition(3), k=k, every=50, scale=scale))
    assert got == brute(df, k, 50, quantised, True)


def test_exact_top_k_prunes_and_stays_exact():
    rng = np.random.default_rng(1)
    rows = np.floor(1024 * rng.standard_normal((5000, 24)) * np.geomspace(1, 0.01, 24))
    ids, asked = np.arange(5000), np.arange(0, 5000, 100)
    best = maxscore.Best(len(asked), 10)
    for at in range(0, 5000, 512):
        maxscore.traverse(best, ids[at : at + 512], rows[at : at + 512], asked, rows[asked])
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    for i in range(len(asked)):
        order = np.lexsort((ids, -scores[i]))[:10]
        assert best.ids[best.query == i].tolist() == order.tolist()
        assert best.score[best.query == i].tolist() == scores[i][order].tolist()


def test_several_query_blocks(spark, monkeypatch):
    df = odd(spark)
    whole = listed(maxscore.top_k(df, k=4, every=5))
    monkeypatch.setattr(maxscore, "QUERY_BLOCK", 6)
    assert listed(maxscore.top_k(df, k=4, every=5)) == whole


def test_empty(spark):
    df = odd(spark).limit(0)
    assert maxscore.top_k(df).count() == 0 and ann.neighbours(df).count() == 0
    none = spark.createDataFrame([(3, [1.0, 2.0], 1)], SCHEMA)
    assert maxscore.top_k(none).count() == 0 and ann.neighbours(none).count() == 0


def test_neighbours_of_a_small_table_are_all_found(spark):
    df = odd(spark, 60)
    inner = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True))
    got = listed(ann.neighbours(df, k=100, every=20))
    assert got == brute(df, 100, 20, inner, False)


def test_recall_and_scores(spark):
    df = spark.read.parquet(SF)
    table = df.toPandas()
    matrix = np.array(table.embedding.tolist(), dtype=np.float64)
    place = dict(zip(table.vec_id, range(len(table)), strict=True))
    hit = total = 0
    got = listed(ann.neighbours(df))
    assert sorted(got) == sorted(v for v in table.vec_id if v % 20 == 0)
    for q, found in got.items():
        scores = matrix @ matrix[place[q]]
        scores[place[q]] = -np.inf
        best = set(table.vec_id[np.argsort(-scores)[:20]])
        assert len(found) == 20
        hit += len(best & {c for c, _ in found})
        total += 20
        for c, s in found:
            assert s == pytest.approx(scores[place[c]], abs=1e-12)
    assert hit / total >= 0.9


def test_scan_abandons_only_by_the_test():
    """With a generous test, scanning every list gives the exact neighbours."""
    rng = np.random.default_rng(2)
    rows = rng.standard_normal((900, 30)) * rng.uniform(0.5, 2, (900, 1))
    space = ann.Space(30, np.linalg.norm(rows, axis=1).max(), rows, 9)
    points, lists = space.rows(rows), space.lists(space.rows(rows))
    asked = np.arange(0, 900, 30)
    best = ann.Best(len(asked), 5)
    for number in range(9):
        at = np.flatnonzero(lists == number)
        ann.scan_list(best, space, at, rows[at], points[at], asked, rows[asked],
                      space.queries(rows[asked]), np.arange(len(asked)), 12.0)
    scores = rows[asked] @ rows.T
    scores[np.arange(len(asked)), asked] = -np.inf
    for i in range(len(asked)):
        assert set(best.ids[best.query == i]) == set(np.argsort(-scores[i])[:5])
