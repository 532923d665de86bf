import math

import numpy as np
import pytest

from corpusloom.llm import hardneg, queries
from tests.llm.helpers import table

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank string"


def brute(rows, every, positives, negatives, low, high, scale):
    """The definition, by sorting all rows for every anchor."""
    good = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or not v:
            continue
        if any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((r["vec_id"], r["label"], [math.floor(scale * x) for x in v]))
    anchors = {}
    for i, label, v in sorted(good, key=lambda x: (x[0], x[1], x[2])):
        if i % every == 0:
            anchors.setdefault(i, (label, v))
    out = []
    for a, (label, v) in anchors.items():
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), i, other)
                  for i, other, w in good if i != a]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p_score, p, _ in [x for x in scored if x[2] == label][:positives]:
            window = [x for x in scored
                      if x[2] != label and low * p_score <= 100 * x[0] <= high * p_score]
            out += [(a, p, n + 1, i, p_score, s) for n, (s, i, _) in enumerate(window[:negatives])]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in hardneg.SCHEMA.replace(" long", "").replace(
        " int", "").split(", ")) for r in df.collect())


def odd_rows(seed=0, n=260, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    rows = [(i, (centres[rng.integers(6)] + 0.5 * rng.standard_normal(dim)).round(2).tolist(),
             int(rng.integers(4)), 7, "x") for i in range(n)]
    rows[9] = (9, rows[8][1], rows[8][2], 7, "x")  # ties
    rows += [rows[10], (rows[20][0], rows[30][1], 3, 7, "x"),  # repeated rows and ids
             (None, [1.0] * dim, 1, 7, "x"), (300, None, 1, 7, "x"), (310, [], 1, 7, "x"),
             (320, [1.0] * dim, None, 7, "x"), (330, [math.nan] + [1.0] * (dim - 1), 1, 7, "x"),
             (340, [math.inf] * dim, 1, 7, "x"), (350, [None] + [1.0] * (dim - 1), 2, 7, "x"),
             (360, [0.0] * dim, 2, 7, "x"), (370, [1.0, 2.0], 0, 7, "x"),
             (380, [1.0] * dim, 99, 7, "x")]  # the only row of its label
    return rows


@pytest.mark.parametrize("seed, every, positives, negatives, low, high, scale", [
    (0, 10, 5, 3, 50, 95, 256), (1, 5, 2, 1, 0, 100, 16), (2, 20, 50, 40, 30, 80, 64),
    (3, 10, 400, 2, -100, 60, 8)])
def test_equals_brute_force(spark, seed, every, positives, negatives, low, high, scale):
    df = table(spark, odd_rows(seed), SCHEMA).repartition(3)
    made = hardneg.hard_negatives(df, every, positives, negatives, low, high, scale)
    assert got(made) == brute(df.collect(), every, positives, negatives, low, high, scale)


def test_small_blocks_give_the_same(spark, monkeypatch):
    df = table(spark, odd_rows(4), SCHEMA).repartition(2)
    whole = got(hardneg.hard_negatives(df, every=5))
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 1000)
    assert got(hardneg.hard_negatives(df, every=5)) == whole != []


def test_reach_is_exact_and_leaves_postings_out():
    rng = np.random.default_rng(5)
    rows = np.floor(256 * rng.standard_normal((900, 30)) * np.geomspace(1, 0.02, 30))
    anchors = rows[:40]
    scores = anchors @ rows.T
    for share in (0.0, 0.2, 0.9, 5.0, -2.0):
        least = np.ceil(share * np.sort(scores, axis=1)[:, -20])
        anchor, row, score = hardneg.Postings(rows).reach(anchors, least)
        want = set(zip(*np.nonzero(scores >= least[:, None]), strict=True))
        assert set(zip(anchor, row, strict=True)) == want and len(anchor) == len(want)
        assert (score == scores[anchor, row]).all()


def test_thresholds_are_lowered_until_windows_are_full():
    rng = np.random.default_rng(6)
    rows = np.floor(100 * rng.standard_normal((2000, 8)))
    ids, labels = np.arange(2000), np.arange(2000) % 3
    asked = np.arange(0, 2000, 250)
    norm = (rows[asked] ** 2).sum(axis=1)
    windows = hardneg.Windows(ids[asked], labels[asked], rows[asked], 0.2 * norm, 0.9 * norm,
                              1, 3, False)
    for at in range(0, 2000, 300):
        windows.offer(hardneg.Postings(rows[at : at + 300]), ids[at : at + 300],
                      labels[at : at + 300])
    scores = rows[asked] @ rows.T
    for i, a in enumerate(asked):
        fits = (labels != labels[a]) & (scores[i] >= 0.2 * norm[i]) & (scores[i] <= 0.9 * norm[i])
        order = np.lexsort((ids, -scores[i]))
        assert windows.best.ids[windows.best.query == i].tolist() == [
            j for j in order if fits[j]][:3]


def test_empty_and_alone(spark):
    empty = table(spark, [], SCHEMA)
    assert hardneg.hard_negatives(empty).count() == 0
    alone = table(spark, [(50, [1.0, 2.0], 1, 0, "")], SCHEMA)
    made = hardneg.hard_negatives(alone)
    assert made.count() == 0 and made.columns == hardneg.hard_negatives(empty).columns


def test_query_relabels_every_seventh_row(spark):
    made = queries.all_queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    rows = [r.asDict() for r in spark.read.parquet(
        "/root/testdata/sf0.001/embeddings.parquet").collect()]
    for r in rows:
        if r["vec_id"] % 7 == 0 and r["label"] is not None:
            r["label"] = (r["label"] + 1) % 10
    assert got(made) == brute(rows, 50, 5, 3, 50, 95, 256)
