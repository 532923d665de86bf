import collections
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import mixing
from tests.llm.helpers import doc, table, words


def plain_targets(sizes):
    """Reshare the excess until no target is above three times its source."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.discard(s)
        left = sum(sizes.values()) - sum(target.values())
    return target


def plain_seats(votes, seats):
    won = collections.Counter()
    for _ in range(seats):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * won[p] + 1))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_equals_one_seat_at_a_time(spark, seed):
    rng = random.Random(seed)
    votes = {i: rng.choice([0.0, 1.0, 5.0, rng.random() * 1000]) for i in range(12)}
    votes[3] = 4000.0
    groups = spark.createDataFrame([(0, i, v) for i, v in votes.items()], "g int, p int, v double")
    for seats in (0, 1, 7, 100, 613):
        got = mixing.apportion(groups, F.col("v"), F.lit(seats).cast("long"), ["g"], "p")
        won = plain_seats({p: v for p, v in votes.items() if v}, seats)
        assert {r.p: r.quota for r in got.collect() if r.quota} == dict(won)


def test_targets_and_taken(spark):
    rng = random.Random(1)
    rows, i = [], 0
    for source, n in {"a": 150, "b": 2, "é": 60, "Z": 1, None: 40, "hot": 400}.items():
        for _ in range(n):
            rows.append(doc(i, "w " * rng.randrange(0, 200), source=source))
            i += 1
    rows += [doc(5, "w " * 30, source="a"), doc(None, "u v", source="a"),
             doc(9001, None, source="empty"), doc(9002, "x " * 30_000, source="long")]
    docs = table(spark, rows).selectExpr("*", "0 AS size", "0 AS shard", "0 AS place")
    got = mixing.mix_sources(docs, shard_rows=50).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    targets = plain_targets(dict(sizes))
    taken = collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] += r.taken
    for source, target in targets.items():
        assert abs(taken[source] - target) <= 0.5 + 1e-6 * target
    again = mixing.mix_sources(docs.repartition(5), shard_rows=50).collect()
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert collections.Counter(map(key, got)) == collections.Counter(map(key, again))


@pytest.mark.parametrize("large", [0, 300, 40_000, 400_000])
def test_small_sources_reach_their_targets_beside_large_ones(spark, large):
    rows = [doc(i, "w " * 10, source="b90") for i in range(9)]
    rows += [doc(100 + i, "w " * 30, source="c510") for i in range(17)]
    rows += [doc(200 + i, "w " * (large // 40), source="a") for i in range(40) if large]
    rows += [doc(300, "one", source=None)]
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    taken = collections.Counter()
    for r in mixing.mix_sources(table(spark, rows), shard_rows=5).collect():
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source, target in plain_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 0.5 + 1e-6 * target
    if large == 400_000:
        assert (taken["b90"], taken["c510"]) == (270, 1530)


def test_empty(spark):
    docs = table(spark, [doc(1, None), doc(2, " ")])
    assert [r.taken for r in mixing.mix_sources(docs).collect()] == [0, 0]
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_applied_mix_repeats_and_cuts(spark, tmp_path):
    rows = [doc(i, f"  A{i} b\tc\nd é", source="s" if i % 10 else "t") for i in range(100)]
    table(spark, rows).withColumn("_row", F.lit(1)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    plan = {r.doc_id: r.taken for r in mixing.mix_sources(docs).collect()}
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    got, original = collections.Counter(), {r[0]: r[1] for r in rows}
    for r in out.collect():
        assert original[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
        got[r.doc_id] += len(words(r.text))
    assert got == collections.Counter({k: v for k, v in plan.items() if v})
