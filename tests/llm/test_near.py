import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import linking, near
from corpusloom.llm.textops import shingle_hashes
from tests.llm.helpers import doc, groups, mutate, prose, shingles, table


def check(spark, rows, k):
    docs = table(spark, rows)
    got = {r.doc_id: r for r in near.near_duplicates(docs, words=k).collect()}
    sets = {r[0]: shingles(r[1], k) for r in rows}
    want = groups(sets)
    assert {d: r.component_id for d, r in got.items()} == want
    assert all(r.n_shingles == len(sets[d]) and r.kept == (want[d] == d) for d, r in got.items())
    return want


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(spark, k):
    rng = random.Random(k)
    rows, i = [], 0
    for _ in range(25):
        base = prose(rng, rng.randrange(60, 300))
        for _ in range(rng.randrange(1, 6)):
            rows.append(doc(i, " ".join(mutate(rng, base, rng.randrange(8)))))
            i += 1
    hub = prose(rng, 400)  # many near copies of one text, and chains of copies of copies
    for _ in range(60):
        rows.append(doc(i, " ".join(mutate(rng, hub, rng.randrange(30)))))
        i += 1
    for _ in range(30):
        rows.append(doc(i, " ".join(hub).upper()))
        i += 1
    chain = prose(rng, 120)
    for _ in range(12):
        chain = mutate(rng, chain, 3)
        rows.append(doc(i, " ".join(chain)))
        i += 1
    rows += [doc(i, "one"), doc(i + 1, " ONE\t"), doc(i + 2, "two"), doc(i + 3, "a b"),
             doc(i + 4, "a b c"), doc(i + 5, ""), doc(i + 6, None), doc(i + 7, " \n")]
    rng.shuffle(rows)
    want = check(spark, rows, k)
    assert sum(v != d for d, v in want.items()) > 60


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [doc(4, "a b c d"), doc(4, "a b c d"), doc(4, "p q r s"), doc(None, "a b c d"),
            doc(None, "only without id"), doc(9, "p q r s"), doc(7, long), doc(8, long + " end"),
            doc(None, None), doc(2, None)]
    docs = table(spark, rows).selectExpr("*", "1 AS node", "1 AS component", "true AS kept")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in
                  near.near_duplicates(docs, words=2).collect()), key=str)
    assert got == sorted([(4, 4, True)] * 3 + [(None, 4, False), (None, None, True), (9, 4, False),
                         (7, 7, True), (8, 7, False), (None, None, True), (2, 2, True)], key=str)
    assert near.near_duplicates(docs.limit(0)).count() == 0


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 5000):
        values = rng.integers(0, 1 << 52, n).astype(np.uint64)
        sketch = linking.fast_sketch(values, np.array([0, n]), 192)
        assert (sketch != linking.FULL).all()
        assert (linking.fast_sketch(values[::-1].copy(), np.array([0, n]), 192) == sketch).all()
    errors = []
    for seed in range(60):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(30, 2000))
        pool = rng.integers(0, 1 << 52, 2 * n).astype(np.uint64)
        a, b = pool[:n], np.concatenate([pool[: n * 8 // 10], pool[n : n + n // 10]])
        both = linking.fast_sketch(np.concatenate([a, b]), np.array([0, n, n + len(b)]), 192)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append((both[0] == both[1]).mean() - true)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.15
    assert (linking.fast_sketch(np.empty(0, np.uint64), np.array([0, 0]), 8) == linking.FULL).all()


@pytest.mark.parametrize("small", [False, True])
def test_no_link_of_a_bucket_is_lost(spark, monkeypatch, small):
    """A hub that is linked with nobody, and members that are linked in a chain only."""
    if small:  # several chunks and parts
        monkeypatch.setattr(linking, "CHUNK_SETS", 7)
        monkeypatch.setattr(linking, "PART_SETS", 11)
    n, far = 60, 10**6
    tokens = [f"t{i}" for i in range(300)]
    texts = [(0, "quite another text")]
    texts += [(i, " ".join(tokens[3 * i : 3 * i + 60])) for i in range(1, n)]
    texts += [(far, "far away"), (far + 1, "far away")]
    members = spark.createDataFrame(
        [(1, 0, i) for i in range(1, n)] + [(2, far, far + 1)], "band long, hub long, node long")
    texts = spark.createDataFrame(texts, "node long, text string")

    def to_sets(scanner, data, offsets):
        return shingle_hashes(*scanner.words(data, offsets), 1)

    got = {r.node: r.component for r in linking.link(members, texts, to_sets, 80).collect()}
    assert got == {i: 1 for i in range(1, n)} | {far: far, far + 1: far}


def test_common_counts(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(25)]
    a, b = sets[:9], sets[9:]
    edges = lambda s: np.cumsum([0, *map(len, s)])
    for limit in (1, 100, 1 << 22):
        monkeypatch.setattr(linking, "MATCHES", limit)
        out = np.full((9, 16), -1)
        for low, high, part in linking.common_counts(
                np.concatenate(a), edges(a), np.concatenate(b), edges(b)):
            out[:, low:high] = part
        assert (out == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)]
    edges += [(i, i + 1) for i in range(300, 380)] + [(400, j) for j in range(401, 460)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = linking.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent}
    assert len(got) == len(parent)


def test_hot_bucket_is_combined_before_the_shuffle():
    nodes = np.arange(5000).astype(np.uint64)
    keys = np.stack([np.full(5000, 7, np.uint64), nodes + np.uint64(100)], axis=1)
    batch = linking.bucket_batch(nodes, keys).to_pandas()
    hot = batch[batch.band == 7]
    assert (hot.deal == 7).sum() == 1 and hot.hub.notna().sum() == 4999
    assert hot.deal.nunique() == 5000


def test_filter_has_no_misses(spark):
    df = spark.range(-500, 500).select(F.xxhash64("id").alias("node"))
    values = np.array([r.node for r in df.collect()])
    bits = linking.wanted_filter(df)
    assert linking.passes(bits, values).all()
    assert linking.passes(bits, np.arange(1, 20_000, dtype=np.int64) * 7919).mean() < 0.01


@pytest.mark.parametrize("limit", [None, 5])
def test_thinned_buckets_keep_all_near_pairs(spark, monkeypatch, limit):
    """Of nodes that share a band those far from all others go before anything is stored."""
    if limit:
        monkeypatch.setattr(linking, "THINNED", limit)
    rng = np.random.default_rng(4)
    nodes = np.arange(1, 301, dtype=np.uint64)
    bits = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    bits[50:60] = bits[:10] ^ np.uint64(0b111)  # near pairs
    bits[299] = bits[298]
    keys = np.stack([nodes // np.uint64(4), nodes // np.uint64(100) + np.uint64(1000)], axis=1)
    batches = [linking.sketch_batch(nodes[i::3], keys[i::3], bits[i::3]) for i in range(3)]
    batches.append(batches[0])  # the same lines again
    rows = spark.createDataFrame(pa.Table.from_batches(batches)).select(
        *(c.split()[0] for c in linking.SKETCH_SCHEMA.split(", ")))
    got = {}
    for r in linking.near_memberships(rows).collect():
        assert r.hub != r.node
        got.setdefault(r.band, set()).update((r.hub, r.node))
    near = 0
    for band in np.unique(keys):
        own = np.flatnonzero((keys == band).any(axis=1))
        for i in own:
            for j in own[own > i]:
                if int(bits[i] ^ bits[j]).bit_count() <= linking.NEAR_BITS:
                    near += 1
                    assert {nodes[i], nodes[j]} <= got[band]
    assert near >= 11
    if not limit:  # most buckets of four have no near pair and leave no row
        assert sum(band < 1000 for band in got) < 20


def test_similar_sets_have_near_bits():
    rng = np.random.default_rng(9)
    sets = []
    for _ in range(500):
        base = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        sets += [base[:80], np.concatenate([base[:71], base[81:]])]  # 71 of 89 in common
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = linking.sketch_bits(linking.fast_sketch(np.concatenate(sets), bounds, 60))
    assert not linking._far(bits[::2], bits[1::2]).any()
    assert linking._far(bits[:-1:2], np.roll(bits, -2)[:-1:2]).mean() > 0.9
