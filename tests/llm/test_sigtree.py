import random

import numpy as np
import pytest

from corpusloom.llm import queries, sigtree
from tests.llm.helpers import doc, groups, mutate, prose, shingles, table


def corpus(seed, texts=60):
    """Originals, copies with more and more edits, shared passages, and chains of edits."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    docs = []
    for _ in range(texts):
        base = prose(rng, rng.randrange(1, 160))
        if rng.random() < 0.4:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        docs.append(base)
        for _ in range(rng.randrange(4)):
            docs.append(mutate(rng, base, rng.randrange(6)))
        if rng.random() < 0.2:  # each a small step from the one before
            for _ in range(8):
                base = mutate(rng, base, 1)
                docs.append(base)
    rng.shuffle(docs)
    return [doc(i, " ".join(d)) for i, d in enumerate(docs)]


def odd(n):
    return [doc(n, None), doc(n + 1, ""), doc(n + 2, " \t\n"), doc(n + 3, "One"),
            doc(n + 4, "one"), doc(n + 5, "one two THREE"), doc(n + 6, "ONE  two\nthree "),
            doc(n + 7, "one two"), doc(n + 8, "Émile émile   x"), doc(n + 9, "émile Émile")]


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed, words, percent", [(0, 4, 85), (1, 4, 85), (2, 2, 60), (3, 1, 90)])
def test_equals_brute_force(spark, seed, words, percent):
    docs = corpus(seed)
    docs += odd(len(docs))
    sets = {d[0]: shingles(d[1], words) for d in docs}
    want = groups(sets, percent)
    made = got(sigtree.jaccard_join(table(spark, docs).repartition(5), words, percent))
    assert made == {i: (len(sets[i]), want[i]) for i in sets}
    assert any(want[i] != i for i in sets)


def test_large_trees_are_dealt_in_parts(spark, monkeypatch):
    """A root with many unlike leaves, chunks and parts of a few leaves, deep trees."""
    for name, value in (("CHUNK", 5), ("PART", 7), ("FANOUT", 2), ("CALL_BYTES", 3000), ("WORDS", 8),
                        ("FRONTIER", 50)):
        monkeypatch.setattr(sigtree, name, value)
    rng = random.Random(4)
    passage = prose(rng, 25)
    docs = [doc(i, " ".join(mutate(rng, passage + prose(rng, 6, 30), rng.randrange(3))))
            for i in range(150)]
    sets = {d[0]: shingles(d[1], 2) for d in docs}
    made = got(sigtree.jaccard_join(table(spark, docs).repartition(3), 2, 80))
    assert made == {i: (len(sets[i]), c) for i, c in groups(sets, 80).items()}


def test_rows_that_share_an_id_and_null_ids(spark):
    text = "a b c d e f g h"
    docs = [doc(4, text), doc(4, "another text of five words"), doc(9, text), doc(None, text),
            doc(None, "alone here"), doc(None, None)]
    rows = sigtree.jaccard_join(table(spark, docs), 4, 85).collect()
    assert sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id) for r in rows))) == sorted(
        map(repr, [(4, 5, 4), (4, 2, 4), (9, 5, 4), (None, 5, 4), (None, 1, None),
                   (None, 0, None)]))


def test_empty_and_unlinked_tables(spark):
    assert sigtree.jaccard_join(table(spark, [])).count() == 0
    made = got(sigtree.jaccard_join(table(spark, [doc(1, "x y"), doc(2, "y x"), doc(3, None)])))
    assert made == {1: (1, 1), 2: (1, 2), 3: (0, 3)}


def test_similar_sets_share_a_root():
    rng = np.random.default_rng(8)
    for percent in (60, 85, 95):
        for n in [*range(1, 60), 150, 400]:
            for _ in range(6):
                base = np.unique(rng.integers(0, 1 << 52, n))
                other = base.copy()
                for _ in range(rng.integers(0, 2 + n * (100 - percent) // 100)):
                    if rng.random() < 0.5 and len(other) > 1:
                        other = np.delete(other, rng.integers(len(other)))
                    else:
                        other = np.append(other, rng.integers(0, 1 << 52))
                other = np.unique(other)
                common = len(np.intersect1d(base, other))
                if 100 * common < percent * (len(base) + len(other) - common):
                    continue
                if common == len(base) == len(other):
                    continue
                values = np.concatenate([base, other]).astype(np.uint64)
                root, row = sigtree.parts(
                    values, np.array([0, len(base), len(values)]), percent)
                assert set(root[row == 0].tolist()) & set(root[row == 1].tolist())


def test_sets_with_many_empty_parts_share_a_root(monkeypatch):
    """With parts for far larger sets, nearly all are empty; least hashes take their place."""
    monkeypatch.setattr(sigtree, "RANGE", 50.0)
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(200):
        base = np.unique(rng.integers(0, 1 << 52, 12))
        other = np.unique(np.append(base, rng.integers(0, 1 << 52)))
        values = np.concatenate([base, other]).astype(np.uint64)
        root, row = sigtree.parts(values, np.array([0, 12, 25]), 85)
        met += bool(set(root[row == 0].tolist()) & set(root[row == 1].tolist()))
    assert met == 200


def pairs_of(left, right, percent):
    found = list(left.traverse(right, percent))
    return [np.concatenate([p[i] for p in found]) for i in (0, 1)]


def test_bounds_never_drop_a_link():
    """Every pair of sets that overlaps enough survives at every level of the trees."""
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 1 << 52, rng.integers(1, 300)).astype(np.uint64)
        for _ in range(4):
            copy = base.copy()
            change = rng.random(len(copy)) < 0.06
            copy[change] = rng.integers(0, 1 << 52, change.sum())
            sets.append(np.unique(copy))
    sizes = np.array([len(s) for s in sets])
    data, edges = sigtree.bitmaps(
        np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), 4)
    at = np.arange(len(sets))
    bits = sigtree.folded(data, edges, at, 64)
    wide = sigtree.folded(data, edges, at[sizes > 100], 256)
    for which, words in ((at, bits), (at[sizes > 100], wide)):
        tree = np.zeros(len(which), np.int64)
        forest = sigtree.Forest(tree, sizes[which], words, which, sigtree.Forest.depth_of(tree))
        a, b = pairs_of(forest, forest, 80)
        found = set(zip(which[a].tolist(), which[b].tolist(), strict=True))
        for i in which.tolist():
            for j in which.tolist():
                common = len(np.intersect1d(sets[i], sets[j]))
                if i != j and 100 * common >= 80 * (sizes[i] + sizes[j] - common):
                    assert (i, j) in found
    assert len(found) < len(which) ** 2 / 4  # most pairs are dropped on the way


def test_nodes_of_one_component_are_not_opened():
    bits = np.full((30, 1), 2**64 - 1, np.uint64)
    tree = np.zeros(30, np.int64)
    labels = np.repeat([5, 6], 15)
    forest = sigtree.Forest(tree, np.full(30, 64), bits, labels, sigtree.Forest.depth_of(tree))
    a, b = pairs_of(forest, forest, 85)
    assert len(a) == 2 * 15 * 15 and (labels[a] != labels[b]).all()


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    made = got(queries.all_queries()["op12_jaccard_join"](spark, folder))
    sets = {r.doc_id: shingles(r.text, 4)
            for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    want = groups(sets, 85)
    assert made == {i: (len(sets[i]), want[i]) for i in sets}
