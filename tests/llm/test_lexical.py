import math
import random
import re

import numpy as np
import pytest

from corpusloom.llm import lexical, queries
from tests.llm.helpers import doc, table

ITEMS = "item_id long, text string, rank int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k):
    """The definition, by scoring every document for every item."""
    bags = [(i, terms(t)) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    length = sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, text in items:
        asked.setdefault(i, []).extend(terms(text))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, bag in bags:
            if not bag:
                continue
            m = 75 + 25 * len(bag) * n_docs // length
            score = 0
            for t in wanted:
                tf = bag.count(t)
                if tf:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort(key=lambda x: x[:3])
        out += [(item, n + 1, f[3], -f[0]) for n, f in enumerate(found[:k])]
    return sorted(out, key=repr)


def got(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def corpus(seed, n=240):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [doc(i, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [doc(900, None), doc(901, ""), doc(902, " .,!"), doc(903, "Éé W1-w1_w2\x00w3{w1}"),
             doc(None, "w1 w2 w2"), doc(None, "w1 w2 w2"), docs[5], doc(7, "w1 W1 w1"),
             doc(904, "w1 " * 5000 + "rare"), doc(905, "日本語 w1 naïve")]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 30))), 1, "x") for i in range(25)]
    items += [(100, None, 1, "x"), (101, "", 1, "x"), (102, "nowhere", 1, "x"), (103, "W1 w1 w1", 1, ""),
              (104, "rare 日本語 éé Éé w3", 1, ""), (3, "w9 w8", 1, ""), (None, "w2", 1, "")]
    return docs, items


@pytest.mark.parametrize("seed, k", [(0, 20), (1, 3), (2, 1000)])
def test_equals_brute_force(spark, monkeypatch, seed, k):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 70)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 100)
    docs, items = corpus(seed)
    made = lexical.ranked_search(
        table(spark, docs).repartition(2), table(spark, items, ITEMS), k)
    assert got(made) == brute([d[:2] for d in docs], [i[:2] for i in items], k)


@pytest.mark.parametrize("short", [1, 8, 10**9])
def test_short_and_long_lists_give_the_same(monkeypatch, short):
    """All lists accumulated, some of them, and none: equal, and equal to plain sums."""
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "BLOCK", 4)
    rng = np.random.default_rng(short % 7)
    n = 1500
    lists = object.__new__(lexical.Lists)
    lists.docs, lists.place, lists.at, lists.score = n, {}, [], []
    lists.top, lists.maxima = [], []
    whole = []
    for t in range(12):
        at = np.flatnonzero(rng.random(n) < 0.9 / (t + 1))
        score = rng.integers(1, 40 * (t + 1), len(at))
        lists.place[t] = t
        lists.at.append(at)
        lists.score.append(score)
        lists.top.append(int(score.max()))
        lists.maxima.append(lists._block_maxima(at, score) if lists.is_long(len(at)) else None)
        dense = np.zeros(n, np.int64)
        dense[at] = score
        whole.append(dense)
    assert short == 1 or any(m is not None for m in lists.maxima)
    for k in (1, 10, 5000):
        times = rng.integers(1, 3, 12)
        sums = sum(t * w for t, w in zip(times, whole, strict=True))
        order = [i for i in np.lexsort((np.arange(n), -sums)) if sums[i] > 0][:k]
        place, score = lists.best(np.arange(12), times, k)
        assert place.tolist() == order and score.tolist() == sums[order].tolist()


def test_index_is_a_table_of_posting_lists(spark):
    docs = [doc(3, "b a B"), doc(1, "a"), doc(None, "c"), doc(2, None)]
    rows = lexical.build_index(table(spark, docs).coalesce(1)).collect()
    (own,) = [r for r in rows if r.term is None]
    assert own.ids == [1, 2, 3, None] and own.sizes == [1, 0, 3, 1]
    lists = {r.term: (r.n_docs, r["at"], r.tf) for r in rows if r.term is not None}
    assert lists == {"a": (2, [0, 2], [1, 1]), "b": (1, [2], [2]), "c": (1, [3], [1])}


def test_empty_tables(spark):
    docs, items = corpus(0, 9)
    some, none = table(spark, docs), table(spark, [])
    asked, nothing = table(spark, items, ITEMS), table(spark, [], ITEMS)
    for d, i in ((none, asked), (some, nothing), (none, nothing)):
        made = lexical.ranked_search(d, i)
        assert made.count() == 0 and made.columns == ["item_id", "rank", "doc_id", "score"]


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    made = queries.all_queries()["op11_lexical_search"](spark, folder)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    items = [(r.item_id, r.text)
             for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    assert got(made) == brute(docs, items, 20)
