import collections
import math
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm import lm
from tests.llm.helpers import doc, prose, table, words


class Plain:
    """A lexicon for network tests."""

    def __init__(self, seed=0):
        rng = np.random.default_rng(seed)
        self.weight = 1e5 / np.arange(1, lm.VOCABULARY + 1)
        self.place = rng.permutation(lm.VOCABULARY).astype(np.int32)


def test_probabilities_sum_to_one():
    net = lm.Network(Plain())
    state = np.random.default_rng(0).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    every = net.log_likelihood(np.repeat(state, lm.VOCABULARY, 0), np.arange(lm.VOCABULARY))
    assert np.exp(every.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_gradients():
    net = lm.Network(Plain())
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    inputs, targets = rng.integers(0, lm.VOCABULARY, (2, 3, 5))
    live = np.ones((3, 5), bool)
    live[2, 3:] = False
    start = rng.standard_normal((3, lm.HIDDEN))
    grads, _, _ = net.window_gradients(inputs, targets, live, start)

    def loss():
        h, states = start, []
        for t in range(5):
            h = net.step(inputs[:, t], h)
            states.append(h)
        return -net.log_likelihood(np.stack(states, 1)[live], targets[live]).sum() / live.sum()

    for name, grad in grads.items():
        flat, grad = net.p[name].reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(grad))[[0, 2, 9]]:
            old = flat[i]
            flat[i] = old + 1e-5
            high = loss()
            flat[i] = old - 1e-5
            low = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((high - low) / 2e-5, rel=1e-4, abs=1e-8)


def test_state_is_carried_over_windows_and_lanes_do_not_mix():
    net = lm.Network(Plain())
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, lm.VOCABULARY, n) for n in (1, 200, 33, 5, 64)]
    bounds = np.cumsum([0, *map(len, parts)])
    got = net.score(np.concatenate(parts), bounds)
    for tokens, value in zip(parts, got, strict=True):
        h, last, total = np.zeros((1, lm.HIDDEN), np.float32), net.place[[lm.END]], 0.0
        for token in net.place[tokens]:
            h = net.step(last, h)
            last = np.array([token])
            total += float(net.log_likelihood(h, last)[0])
        assert value == pytest.approx(total / math.log(10), rel=1e-4)


def plain_base(rows):
    counts = collections.Counter()
    for i, text, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update([*words(text), None])
    total, distinct = sum(counts.values()), len(counts)
    out = {}
    for i, text, *_ in rows:
        tokens = [*words(text), None]
        score = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        out[i] = (len(tokens), sum(counts[t] > 0 for t in tokens), total, score)
    return out


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(150):  # two "languages", so that context tells
        own = [f"{'ab'[i % 2]}{w}" for w in prose(rng, rng.randrange(5, 200), 60)]
        rows.append(doc(i, " ".join(own) + f" Rare{i}"))
    rows += [doc(900, None), doc(901, ""), doc(902, "never seen words"), doc(None, "a1 b2"),
             doc(903, "aw1 " * 9000)]
    return rows


@pytest.mark.parametrize("head", [1 << 18, 70])
def test_documents(spark, monkeypatch, head):
    monkeypatch.setattr(lm, "HEAD", head)
    rows = corpus()
    docs = table(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS row")
    got = lm.score_documents(docs, stretches=256).collect()
    assert len(got) == len(rows)
    want = plain_base(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
        assert r.held_out == (r.doc_id is not None and not zlib.crc32(str(r.doc_id).encode()) % 10)
    held = [r for r in got if r.held_out and r.doc_id < 150]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty_and_untrained(spark):
    docs = table(spark, corpus())
    assert lm.score_documents(docs.limit(0)).count() == 0
    i = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    got = lm.score_documents(table(spark, [doc(i, "some words")])).collect()[0]
    assert (got.n_tokens, got.n_known, got.train_tokens) == (3, 0, 0) and math.isfinite(got.score)


def test_every_training_token_is_trained_on_in_lanes(spark):
    rows = corpus()
    texts = table(spark, rows).selectExpr("xxhash64(doc_id, text) AS uid", "text").repartition(3)
    lexicon = lm.Lexicon(lm.word_totals(texts), len(rows))
    total = sum(len(words(text)) + 1 for _, text, *_ in rows)
    assert lexicon.total == total
    tokens = [r.tokens for r in lm._stretches(texts, lexicon).collect()]
    assert sum(len(t) - 1 for t in tokens) == total
    network = lm.Network(lexicon)
    # far fewer stretches than there are: still every token once, in several lanes
    assert lm.fit(network, texts, lexicon, stretches=8, lane=16) == total
    plain = lm.Network(lexicon)
    every = [np.array(t) for t in tokens]
    values, bounds = np.concatenate([t[1:] for t in every]), np.cumsum(
        [0, *(len(t) - 1 for t in every)])
    assert network.score(values, bounds).sum() > plain.score(values, bounds).sum()


def test_runs_are_the_distinct_values_and_their_places():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 40, 300).astype(np.uint64)
    distinct, order, first = lm.runs(values)
    assert (distinct == np.unique(values)).all()
    assert (values[order[first]] == distinct).all()
    counts = np.diff(first, append=len(values))
    assert (counts == np.unique(values, return_counts=True)[1]).all()


def test_logits_are_cut_only_where_weights_allow_more(monkeypatch):
    """The pass over the logits is left out where it can't change them."""
    lexicon = type("L", (), {"place": np.arange(lm.VOCABULARY),
                             "weight": np.ones(lm.VOCABULARY)})
    network = lm.Network(lexicon)
    rng = np.random.default_rng(5)
    states = np.tanh(rng.standard_normal((500, lm.HIDDEN))).astype(np.float32)
    targets = rng.integers(0, lm.VOCABULARY, 500)
    assert network._bounded("class_w", "class_b") and network._bounded("token_w", "token_b")
    free = network.log_likelihood(states, targets)
    monkeypatch.setattr(lm.Network, "_bounded", lambda *_: False)
    assert (network.log_likelihood(states, targets) == free).all()
    monkeypatch.undo()
    network.p["class_w"] *= 1e4
    assert not network._bounded("class_w", "class_b")
    assert np.isfinite(network.log_likelihood(states, targets)).all()
