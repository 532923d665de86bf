import collections
import random

import pytest

from corpusloom.llm import packing
from tests.llm.helpers import doc, table


@pytest.mark.parametrize("seed", range(4))
def test_block_is_packed_whole_and_tight(seed):
    rng = random.Random(seed)
    lengths = sorted((min(8192, int(rng.lognormvariate(5.5, 1.3)) + 1) for _ in range(3000)),
                     reverse=True)
    bins, offsets, final = packing.pack_block(lengths)
    used = collections.Counter()
    for n, b, at in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
        assert at == used[b]
        used[b] += n
    for b, capacity in enumerate(final.tolist()):
        smaller = [c for c in packing.CAPACITIES if c < capacity]
        assert used[b] <= capacity and (not smaller or used[b] > max(smaller))
    assert sum(used.values()) / final.sum() > 0.97
    # no worse than giving every piece the smallest capacity that holds it
    alone = sum(packing.sequence_cost(min(c for c in packing.CAPACITIES if c >= n))
                for n in lengths)
    assert sum(map(packing.sequence_cost, final.tolist())) < 0.8 * alone


def test_best_fit_and_downsizing():
    bins, offsets, final = packing.pack_block([6, 5, 3, 2], (4, 8), lambda c: c)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 5, 6]
    assert final.tolist() == [8, 8]
    assert packing.pack_block([3], (4, 8), lambda c: 1)[2].tolist() == [4]
    assert packing.pack_block([])[2].tolist() == []


def test_documents(spark):
    rows = [doc(i, "w " * (i % 40)) for i in range(200)]
    rows += [doc(7, "w " * 7), doc(None, "a b"), doc(300, None), doc(301, "word " * 20_001)]
    docs = table(spark, rows).selectExpr("*", "1 AS block", "'x' AS bin_id", "2 AS size")
    got = packing.pack(docs, (16, 64), block_rows=50).collect()
    by_id = collections.Counter()
    used, capacity = collections.defaultdict(list), {}
    for r in got:
        by_id[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0) == (r.bin_capacity is None)
        if r.bin_id is not None:
            used[r.bin_id].append((r.bin_offset, r.n_tokens))
            assert capacity.setdefault(r.bin_id, r.bin_capacity) == r.bin_capacity
    assert by_id[301] == 20_001 and by_id[None] == 2 and by_id[300] == 0 and by_id[7] == 14
    assert all(by_id[i] == i % 40 for i in range(200) if i != 7)
    for b, parts in used.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= capacity[b]
    assert sorted(map(str, got)) == sorted(map(str, packing.pack(docs, (16, 64), block_rows=50).collect()))
    assert packing.pack(docs.limit(0)).count() == 0


def test_a_repeated_id_is_packed_in_parts(spark):
    docs = table(spark, [doc(1, "a b c")] * 900)
    got = packing.pack(docs, (16,), block_rows=10).collect()
    assert len(got) == 900 and len({r.bin_id for r in got}) >= 180
    assert collections.Counter((r.bin_id, r.bin_offset) for r in got).most_common(1)[0][1] == 1
