import collections

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import sharding
from tests.llm.helpers import doc, table

NAMES = [f"s{i}" for i in range(7)]


def test_slots_are_claimed_in_turns():
    size = 101
    table_ = sharding.lookup_table(NAMES, size)
    share = collections.Counter(table_)
    assert sorted(share) == list(range(7)) and max(share.values()) - min(share.values()) <= 1
    # the first turn: each shard has its favourite slot, or the next one by its skip
    assert len(table_) == size and -1 not in table_


def test_few_slots_move_when_a_shard_goes():
    before = sharding.lookup_table(NAMES, 1009)
    after = sharding.lookup_table(NAMES[:-1], 1009)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 6)
    assert moved < 0.15 * 1009


@pytest.mark.parametrize("names, size", [([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 9, 7)])
def test_bad_parameters(names, size):
    with pytest.raises(ValueError):
        sharding.lookup_table(names, size)


def test_small_tables():
    assert sharding.lookup_table(["a"], 2) == [0, 0]
    assert sorted(sharding.lookup_table(["a", "b", "c"], 3)) == [0, 1, 2]


def test_rows_are_placed_without_python_or_shuffle(spark):
    rows = [doc(i, "t") for i in range(300)] + [doc(5, "u"), doc(None, "a"), doc(None, None)]
    docs = table(spark, rows).withColumn("shard", F.lit("old"))
    placed = sharding.place(docs, ["doc_id", "text"], NAMES, 101)
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "hashpartitioning" not in plan
    got = placed.collect()
    assert len(got) == 303 and all(r.shard == sharding.lookup_table(NAMES, 101)[r.slot] for r in got)
    assert len({r.shard for r in got if r.doc_id == 5}) == 1
    assert collections.Counter(r.shard for r in got).most_common(1)[0][1] < 80
    assert sharding.place(docs.limit(0), ["doc_id"], NAMES, 101).count() == 0
