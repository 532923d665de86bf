"""Two-level running numbers equal plain windows, also with a hot key and tiny blocks."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import ordering


def frame(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{i % 7}", i, rng.randint(0, 9),
             rng.choice([None, "a", "b", "c"])) for i in range(400)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "key string, pos long, amount int, value string")


def test_row_number_and_running_total(spark):
    df = frame(spark)
    w = Window.partitionBy("key").orderBy("pos")
    want = df.select("key", "pos", F.row_number().over(w).alias("n"),
                     F.sum("amount").over(w).alias("s"))
    block = F.floor(F.col("pos") / 16)
    got = ordering.row_number(df, ["key"], block, ["pos"], "n")
    got = ordering.running_total(got, ["key"], block, ["pos"], F.col("amount"), "s")
    key = lambda r: (r["key"], r["pos"])
    assert sorted(map(tuple, want.collect())) == sorted(
        map(tuple, got.select("key", "pos", "n", "s").collect())
    )


def test_carry_last(spark):
    df = frame(spark)
    w = Window.partitionBy("key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("key", "pos", F.last("value", True).over(w).alias("c"))
    got = ordering.carry_last(df, ["key"], "pos", F.col("value"), "c", block_size=8)
    assert sorted(map(str, want.collect())) == sorted(
        map(str, got.select("key", "pos", "c").collect())
    )
