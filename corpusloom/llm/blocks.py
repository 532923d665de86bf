"""Query rows in blocks of bounded size, and broadcasts that end with their block."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_blocks(rows: DataFrame, key: str, weight: int, most: int) -> list[DataFrame]:
    """``rows`` in blocks by the hash of ``key``; ``weight`` in all, about ``most`` in each."""
    count = max(1, math.ceil(weight / most))
    number = F.pmod(F.xxhash64(key), F.lit(count))
    return [rows.filter(number == i) for i in range(count)]


@contextmanager
def lent(spark: SparkSession, value) -> Iterator[Callable]:
    """Broadcast ``value`` to tasks, classes by value too; it is destroyed at the end."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    try:
        yield lambda: pickle.loads(packed.value)
    finally:
        packed.destroy()


def union(spark: SparkSession, parts: list[DataFrame], schema: str) -> DataFrame:
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
