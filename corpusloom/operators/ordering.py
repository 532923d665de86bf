"""Running numbers, sums and carries that survive one huge group.

A plain window over a key puts every row of that key into one task. These helpers work
in two levels: rows are windowed inside (key, block), where a block is a value-based
slice of the order column, and only one summary row per block is windowed over the key.
Blocks come from data values, so a re-run of a lost task gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    amount: Column,
    name: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """Add ``name`` = sum of ``amount`` over this and all earlier rows of the key.

    ``block`` must not decrease along ``order`` within a key. ``start`` has a row per key
    with ``name`` to count on from; it meets the row per block, not the rows.
    """
    keyed = df.withColumn("_block", block)
    inner = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    local = keyed.withColumn("_local", F.sum(amount).over(inner))
    whole = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        keyed.groupBy(*keys, "_block")
        .agg(F.sum(amount).alias("_in_block"))
        .withColumn("_before", F.coalesce(F.sum("_in_block").over(whole), F.lit(0)))
        .drop("_in_block")
    )
    if start is not None:
        before = before.join(start.withColumnRenamed(name, "_start"), [*keys], "left").withColumn(
            "_before", F.col("_before") + F.coalesce("_start", F.lit(0))).drop("_start")
    return (
        local.join(before, [*keys, "_block"])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_block", "_local", "_before")
    )


def row_number(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column | str],
    name: str,
    start: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row within its key, counted on from ``start`` if given."""
    return running_total(df, keys, block, order, F.lit(1), name, start)


def carry_last(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column,
    name: str,
    block_size: int = 1024,
) -> DataFrame:
    """Add ``name`` = last non-NULL ``value`` of strictly earlier positions of the key.

    ``df`` has one row per (key, integer position).
    """
    keyed = df.withColumn("_block", F.floor(F.col(position) / block_size)).withColumn(
        "_value", value
    )
    inner = Window.partitionBy(*keys, "_block").orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1
    )
    whole = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    has_value = F.when(F.col("_value").isNotNull(), F.col(position))
    blocks = (
        keyed.groupBy(*keys, "_block")
        .agg(F.max_by("_value", has_value).alias("_block_last"))
        .withColumn("_carried", F.last("_block_last", ignorenulls=True).over(whole))
        .drop("_block_last")
    )
    return (
        keyed.withColumn("_inner", F.last("_value", ignorenulls=True).over(inner))
        .join(blocks, [*keys, "_block"])
        .withColumn(name, F.coalesce("_inner", "_carried"))
        .drop("_block", "_value", "_inner", "_carried")
    )
