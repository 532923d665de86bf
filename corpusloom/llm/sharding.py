"""Placement of rows on shards by a permutation-filled lookup table (Maglev hashing).

Every shard has its own preference order over the slots of a table whose size is prime.
Shards take turns; at its turn a shard claims its most preferred free slot, until the
table is full. Shards so hold equally many slots (one more or less), and when a shard
goes, nearly all other slots keep their owner.

The table is a parameter of the job: its size is fixed by the caller and never follows the
data. Rows are placed by a join with the broadcast table, with DataFrame functions only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 10_007


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard (its place in ``shards``) of every slot.

    A shard's preference order is offset, offset + skip, offset + 2 * skip ... modulo size.
    The order of ``shards`` decides who begins; names must differ.
    """
    if not _is_prime(size) or not 0 < len(shards) <= size or len({*shards}) < len(shards):
        raise ValueError("a prime size and at most as many shards, all different, are needed")
    digests = [hashlib.md5(name.encode()).hexdigest() for name in shards]
    next_slot = [int(d[:15], 16) % size for d in digests]
    skip = [int(d[15:30], 16) % (size - 1) + 1 if size > 2 else 1 for d in digests]
    table, left = [-1] * size, size
    while left:
        for shard in range(len(shards)):
            slot = next_slot[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % size
            table[slot] = shard
            next_slot[shard] = (slot + skip[shard]) % size
            left -= 1
            if not left:
                break
    return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a string key: the first 60 bits of its MD5, which other engines have too."""
    prefix = F.substring(F.md5(key.cast("binary")), 1, 15)
    return F.pmod(F.conv(prefix, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(df: DataFrame, keys: Sequence[str], shards: Sequence[str],
          size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with the columns slot (int) and shard (int, place in ``shards``).

    The key is the first of ``keys`` that is not null (all null: the empty string), so rows
    without an id can be spread by a second column. Equal keys share a shard; repeated rows
    stay repeated. Columns of ``df`` called slot or shard are replaced. No shuffle; an empty
    table gives an empty result.
    """
    owners = ",".join(map(str, lookup_table(shards, size)))
    spark = df.sparkSession
    table = spark.range(1).select(
        F.posexplode(F.split(F.lit(owners), ",")).alias("_slot", "_owner")
    ).select("_slot", F.col("_owner").cast("int").alias("_owner"))
    key = F.coalesce(*(F.col(k).cast("string") for k in keys), F.lit(""))
    placed = df.withColumn("slot", slot_of(key, size)).join(
        F.broadcast(table), F.col("slot") == F.col("_slot"), "left"
    )
    return placed.withColumn("shard", F.col("_owner")).drop("_slot", "_owner")
