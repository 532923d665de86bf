"""Packing of documents into training sequences of several permitted lengths.

Best fit, decreasing, with bins of variable capacity. The longest piece left goes into the
open bin that it fills best. If none has room a bin is opened: for each permitted capacity
the fill that the pieces still to come would give it is looked ahead at, and the capacity
with the least cost per packed token is opened. In the end each bin shrinks to the smallest
permitted capacity that holds its contents.

Documents longer than the largest capacity are cut into pieces, none is truncated. Pieces
are dealt by a hash into blocks of about ``block_rows`` and each block is packed by itself,
so the work is linear, memory is that of a block, and a rerun gives the same bins.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textops import word_counts
from corpusloom.session import materialize

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BLOCK_ROWS = 4096


def sequence_cost(capacity: int) -> float:
    """Cost of a training step on a sequence: linear layers and attention."""
    return capacity + capacity * capacity / 16384


def pack_block(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES,
               cost: Callable[[int], float] = sequence_cost):
    """(bin of each piece, its offset in the bin, capacity of each bin).

    ``lengths`` are in decreasing order, between 1 and the largest capacity.
    """
    capacities = sorted(capacities)
    lengths = np.asarray(lengths, np.int64)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    rising = -lengths
    total = len(lengths)

    def fill(at: int, capacity: int) -> int:
        """Tokens that pieces from ``at`` on would put in a new bin, longest first."""
        room, j = capacity, at
        while j < total and room > 0:
            j = max(j, int(np.searchsorted(rising, -room, "left")))
            if j >= total:
                break
            end = int(np.searchsorted(sums, sums[j] + room, "right")) - 1
            room -= int(sums[end] - sums[j])
            j = end + 1
        return capacity - room

    bins, offsets = np.empty(total, np.int64), np.empty(total, np.int64)
    opened: list[int] = []
    used: list[int] = []
    rooms: list[tuple[int, int]] = []
    for i, n in enumerate(lengths.tolist()):
        at = bisect.bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            room = min(fits, key=lambda c: (cost(c) / fill(i, c), c))
            b = len(opened)
            opened.append(room)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if room > n:
            bisect.insort(rooms, (room - n, b))
    final = [capacities[bisect.bisect_left(capacities, u)] for u in used]
    return bins, offsets, np.array(final, np.int64)


def pack(docs: DataFrame, capacities: Sequence[int] = CAPACITIES,
         cost: Callable[[int], float] = sequence_cost, block_rows: int = BLOCK_ROWS,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece (from 0), n_tokens, bin_id, bin_capacity, bin_offset.

    Tokens are words. A document without words (null or empty text) is one piece of 0
    tokens with null bin columns. A null id packs like any other; repeated rows are packed
    as often as they come; equal lengths go by id, then piece. Other columns are ignored.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    longest = max(capacities)
    sizes = materialize(word_counts(
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), ["doc_id"]
    ), "pack-sizes")
    pieces = (
        sizes.select(
            "doc_id", "size",
            F.explode(F.sequence(F.lit(0), F.greatest(
                F.ceil(F.col("size") / longest).cast("int"), F.lit(1)) - 1)).alias("piece"),
        )
        .select("doc_id", "piece", F.least(
            F.lit(longest), F.col("size") - F.col("piece").cast("long") * longest
        ).alias("n_tokens"))
    )
    amount = sizes.agg(F.sum(F.greatest(F.ceil(F.col("size") / longest), F.lit(1)))).first()[0]
    blocks = max(1, math.ceil((amount or 0) / block_rows))
    dealt = (
        pieces.withColumn("block", F.pmod(
            F.xxhash64("doc_id", "piece", "n_tokens"), F.lit(blocks)))
        .repartition(blocks, "block")
        .sortWithinPartitions("block", F.desc("n_tokens"), "doc_id", "piece")
    )
    limit = 8 * block_rows  # a block that repeated ids make larger is packed in parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, at, number = 0, None, 0

        def flush():
            nonlocal held, rows, number
            table = pa.Table.from_batches(held).combine_chunks()
            n = table["n_tokens"].to_numpy()
            full = int(np.count_nonzero(n))  # those without tokens come last
            bins, offsets, final = pack_block(n[:full], capacities, cost)
            gap = pa.nulls(len(n) - full, pa.int64())
            made = [
                pa.array(bins + (np.int64(at) << 32) + number), pa.array(final[bins]),
                pa.array(offsets),
            ]
            number += len(final)
            held, rows = [], 0
            out = [table["doc_id"].combine_chunks(), table["piece"].combine_chunks(),
                   table["n_tokens"].combine_chunks()]
            yield pa.RecordBatch.from_arrays(
                [*out, *(pa.concat_arrays([m, gap]) for m in made)],
                names=["doc_id", "piece", "n_tokens", "bin_id", "bin_capacity", "bin_offset"],
            )

        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if rows and (block[low] != at or rows >= limit):
                    yield from flush()
                if block[low] != at:
                    at, number = int(block[low]), 0
                held.append(batch.slice(low, high - low))
                rows += high - low
        if rows:
            yield from flush()

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return dealt.mapInArrow(
        run, f"doc_id {kind}, piece int, n_tokens long, bin_id long, bin_capacity long, "
        "bin_offset long")
