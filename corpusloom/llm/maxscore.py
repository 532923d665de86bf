"""Exact top-k by integer inner product with MaxScore pruning.

A query's dimensions are its terms. In a block of candidate rows the score bound of a term
is the largest product that the block's values allow. Terms in the order of their bounds
are split: the *non-essential* ones are those whose bounds together stay below the query's
current k-th score, so they alone can bring no row in. Essential terms are traversed for
all rows of the block; then the non-essential terms are probed one by one, largest bound
first, only for the rows that partial score plus remaining bounds keep competitive. Nothing
that could reach the k-th score is left out, so the result is exact.

The candidate table is scanned in place, each task is a shard with its own best lists, and
only k rows per query and task are merged. Queries come in blocks of ``QUERY_BLOCK`` rows;
one block at a time is broadcast, whose size is fixed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.textops import ship
from corpusloom.llm.vectors import Best, matrix, usable
from corpusloom.session import materialize

QUERY_BLOCK = 2048
ROW_BLOCK = 2048


def query_blocks(queries: DataFrame, block: int) -> list[DataFrame]:
    """The rows in hash blocks of about ``block``; one row per id (the smallest vector)."""
    single = materialize(
        queries.groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    count = max(1, math.ceil(single.count() / block))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(count))
    return [single.filter(number == i) for i in range(count)]


def traverse(best: Best, ids: np.ndarray, rows: np.ndarray, own: np.ndarray,
             terms: np.ndarray) -> None:
    """Offer a block of candidates (``ids``, ``rows``) to the queries (``own``, ``terms``)."""
    high, low = rows.max(axis=0), rows.min(axis=0)
    bounds = np.maximum(terms * high, terms * low)
    order = np.argsort(bounds, axis=1, kind="stable")
    rising = np.take_along_axis(bounds, order, axis=1)
    total = np.cumsum(rising, axis=1)
    below = total < best.floor[:, None]  # the first terms whose bounds stay below the k-th
    # negative bounds only lower the sum, so the split is where it last stays below
    split = np.where(below.any(axis=1), below.shape[1] - below[:, ::-1].argmax(axis=1), 0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(order.shape[1])[None, :], axis=1)
    essential = np.where(rank >= split[:, None], terms, 0.0)
    partial = essential @ rows.T
    rest = np.where(split > 0, np.take_along_axis(
        total, np.maximum(split - 1, 0)[:, None], axis=1)[:, 0], 0.0)
    partial[own[:, None] == ids[None, :]] = -np.inf
    floor = best.floor
    if len(ids) >= best.k:  # the block's own k-th score, where scores are complete
        whole = np.flatnonzero(split == 0)
        floor = floor.copy()
        floor[whole] = np.maximum(
            floor[whole], np.partition(partial[whole], -best.k, axis=1)[:, -best.k])
    least = np.maximum(floor, -1e300)  # leaves out the query's own row
    query, row = np.nonzero(partial + rest[:, None] >= least[:, None])
    score = partial[query, row]
    step = split[query]
    while len(query) and step.max() > 0:  # probe, largest bound first
        going = step > 0
        done = ~going
        at = order[query, np.maximum(step - 1, 0)]
        score = score + np.where(going, terms[query, at] * rows[row, at], 0.0)
        step = step - going
        left = np.where(step > 0, total[query, np.maximum(step - 1, 0)], 0.0)
        live = done | (score + left >= best.floor[query])
        query, row, score, step = query[live], row[live], score[live], step[live]
    if len(query):
        best.offer(query, ids[row], score)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose id is divisible by ``every``.

    Components become floor(scale * x); sums of products are exact below 2**53. Rows that
    share the query's id are its own and no candidates; of a repeated query id the smallest
    vector is used; repeated candidates rank as often as they come. Null ids and vectors
    that are null, empty or hold null or non-finite components take no part; shorter
    vectors end in zeros. Ties go to the smaller id. Too few candidates: all of them.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    dim = rows.agg(F.max(F.size("vector"))).first()[0] or 1
    parts = []
    for block in query_blocks(rows.filter(F.col("vec_id") % every == 0), QUERY_BLOCK):
        table = block.toArrow().combine_chunks()
        own = table["vec_id"].to_numpy().astype(np.int64)
        column = table["vector"].combine_chunks() if len(own) else pa.array([], pa.list_(pa.float64()))
        shipped = ship(spark, (own, np.floor(scale * matrix(column, dim))))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            own, terms = shipped()
            best = Best(len(own), k)
            for batch in batches:
                ids = batch.column("vec_id").to_numpy().astype(np.int64)
                values = np.floor(scale * matrix(batch.column("vector"), dim))
                for at in range(0, len(ids) if len(own) else 0, ROW_BLOCK):
                    traverse(best, ids[at : at + ROW_BLOCK], values[at : at + ROW_BLOCK],
                             own, terms)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[best.query]), pa.array(best.ids),
                 pa.array(best.score.astype(np.int64))], names=["query_id", "vec_id", "score"])

        parts.append(rows.mapInArrow(run, "query_id long, vec_id long, score long"))
    found = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(
        F.col("rank") <= k)
