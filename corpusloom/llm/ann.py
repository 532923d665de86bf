"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Index. Vectors get one more component that makes all norms equal, so the largest inner
product is the smallest distance. They are turned by one random rotation, which spreads
any vector's length evenly over the dimensions, and stored by inverted list (nearest
k-means centre). The centres are fitted on a bounded sample; every row is indexed. How
many lists a query probes is measured on that sample: clustered vectors need few, vectors
without structure many.

Search. In a list, distances to the probing queries are summed up column block by column
block. After each block a hypothesis test asks whether the partial distance, scaled up to
all dimensions, still allows a distance within the query's current k-th best; if it does
not, the candidate is abandoned. What is left gets the exact inner product of the original
vectors in double precision.

The index is written sorted by list and scanned in place; vectors are never shuffled at
search time. Queries come in blocks of fixed size, broadcast one at a time with their
probed lists; each task returns k rows per query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.maxscore import QUERY_BLOCK, query_blocks
from corpusloom.llm.textops import ship
from corpusloom.llm.vectors import Best, matrix, usable
from corpusloom.session import materialize

#: Bounds of what the centres are fitted on and of the centres themselves.
SAMPLE_ROWS = 65_536
MOST_LISTS = 4096
COLUMNS = 16  # dimensions per column block
EPSILON = 2.1  # larger: fewer wrong abandonments, more work
#: Queries probe as many lists as hold this share of the true neighbours of sampled vectors.
TARGET = 0.97
TUNING_QUERIES = 256


class Space:
    """The rotated space of equal norms, and its list centres."""

    def __init__(self, dim: int, norm: float, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim, self.norm2 = dim, norm * norm
        self.turn = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
        points = self.rows(sample)
        centres = points[rng.permutation(len(points))[:lists]]
        for _ in range(8):
            near = self._nearest(points, centres)
            sizes = np.bincount(near, minlength=len(centres))
            totals = np.zeros_like(centres)
            np.add.at(totals, near, points)
            filled = sizes > 0
            centres = np.where(filled[:, None], totals / np.maximum(sizes, 1)[:, None], centres)
        self.centres = centres
        self.probed = 1

    def tune(self, sample: np.ndarray, k: int, target: float = TARGET) -> None:
        """Probe so many lists that they hold ``target`` of the sample's true neighbours."""
        number = np.arange(len(sample))
        step = max(1, len(sample) // TUNING_QUERIES)
        asked = number[::step][:TUNING_QUERIES]
        near = sample[asked] @ sample.T
        near[np.arange(len(asked)), asked] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = np.argsort(
            self._distances(self.queries(sample[asked]), self.centres), axis=1, kind="stable")
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
        lists = self.lists(self.rows(sample))
        ranks = np.take_along_axis(place, lists[best], axis=1)
        self.probed = int(np.quantile(ranks, target, method="higher")) + 1

    def rows(self, vectors: np.ndarray) -> np.ndarray:
        gap = np.maximum(self.norm2 - (vectors * vectors).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(gap)]) @ self.turn

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.zeros(len(vectors))]) @ self.turn

    @staticmethod
    def _distances(points, centres):
        return (centres * centres).sum(axis=1) - 2 * points @ centres.T

    @classmethod
    def _nearest(cls, points, centres):
        parts = [np.empty(0, np.int64)]
        for at in range(0, len(points), 4096):
            parts.append(cls._distances(points[at : at + 4096], centres).argmin(axis=1))
        return np.concatenate(parts)

    def lists(self, points: np.ndarray) -> np.ndarray:
        return self._nearest(points, self.centres)

    def probes(self, points: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """Marks (query, list): the nearest lists, and more until they hold ``least`` rows."""
        order = np.argsort(self._distances(points, self.centres), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        wanted = (np.arange(order.shape[1]) < self.probed) | (held < least)
        marks = np.zeros(order.shape, bool)
        np.put_along_axis(marks, order, wanted, axis=1)
        return marks


def build_index(vectors: DataFrame, k: int, lists: int | None = None, target: float = TARGET):
    """(index table: vec_id, vector, list, turned; the space; rows per list).

    ``vectors`` holds (vec_id, vector) of rows that take part. By default the number of
    lists is the square root of the row count, at most ``MOST_LISTS``.
    """
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    count, dim, longest = vectors.agg(
        F.count(F.lit(1)), F.max(F.size("vector")), F.max(norm)).first()
    if not count:
        return None
    lists = lists or min(MOST_LISTS, max(1, round(math.sqrt(count))))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS)
    column = sample.select("vector").toArrow().combine_chunks()["vector"].combine_chunks()
    fitted = matrix(column, dim)
    space = Space(dim, longest, fitted, lists)
    space.tune(fitted, k, target)
    shipped = ship(spark, space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shipped()
        for batch in batches:
            points = space.rows(matrix(batch.column("vector"), dim))
            turned = pa.ListArray.from_arrays(
                np.arange(0, points.size + 1, dim + 1, dtype=np.int32), points.ravel())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(space.lists(points).astype(np.int32)), turned],
                names=["vec_id", "vector", "list", "turned"])

    kind = vectors.schema["vector"].dataType.simpleString()
    listed = vectors.mapInArrow(
        run, f"vec_id long, vector {kind}, list int, turned array<double>")
    # a large list is spread over several range partitions by the id's hash
    index = materialize(
        listed.withColumn("part", F.xxhash64("vec_id")).repartitionByRange("list", "part")
        .sortWithinPartitions("list", "part").drop("part"), "vector-index")
    sizes = np.zeros(lists, np.int64)
    for row in index.groupBy("list").count().collect():  # as many rows as lists
        sizes[row["list"]] = row["count"]
    return index, space, sizes


def scan_list(best: Best, space: Space, ids, vectors, points, own, asked, asked_points,
              probing, epsilon: float = EPSILON) -> None:
    """Offer the rows of one list to the queries ``probing`` it, abandoning by column block."""
    dims = points.shape[1]
    floor = best.floor[probing]
    length = (asked[probing] * asked[probing]).sum(axis=1)
    with np.errstate(invalid="ignore"):  # the k-th best as a squared distance
        radius = np.maximum(length + space.norm2 - 2 * floor, 0)
    near = np.zeros((len(probing), len(ids)))
    query = row = partial = None
    for at in range(0, dims, COLUMNS):
        block = points[:, at : at + COLUMNS]
        q_block = asked_points[:, at : at + COLUMNS]
        seen = min(at + COLUMNS, dims)
        slack = (1 + epsilon / math.sqrt(seen)) ** 2 if seen < dims else 1 + 1e-9
        limit = radius * slack * seen / dims + 1e-12
        if query is None:
            q = q_block[probing]
            near = (q * q).sum(axis=1)[:, None] + (block * block).sum(axis=1) - 2 * q @ block.T
            query, row = np.nonzero((near <= limit[:, None]) & (own[probing][:, None] != ids))
            partial = near[query, row]
        else:
            partial = partial + ((q_block[probing[query]] - block[row]) ** 2).sum(axis=1)
            kept = partial <= limit[query]
            query, row, partial = query[kept], row[kept], partial[kept]
    if not len(query):
        return
    asked_by = probing[query]
    score = np.einsum("ij,ij->i", asked[asked_by], vectors[row])
    good = score >= best.floor[asked_by]
    best.offer(asked_by[good], ids[row[good]], score[good])


def neighbours(vectors: DataFrame, k: int = 20, every: int = 20, lists: int | None = None,
               target: float = TARGET, epsilon: float = EPSILON, id_col: str = "vec_id",
               vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of each row whose id is divisible by
    ``every``, among all rows but those that share its id; score is the inner product of
    the original vectors in double precision.

    Null ids and vectors that are null, empty, all zero or hold null or non-finite
    components take no part; shorter vectors end in zeros; of a repeated query id the
    smallest vector is used, repeated candidates rank as often as they come; ties go to the
    smaller id. With fewer than ``k`` candidates all are returned.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    rows = rows.withColumn("vec_id", F.col("vec_id").cast("long"))
    schema = "query_id long, rank int, vec_id long, score double"
    built = build_index(rows, k, lists, target)
    if built is None:
        return spark.createDataFrame([], schema)
    index, space, sizes = built
    dim = space.dim
    parts = []
    for block in query_blocks(rows.filter(F.col("vec_id") % every == 0), QUERY_BLOCK):
        table = block.toArrow().combine_chunks()
        own = table["vec_id"].to_numpy().astype(np.int64)
        if not len(own):
            continue
        asked = matrix(table["vector"].combine_chunks(), dim)
        asked_points = space.queries(asked)
        marks = space.probes(asked_points, sizes, 4 * k + 1)
        space_only = Space.__new__(Space)
        space_only.norm2 = space.norm2
        shipped = ship(spark, (own, asked, asked_points, marks, space_only))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            own, asked, asked_points, marks, space = shipped()
            best = Best(len(own), k)
            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                number = batch.column("list").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(number)]
                for low, high in zip(cuts, cuts[1:], strict=False):
                    if low == high:
                        continue
                    probing = np.flatnonzero(marks[:, number[low]])
                    for at in range(low, high if len(probing) else low, 2048):
                        part = batch.slice(at, min(2048, high - at))
                        scan_list(
                            best, space, ids[at : at + part.num_rows],
                            matrix(part.column("vector"), dim),
                            matrix(part.column("turned"), dim + 1), own, asked, asked_points,
                            probing, epsilon)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[best.query]), pa.array(best.ids), pa.array(best.score)],
                names=["query_id", "vec_id", "score"])

        parts.append(index.mapInArrow(run, "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionAll, parts)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").filter(
        F.col("rank") <= k)
