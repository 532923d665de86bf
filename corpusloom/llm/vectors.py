"""Vector columns: which rows take part, their matrices, and running best-k lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, vector) of the rows that take part: an id, and a vector that is not null,
    not empty and without null or non-finite components (``nonzero``: not all zero)."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & fine)
    if nonzero:
        rows = rows.filter(F.exists("vector", lambda x: x != 0))
    return rows


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column in double precision; shorter vectors end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The k best (score, then smaller id) of each query among the rows offered so far."""

    def __init__(self, queries: int, k: int, kind=np.float64):
        self.k = k
        self.query = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.score = np.empty(0, kind)
        self.floor = np.full(queries, -np.inf)

    def offer(self, query, ids, score) -> None:
        query = np.concatenate([self.query, query])
        ids = np.concatenate([self.ids, ids])
        score = np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, query))
        query = query[order]
        first = np.concatenate([[True], query[1:] != query[:-1]])
        rank = np.arange(len(query)) - np.maximum.accumulate(
            np.where(first, np.arange(len(query)), 0))
        kept = rank < self.k
        self.query, self.ids, self.score = query[kept], ids[order][kept], score[order][kept]
        full = rank == self.k - 1
        self.floor[query[full]] = score[order][full]
