"""Rankings made from rankings: fusion of keyword and vector hits, and diversity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_CONSTANT = 60
VECTOR_SHARE = 0.7
RELEVANCE = 70  # percent of the relevance in a pick's value, the rest is for novelty
UNIT = 1_000_000


def _joined(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """Hits of both searches side by side; what one search lacks is NULL."""
    sides = [
        hits.select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"),
                    F.col("rank").alias(f"{name}_rank"))
        for name, hits in (("vector", vector), ("keyword", keyword))
    ]
    return sides[0].join(sides[1], ["query_id", "chunk_id"], "full")


def _ranked(fused: DataFrame, score: Column, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("chunk_id"))
    return (
        fused.withColumn("score", score)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "chunk_id", "score", "rank", "vector_rank", "keyword_rank")
    )


def fuse_ranks(vector: DataFrame, keyword: DataFrame, k: int = 10,
               share: float = VECTOR_SHARE) -> DataFrame:
    """Reciprocal rank fusion: share / (60 + rank) of the vector hits plus the keyword hits'.

    A chunk that only one search found counts there alone. Ties go to the smaller id.
    """
    def part(weight: float, rank: str) -> Column:
        return F.coalesce(weight / (RANK_CONSTANT + F.col(rank)), F.lit(0.0))

    score = part(share, "vector_rank") + part(1 - share, "keyword_rank")
    return _ranked(_joined(vector, keyword), F.round(score, 9), k)


def fuse_scores(vector: DataFrame, keyword: DataFrame, k: int = 10,
                share: float = VECTOR_SHARE) -> DataFrame:
    """Weighted sum of both scores, each stretched to 0..1 among a question's hits.

    Where all hits of a search have one score, that is 1; a missing hit counts 0.
    """
    whole = Window.partitionBy("query_id")

    def part(weight: float, name: str) -> Column:
        score = F.col(name)
        low, high = F.min(name).over(whole), F.max(name).over(whole)
        stretched = F.when(high > low, (score - low) / (high - low)).otherwise(
            F.when(score.isNotNull(), 1.0))
        return F.coalesce(weight * stretched, F.lit(0.0))

    score = part(share, "vector_score") + part(1 - share, "keyword_score")
    return _ranked(_joined(vector, keyword), F.round(score, 6), k)


def mmr(hits: DataFrame, vectors: DataFrame, k: int = 10, relevance: int = RELEVANCE) -> DataFrame:
    """Maximal marginal relevance: ``(query_id, chunk_id, score, rank, position)``.

    From a question's ``hits`` (query_id, chunk_id, score, rank) ``k`` are picked one after
    the other: the largest ``relevance`` % of the score less the other % of the highest
    similarity to a chunk picked before, in whole millionths; ties go to the smaller id.
    A group holds a question's hits, as many as its search was asked for. Hits without a
    vector are like no other chunk.
    """
    rows = hits.join(vectors.select("chunk_id", "embedding"), "chunk_id", "left").select(
        "query_id", "chunk_id", "score", "rank",
        F.col("embedding").cast("array<double>").alias("embedding"))

    def pick(group: pa.Table) -> pa.Table:
        group = group.sort_by("chunk_id").combine_chunks()
        score = np.round(group["score"].to_numpy() * UNIT).astype(np.int64)
        vectors_ = group["embedding"].to_pylist()
        dim = max((len(v) for v in vectors_ if v), default=1)
        matrix = np.array([v if v else [0.0] * dim for v in vectors_])
        norm = np.linalg.norm(matrix, axis=1)
        unit = matrix / np.where(norm > 0, norm, 1)[:, None]
        like = np.round((1 + unit @ unit.T) / 2 * UNIT).astype(np.int64)
        like[norm == 0] = 0
        like[:, norm == 0] = 0
        nearest = np.zeros(len(score), np.int64)
        free = np.ones(len(score), bool)
        picked = []
        while free.any() and len(picked) < k:
            value = np.where(
                free, relevance * score - (100 - relevance) * nearest, np.iinfo(np.int64).min)
            best = int(value.argmax())  # the first, so the smallest id
            picked.append(best)
            free[best] = False
            nearest = np.maximum(nearest, like[best])
        out = group.select(["query_id", "chunk_id", "score", "rank"]).take(pa.array(picked))
        return out.append_column("position", pa.array(np.arange(1, len(picked) + 1), pa.int32()))

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("query_id", "chunk_id", "score", "rank"))
    return rows.groupBy("query_id").applyInArrow(pick, f"{schema}, position int")
