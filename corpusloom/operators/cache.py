"""Semantic cache: earlier questions that a new one nearly repeats, found exactly.

Past questions are stored by cell (nearest centre), with the range of angles that a cell's
vectors have to its centre. Angles obey the triangle inequality, so with t the angle of the
threshold, a new question at angle a to a cell's centre has a partner in the cell only if

* a is within t of the cell's range of angles, and
* a is at most the angle to its own nearest centre plus 2t (the partner is in the cell of
  *its* nearest centre).

A lookup scans only the cells that pass for some question of a block, in place, and meets a
question with the vectors of its own cells only; no pair that reaches the threshold is lost.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import vectors
from corpusloom.operators import retrieval
from corpusloom.session import materialize

THRESHOLD = 0.95  # cosine
SLACK = 2e-6  # scores are rounded to six decimals


@dataclass
class SemanticCache:
    """A stored cache: its folder, the cell centres, and each cell's least and largest angle."""

    path: str
    centres: np.ndarray
    nearest: np.ndarray
    farthest: np.ndarray


def _as_chunks(past: DataFrame) -> DataFrame:
    empty = F.lit("")
    return past.select(F.col("query_id").alias("chunk_id"), empty.alias("source_file"),
                       empty.alias("content_type"), F.col("vector").alias("embedding"))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _opened(spark, path: str, centres: np.ndarray) -> SemanticCache:
    """The cache in a folder with the angles its cells have now: one row per cell."""
    unit = np.nan_to_num(centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300))
    middle = spark.createDataFrame(
        [(i, row.tolist()) for i, row in enumerate(unit)], "cell int, centre array<double>")
    cosine = vectors.cosine(F.col("embedding"), F.col("centre"))
    spans = spark.read.parquet(path).join(F.broadcast(middle), "cell").groupBy("cell").agg(
        F.max(cosine).alias("near"), F.min(cosine).alias("far")).collect()
    nearest, farthest = np.full(len(unit), np.inf), np.full(len(unit), -np.inf)
    for row in spans:
        if row["near"] is not None:
            nearest[row["cell"]] = _angles(row["near"])
            farthest[row["cell"]] = _angles(row["far"])
    return SemanticCache(path, unit, nearest, farthest)


def build_cache(past: DataFrame, path: str) -> SemanticCache:
    """Store ``past`` (query_id, vector) by cell; vectors that are NULL are left out."""
    chunks = _as_chunks(past)
    centres = retrieval.train_cells(chunks, retrieval.cell_count(chunks.count()))
    retrieval.write_index(chunks, centres, path)
    return _opened(past.sparkSession, path, centres)


def add_to_cache(cache: SemanticCache, answered: DataFrame) -> SemanticCache:
    """The cache with the questions ``answered`` (query_id, vector) added to their cells."""
    rows = retrieval.assign_cells(_as_chunks(answered), cache.centres)
    rows.repartition("cell").write.mode("append").partitionBy("cell").parquet(cache.path)
    return _opened(answered.sparkSession, cache.path, cache.centres)


def cells_within(cache: SemanticCache, points: np.ndarray, threshold: float) -> np.ndarray:
    """Marks (question, cell): cells that may hold a partner of the unit vector."""
    reach = math.acos(max(-1.0, threshold - SLACK)) + 1e-9
    angle = _angles(points @ cache.centres.T)
    own = angle.min(axis=1, keepdims=True)
    return (
        (angle <= own + 2 * reach)
        & (angle >= cache.nearest[None, :] - reach)
        & (angle <= cache.farthest[None, :] + reach)
    )


def cache_lookup(cache: SemanticCache, new: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(query_id, cached_id, score, hit)``, one row for each of ``new`` (query_id, vector).

    ``cached_id`` is the past question with the highest cosine similarity, if that is
    ``threshold`` or more (``score`` is (1 + cosine) / 2, ties go to the smaller id); else
    it is NULL and the question has to be answered. NULL and zero vectors hit nothing.
    """
    spark = new.sparkSession
    questions = materialize(retrieval._as_questions(new, 1), "asked")
    index = spark.read.parquet(cache.path)
    parts = []
    for table in retrieval._blocks(questions, retrieval.QUESTION_BLOCK):
        dim = cache.centres.shape[1]
        points = table.column("vector").fill_null([0.0] * dim).combine_chunks()
        marks = cells_within(cache, np.nan_to_num(retrieval._matrix(points)), threshold)
        probed = np.flatnonzero(marks.any(axis=0)).tolist()
        if probed:
            rows = index.where(F.col("cell").isin(probed))
            parts.append(retrieval._scan(
                table, rows.select("chunk_id", "source_file", "content_type", "embedding", "cell"),
                marks))
    found = retrieval._merged(parts, questions, 1).where(
        F.col("score") >= round((1 + threshold) / 2, 6))
    return new.select("query_id").join(
        found.select("query_id", F.col("chunk_id").alias("cached_id"), "score"), "query_id", "left"
    ).withColumn("hit", F.col("cached_id").isNotNull())
