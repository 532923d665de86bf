"""Filtered top-k nearest-neighbour search of a question table against a chunk table.

Exact search never builds the question x chunk product as rows and never moves a chunk
vector. Questions come in blocks of ``QUESTION_BLOCK`` rows, whatever their number; one
block at a time is shipped to the tasks, which scan the chunk table in place, multiply
their Arrow batches with the block and keep k rows per question. Those meet in two levels,
so that one question's rows of many tasks are first reduced in several places.

The approximate search does the same on an index stored by cell: a block reads the cells
that its questions probe, and each question is multiplied with its own cells only.

Filters are applied before ranking, thresholds after it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text, vectors
from corpusloom.session import materialize

# Fixed values.
DEFAULT_TOP_K = 10
SCORE_FLOOR = 0.3
TYPED_TOP_K = 5

QUESTION_BLOCK = 4096  # questions shipped at once: some MB of vectors
SCORE_CELLS = 1_000_000  # scores held at once in one task, in several copies
BATCH_VALUES = 4_000_000  # values of chunk vectors held at once in one task, in several copies
FIRST_ROWS = 32  # rows that first meet questions which have no k hits yet
WAITING_HITS = 10_000  # hits that wait to be ranked in a task
GRID_BLOCK = 64  # questions multiplied at once by knn_grid
PUSHED_VALUES = 1000  # filter values handed to the scan; more are filtered in the tasks
RANK_PARTS = 16
TERM_HITS = 500  # passages whose terms a task counts
MOST_CELLS = 4096

_HIT_SCHEMA = "query_id string, chunk_id string, score double"
_ARROW_HITS = pa.schema(
    [("query_id", pa.string()), ("chunk_id", pa.string()), ("score", pa.float64())]
)


# --------------------------------------------------------------------------- kernel


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a non-null list column; rejects mixed dimensions."""
    lengths = np.unique(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    if len(lengths) > 1:
        raise ValueError(f"vectors of mixed dimension: {lengths.tolist()}")
    dim = int(lengths[0]) if len(lengths) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(column), dim)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return matrix / norms


def _texts(table: pa.Table, name: str) -> np.ndarray:
    return np.array(table.column(name).fill_null("").to_pylist(), dtype=str)


class _Batch:
    """Chunk rows as one task holds them, in the order of their ids: of equal scores the
    earlier row is the better one."""

    def __init__(self, chunks: pa.Table, filters: dict):
        chunks = chunks.take(pa.compute.sort_indices(chunks.column("chunk_id").fill_null("None")))
        self.ids = chunks.column("chunk_id")
        self.matrix = _matrix(chunks.column("embedding").combine_chunks())
        self.small = self.matrix.astype(np.float32)
        self.have = {
            column: pa.compute.index_in(chunks.column(column).combine_chunks(), value_set=values)
            .fill_null(-2).to_numpy(zero_copy_only=False)
            for column, (values, _) in filters.items()}
        self.cell = chunks.column("cell").to_numpy() if "cell" in chunks.column_names else None
        self._texts: np.ndarray | None = None

    def texts(self) -> np.ndarray:
        if self._texts is None:
            self._texts = np.array(self.ids.to_pylist(), dtype=str)
        return self._texts


def _groups(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and where it stands, in order."""
    order = np.argsort(values, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(values[order])) + 1).tolist(), len(order)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        if high > low:
            yield int(values[order[low]]), order[low:high]


class _Questions:
    """The question side of one task: ids, unit vectors, optional filters and cells.

    ``cells`` (questions x cells, bool) marks the cells that a question probes; without it
    every question meets every chunk. Questions of equal vector and filters, as the queries
    of several tasks are, are scored once, and those of a source meet its chunks only.

    Products are taken in single precision first: what stays below a question's k-th score
    by more than their error is no hit, and only the others are scored.
    """

    def __init__(self, table: pa.Table, k: int, cells: np.ndarray | None = None,
                 step: int | None = None):
        valid = pa.compute.is_valid(table.column("vector"))
        table = table.filter(valid)
        self.ids = _texts(table, "query_id")
        vectors = _matrix(table.column("vector").combine_chunks())
        cells = None if cells is None else cells[valid.to_numpy()]
        self.filters = {}
        parts = [] if cells is None else [np.packbits(cells, axis=1)]
        for column, name in (("source_file", "filter_source"), ("content_type", "filter_type")):
            wanted = _texts(table, name)
            values = np.unique(wanted[wanted != ""])
            if len(values):  # each question's filter as a number, -1 for none
                code = np.where(wanted == "", -1, np.searchsorted(values, wanted))
                self.filters[column] = (pa.array(values.tolist(), pa.string()), code)
                parts.append(code.astype(np.int64)[:, None].view(np.uint8))
        first = self.asks = np.arange(len(self.ids))
        if vectors.size:
            parts.append(np.ascontiguousarray(vectors).view(np.uint8))
            rows = np.ascontiguousarray(np.concatenate(parts, axis=1))
            _, first, self.asks = np.unique(
                rows.view(np.dtype((np.void, rows.shape[1]))).ravel(), return_index=True,
                return_inverse=True)
        self.vectors = vectors[first]
        self.small = self.vectors.astype(np.float32)
        self.cells = None if cells is None else cells[first]
        self.filters = {c: (values, code[first]) for c, (values, code) in self.filters.items()}
        self.k = k
        self.step = step or max(1, len(first))
        self.best = (
            np.empty(0, dtype=np.int64),
            np.empty(0, dtype=np.float64),
            np.empty(0, dtype="U1"),
        )
        self.waiting: list[tuple[np.ndarray, ...]] = []
        self.n_waiting = 0
        self.cut = np.full(len(first), -np.inf)
        self.last = np.full(len(first), "", dtype="U1")  # id of the k-th hit
        self.met = np.zeros(len(first), np.int64)  # chunks met so far
        self.slack = 2e-6 + (vectors.shape[1] + 8) * 2.0 ** -23  # of single precision products

    def offer(self, chunks: pa.Table) -> None:
        chunks = chunks.filter(pa.compute.is_valid(chunks.column("embedding")))
        if chunks.num_rows == 0 or len(self.vectors) == 0:
            return
        rows = max(1, BATCH_VALUES // max(1, self.vectors.shape[1]))
        for at in range(0, chunks.num_rows, rows):
            batch = _Batch(chunks.slice(at, rows), self.filters)
            if batch.matrix.shape[1] != self.vectors.shape[1]:
                raise ValueError("question and chunk vectors differ in dimension")
            if batch.cell is None:
                self._route(batch, np.arange(len(batch.matrix)), np.arange(len(self.vectors)))
                continue
            for cell, of_cell in _groups(batch.cell):
                self._route(batch, of_cell, np.flatnonzero(self.cells[:, cell]))

    def _route(self, batch: _Batch, rows: np.ndarray, asked: np.ndarray) -> None:
        """Chunks meet the questions without a source and those of their own source."""
        if "source_file" not in self.filters:
            self._offer_rows(batch, rows, asked)
            return
        code = self.filters["source_file"][1][asked]
        self._offer_rows(batch, rows, asked[code < 0])
        of_source = {value: asked[at] for value, at in _groups(code) if value >= 0}
        for value, at in _groups(batch.have["source_file"][rows]):
            if value in of_source:
                self._offer_rows(batch, rows[at], of_source[value])

    def _offer_rows(self, batch: _Batch, rows: np.ndarray, asked: np.ndarray) -> None:
        for first in range(0, len(asked), self.step):
            some = asked[first : first + self.step]
            most = max(1, SCORE_CELLS // len(some))
            at = 0
            while at < len(rows):  # few at first and as many as before then, to know what to beat
                size = min(most, max(self.k, FIRST_ROWS, int(self.met[some].min())))
                part = rows[at : at + size]
                self._offer_part(batch, part, some)
                if size < most or self.n_waiting > max(WAITING_HITS, len(self.best[0]) // 2):
                    self._settle()
                self.met[some] += len(part)
                at += len(part)

    def _offer_part(self, batch: _Batch, rows: np.ndarray, asked: np.ndarray) -> None:
        low = 2 * self.cut[asked] - 1 - self.slack
        exact = None
        if np.isneginf(low).any():
            exact = batch.matrix[rows] @ self.vectors[asked].T
            near = exact >= low
        else:
            near = batch.small[rows] @ self.small[asked].T >= low.astype(np.float32)
        if "content_type" in self.filters:
            code = self.filters["content_type"][1][asked]
            near &= (code < 0)[None, :] | (
                batch.have["content_type"][rows][:, None] == code[None, :])
        cell = np.flatnonzero(near)
        if len(cell) == 0:
            return
        row, at = np.divmod(cell, len(asked))
        if exact is None and len(row) * self.vectors.shape[1] > SCORE_CELLS:
            exact = batch.matrix[rows] @ self.vectors[asked].T
        row, question = rows[row], asked[at]
        if exact is None:
            value = np.einsum("ij,ij->i", batch.matrix[row], self.vectors[question])
        else:
            value = exact.ravel()[cell]
        score = np.round((1.0 + value) / 2.0, 6)
        keep = score > self.cut[question]
        ties = np.flatnonzero(score == self.cut[question])
        if len(ties):  # a tie counts if its id is smaller than that of the k-th hit
            tied, which = np.unique(question[ties], return_inverse=True)
            before = np.searchsorted(batch.texts(), self.last[tied], side="left")
            keep[ties] = row[ties] < before[which]
        row, question, score = row[keep], question[keep], score[keep]
        order = np.lexsort((row, -score, question))
        row, question, score = row[order], question[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(question, question, side="left") < self.k
        row, question, score = row[best], question[best], score[best]
        if len(row) == 0:
            return
        ids = np.array(batch.ids.take(pa.array(row)).to_pylist(), dtype=str)
        self.waiting.append((question, score, ids))
        self.n_waiting += len(row)

    def _settle(self) -> None:
        """The k best of the hits held and those that wait."""
        if not self.waiting:
            return
        parts = [self.best, *self.waiting]
        question, score, chunk_id = (np.concatenate(c) for c in zip(*parts, strict=True))
        self.waiting, self.n_waiting = [], 0
        order = np.lexsort((-score, question))
        same = (np.diff(question[order]) == 0) & (np.diff(score[order]) == 0)
        tied = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
        of_tied = order[tied]  # only these are told apart by their ids
        order[tied] = of_tied[np.lexsort((chunk_id[of_tied], -score[of_tied], question[of_tied]))]
        question, score, chunk_id = question[order], score[order], chunk_id[order]
        first = np.searchsorted(question, question, side="left")
        place = np.arange(len(question)) - first
        keep = place < self.k
        self.best = (question[keep], score[keep], chunk_id[keep])
        full = place == self.k - 1
        self.cut[question[full]] = score[full]
        self.last = self.last.astype(np.promote_types(self.last.dtype, chunk_id.dtype))
        self.last[question[full]] = chunk_id[full]

    def hits(self) -> pa.Table:
        self._settle()
        asked, score, chunk_id = self.best
        order = np.argsort(self.asks, kind="stable")  # all questions that ask the same
        low, high = (np.searchsorted(self.asks[order], asked, side=s) for s in ("left", "right"))
        hit = np.repeat(np.arange(len(asked)), high - low)
        at = np.arange(len(hit)) - np.repeat(np.cumsum(high - low) - high, high - low)
        question = order[at]
        return pa.table(
            [
                pa.array(self.ids[question].tolist(), pa.string()),
                pa.array(chunk_id[hit].tolist(), pa.string()),
                pa.array(score[hit], pa.float64()),
            ],
            schema=_ARROW_HITS,
        )


# ----------------------------------------------------------------------- query side


def _as_questions(queries: DataFrame, k: int) -> DataFrame:
    """Uniform question columns; missing filters and per-question k get defaults."""
    have = queries.columns

    def optional(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    per_query_k = F.col("k") if "k" in have else F.lit(None).cast("int")
    return queries.select(
        "query_id",
        F.col("vector").cast("array<double>").alias("vector"),
        optional("filter_source").alias("filter_source"),
        optional("filter_type").alias("filter_type"),
        F.coalesce(F.nullif(per_query_k, F.lit(0)), F.lit(k)).alias("k"),
    )


def _blocks(questions: DataFrame, rows: int) -> Iterator[pa.Table]:
    """A stored question table in hash blocks of about ``rows``, one at a time."""
    count = max(1, math.ceil(questions.count() / rows))
    number = F.pmod(F.xxhash64("query_id"), F.lit(count))
    for block in range(count):
        table = questions.where(number == block).toArrow()
        if table.num_rows:
            yield table


def _rank(hits: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """The best of all tasks' rows: first within parts of a question's rows, then of those."""
    order = [F.desc("score"), F.asc("chunk_id")]
    part = F.pmod(F.xxhash64("chunk_id"), F.lit(RANK_PARTS))
    parts = Window.partitionBy("query_id", "_part").orderBy(*order)
    first = hits.withColumn("_part", part).withColumn("_n", F.row_number().over(parts)).where(
        F.col("_n") <= k)
    whole = Window.partitionBy("query_id").orderBy(*order)
    ranked = first.drop("_part", "_n").withColumn("rank", F.row_number().over(whole)).where(
        F.col("rank") <= k)
    limits = questions.select("query_id", "k")
    return ranked.join(limits, "query_id").where(F.col("rank") <= F.col("k")).drop("k")


def _chunk_columns(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "source_file", "content_type", "embedding")


def knn_exact(queries: DataFrame, chunks: DataFrame, k: int | None = None,
              block_rows: int = QUESTION_BLOCK, step: int | None = None) -> DataFrame:
    """The k best chunks per question: ``(query_id, chunk_id, score, rank)``.

    ``queries`` has ``query_id, vector`` and optionally ``filter_source``,
    ``filter_type`` (empty or NULL means no filter) and ``k`` per question. ``chunks``
    has ``chunk_id, source_file, content_type, embedding``; NULL embeddings are skipped.
    Scores are rounded to six decimals and ties go to the smaller chunk id. A task multiplies
    ``step`` questions of a block at once, or the whole block.
    """
    questions = materialize(_as_questions(queries, k or DEFAULT_TOP_K), "asked")
    parts = [
        _scan(table, _chunk_columns(_narrow(chunks, table)), step=step)
        for table in _blocks(questions, block_rows)
    ]
    return _merged(parts, questions, k or DEFAULT_TOP_K)


def _merged(parts: list[DataFrame], questions: DataFrame, k: int) -> DataFrame:
    if not parts:
        return questions.sparkSession.createDataFrame([], f"{_HIT_SCHEMA}, rank int")
    top = questions.agg(F.max("k")).first()[0]
    return _rank(reduce(DataFrame.unionAll, parts), questions, int(top or k))


def _scan(table: pa.Table, chunks: DataFrame, cells: np.ndarray | None = None,
          step: int | None = None) -> DataFrame:
    """Every task's best rows for a block of questions; the chunk table is read in place."""
    top = max(table.column("k").to_pylist())
    shipped = chunks.sparkSession.sparkContext.broadcast((table, cells))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cells = shipped.value
        questions = _Questions(table, top, cells, step)
        for batch in batches:
            questions.offer(pa.Table.from_batches([batch]))
        yield from questions.hits().to_batches()

    return chunks.mapInArrow(scan, _HIT_SCHEMA)


def _narrow(chunks: DataFrame, table: pa.Table) -> DataFrame:
    """Push a filter into the chunk scan where every question of the block has one."""
    for column, wanted in (("source_file", "filter_source"), ("content_type", "filter_type")):
        values = set(table.column(wanted).fill_null("").to_pylist())
        if "" not in values and len(values) <= PUSHED_VALUES:
            chunks = chunks.where(F.col(column).isin(sorted(values)))
    return chunks


def knn_grid(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """``knn_exact`` in many small question blocks, which the tasks cut from those shipped.

    The chunk table is read once per shipped block, not once per small one.
    """
    return knn_exact(queries, chunks, k, step=GRID_BLOCK)


# ---------------------------------------------------------------------- approximate


def train_cells(chunks: DataFrame, n_cells: int, seed: int = 7, iterations: int = 5) -> np.ndarray:
    """Cell centres learned with ``pyspark.ml`` over the unit vectors of the whole table.

    On unit vectors the Euclidean and the cosine order agree; zero vectors have no
    direction and take no part.
    """
    unit = chunks.select(vectors.l2_normalize(F.col("embedding")).alias("unit")).where(
        F.col("unit").isNotNull()
    )
    model = KMeans(k=n_cells, seed=seed, maxIter=iterations, initMode="random").fit(
        unit.select(array_to_vector("unit").alias("features"))
    )
    return np.array(model.clusterCenters())


def _nearest_cells(points: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.nan_to_num(centres / np.linalg.norm(centres, axis=1, keepdims=True))
    return np.argsort(-(points @ unit.T), axis=1, kind="stable")[:, :n]


def assign_cells(chunks: DataFrame, centres: np.ndarray) -> DataFrame:
    """The rows of the approximate index: chunk vectors with the number of their cell.

    Store them with ``write_index`` once and search them many times.
    """
    shipped = chunks.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell(column_values: pd.Series) -> pd.Series:
        matrix = np.stack([np.asarray(v, dtype=np.float64) for v in column_values])
        return pd.Series(_nearest_cells(matrix, shipped.value, 1)[:, 0].astype(np.int32))

    rows = _chunk_columns(chunks).where(F.col("embedding").isNotNull())
    return rows.withColumn("cell", cell("embedding"))


def write_index(chunks: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Store the index by cell and read it back; a crowded cell has several files."""
    rows = assign_cells(chunks, centres).withColumn("_part", F.xxhash64("chunk_id"))
    rows.repartitionByRange("cell", "_part").drop("_part").write.mode("overwrite").partitionBy(
        "cell").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def cell_count(rows: int) -> int:
    """As many cells as rows in a cell, within ``MOST_CELLS``."""
    return min(MOST_CELLS, max(1, round(math.sqrt(rows))))


def knn_ann(
    queries: DataFrame,
    index: DataFrame,
    centres: np.ndarray,
    probes: int = 4,
    k: int | None = None,
    block_rows: int = QUESTION_BLOCK,
) -> DataFrame:
    """Approximate top-k: each question looks into its ``probes`` nearest cells only.

    ``index`` is the stored result of ``write_index``. It is scanned in place: a block of
    questions reads the cells that one of them probes, and a crowded cell is read by as
    many tasks as its files need.
    """
    questions = materialize(_as_questions(queries, k or DEFAULT_TOP_K), "asked")
    parts = []
    for table in _blocks(questions, block_rows):
        points = table.column("vector").fill_null([0.0] * centres.shape[1]).combine_chunks()
        near = _nearest_cells(np.nan_to_num(_matrix(points)), centres, min(probes, len(centres)))
        cells = np.zeros((table.num_rows, len(centres)), bool)
        np.put_along_axis(cells, near, True, axis=1)
        probed = np.flatnonzero(cells.any(axis=0)).tolist()
        rows = index if len(probed) == len(centres) else index.where(F.col("cell").isin(probed))
        parts.append(_scan(
            table, rows.select("chunk_id", "source_file", "content_type", "embedding", "cell"),
            cells))
    return _merged(parts, questions, k or DEFAULT_TOP_K)


# ------------------------------------------------------------- thresholds, typed search


def apply_threshold(hits: DataFrame, threshold: Column | float | None = None) -> DataFrame:
    """Keep hits at or above max(0.3, threshold); runs after top-k and keeps ranks.

    A NULL threshold and one of zero or less add nothing to the floor.
    """
    wanted = threshold if isinstance(threshold, Column) else F.lit(threshold).cast("double")
    return hits.where(
        F.col("score") >= F.greatest(F.lit(SCORE_FLOOR), F.coalesce(wanted, F.lit(0.0)))
    )


def retrieve(queries: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """Filtered top-k, store floor, then the question's ``similarity_threshold`` if any."""
    hits = knn_exact(queries, chunks, k)
    if "similarity_threshold" not in queries.columns:
        return apply_threshold(hits)
    wanted = queries.select("query_id", F.col("similarity_threshold").alias("_t"))
    return apply_threshold(hits.join(wanted, "query_id"), F.col("_t")).drop("_t")


def typed_search(
    queries: DataFrame, chunks: DataFrame, content_type: str, k: int = TYPED_TOP_K
) -> DataFrame:
    """Top-k within one content type; the constant filter is pushed into the scan."""
    return apply_threshold(
        knn_exact(
            queries.withColumn("filter_type", F.lit("")),
            chunks.where(F.col("content_type") == content_type),
            k,
        )
    )


def typed_search_with_fallback(
    queries: DataFrame, chunks: DataFrame, k: int = TYPED_TOP_K
) -> DataFrame:
    """Typed search; questions without a single hit are asked again without the type.

    The source filter stays on in the second round.
    """
    typed = materialize(
        apply_threshold(knn_exact(queries, chunks, k)).withColumn("fallback", F.lit(False)),
        "typed-hits",
    )
    unanswered = queries.join(typed.select("query_id").distinct(), "query_id", "left_anti")
    again = apply_threshold(
        knn_exact(unanswered.withColumn("filter_type", F.lit("")), chunks, k)
    ).withColumn("fallback", F.lit(True))
    return typed.unionByName(again)


def attach_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Join chunk columns to ranked hits; a hit without a row there keeps NULLs.

    The chunk table is first cut to the ids of the hits, which Spark does by a broadcast
    where they are few, so what meets the hits is as small as they are. ``hits`` is used
    twice: store it first where it is expensive.
    """
    ids = hits.select("chunk_id").distinct()
    needed = chunks.drop("embedding").join(ids, "chunk_id", "left_semi")
    return hits.join(needed, "chunk_id", "left")


# ------------------------------------------------------------------- multi-query merges


def multi_query_dedup(hits: DataFrame, group: str = "task_id") -> DataFrame:
    """Union of a task's query results; the first query to bring a chunk keeps its score.

    ``hits`` has ``query_no`` and ``rank`` besides the group and chunk columns. The
    result is renumbered by (query_no, rank) in ``position``.
    """
    first = Window.partitionBy(group, "chunk_id").orderBy("query_no", "rank")
    order = Window.partitionBy(group).orderBy("query_no", "rank")
    return (
        hits.withColumn("_seen", F.row_number().over(first))
        .where(F.col("_seen") == 1)
        .drop("_seen")
        .withColumn("position", F.row_number().over(order))
    )


def recommend_sources(hits: DataFrame) -> DataFrame:
    """Per question: source files by best score, then hit count, with their sections."""
    per_source = hits.groupBy("query_id", "source_file").agg(
        F.max("score").alias("best_score"),
        F.count("*").alias("n_hits"),
        F.array_join(
            F.array_sort(
                F.collect_set(F.when(F.col("section_heading") != "", F.col("section_heading")))
            ),
            ", ",
        ).alias("sections"),
    )
    order = Window.partitionBy("query_id").orderBy(
        F.desc("best_score"), F.desc("n_hits"), F.asc("source_file")
    )
    return per_source.withColumn("source_rank", F.row_number().over(order))


def source_coverage(hits: DataFrame) -> DataFrame:
    """How many sources, pages and sections a question's hits spread over."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("n_hits"),
        F.count_distinct("source_file").alias("n_sources"),
        F.count_distinct("source_file", "page_number").alias("n_pages"),
        F.count_distinct("source_file", "section_heading").alias("n_sections"),
    )


def trend_terms(hits: DataFrame, top: int = 20, min_letters: int = 4) -> DataFrame:
    """Terms of the hit passages by the number of source files that use them.

    A task's hits are dealt to one of as many tasks as there are ``TERM_HITS`` hits, so the
    terms that a task counts stay few and don't move. ``hits`` is used twice: store it first.
    """
    parts = max(1, math.ceil(hits.count() / TERM_HITS))
    terms = hits.select(
        "task_id", "source_file",
        F.array_distinct(text.letters_only_words(F.col("content"))).alias("_terms"),
    ).repartition(parts, "task_id").select(
        "task_id", "source_file", F.explode("_terms").alias("term")
    ).where(F.length("term") >= min_letters)
    counted = (
        terms.groupBy("task_id", "term", "source_file")
        .agg(F.count("*").alias("n"))
        .groupBy("task_id", "term")
        .agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_passages"))
    )
    order = Window.partitionBy("task_id").orderBy(
        F.desc("n_sources"), F.desc("n_passages"), F.asc("term")
    )
    return counted.withColumn("term_rank", F.row_number().over(order)).where(
        F.col("term_rank") <= top
    )


def paper_preview(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """First three chunks of each requested paper as one labelled text."""
    wanted = requests.select(text.strip(F.col("source_file")).alias("source_file")).distinct()
    body = (
        chunks.where(F.col("chunk_index").isin(0, 1, 2))
        .groupBy("source_file")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("chunk_index", "content"))),
                    lambda c: F.concat(
                        F.lit("--- [Chunk "), c["chunk_index"], F.lit("] ---\n"),
                        F.coalesce(c["content"], F.lit("")), F.lit("\n\n"),
                    ),
                ),
                "",
            ).alias("_body")
        )
    )
    # The two texts.
    return wanted.join(body, "source_file", "left").select(
        "source_file",
        F.when(
            F.col("_body").isNotNull(),
            F.concat(
                F.lit("Preview of top sections in '"), "source_file", F.lit("':\n\n"), "_body"
            ),
        )
        .otherwise(
            F.concat(F.lit("No preview available for paper '"), "source_file", F.lit("'."))
        )
        .alias("preview"),
    )
