"""Hard negatives by threshold joins with suffix-norm bounds (in the manner of L2AP).

Every anchor has windows of scores. Its positives are the best rows of its own label: one
window without bounds. Each positive opens a window for negatives between two shares of the
positive's score. A window wants the highest ``k`` scores inside it.

A chunk of rows is indexed for a threshold t: columns are put in the order of their weight,
and a row's postings leave out its first columns as long as the norm of that part of the
row, times the norm of the same part of any anchor, stays below t. A row whose omitted part
is all of it can't reach t. The postings of a column block are traversed from the heaviest
block down; partial scores are summed up, and a pair goes as soon as its partial score plus
the product of the remaining norms is below the anchor's threshold. What is left is completed with
the omitted columns under the same test, so scores are exact.

Thresholds start near the top of a window and are lowered step by step, until the window is
full or its lower end is reached. A full window's k-th score is the lower end from then on.

The table is scanned in place, once for positives and once for negatives in each block of
anchors. A block has at most ``BLOCK_BYTES`` of vectors; only it is at the driver and in a
broadcast at a time, and a task returns at most k rows per window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import hash_blocks, lent, union
from corpusloom.llm.vectors import Best, matrix
from corpusloom.session import materialize

BLOCK_BYTES = 16 << 20
ANCHORS = 512  # anchors and rows that a task joins at once
ROWS = 4096
COLUMNS = 8  # columns per block of postings
#: Shares of the way from a window's top to its lower end at which thresholds stop.
STEPS = (0.1, 0.3, 0.6, 1.0)
#: Share of pairs still alive below which they are followed one by one.
SPARSE = 0.05


def column_norms(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The norm of the columns before each edge, row by row."""
    blocks = np.add.reduceat(values * values, edges[:-1], axis=1)
    return np.sqrt(np.column_stack([np.zeros(len(values)), np.cumsum(blocks, axis=1)]))


class Postings:
    """An inverted index of a chunk of rows, by column block, for thresholds given later."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort((rows * rows).sum(axis=0), kind="stable")
        self.rows = rows[:, self.order]
        self.edges = np.unique(np.append(np.arange(0, rows.shape[1], COLUMNS), rows.shape[1]))
        self.norms = column_norms(self.rows, self.edges)

    def reach(self, anchors: np.ndarray, least: np.ndarray):
        """(anchor, row, score) of all pairs whose score is at least the anchor's ``least``."""
        anchors = anchors[:, self.order]
        norms = column_norms(anchors, self.edges)
        least = least - 0.5 - 1e-9 * np.abs(least)  # scores are whole numbers
        lowest = least.min()
        # the number of leading blocks whose postings are left out; all of them: no posting
        omitted = (self.norms * norms.max(axis=0) < lowest).sum(axis=1) - 1
        omitted = np.maximum(omitted, 0)
        last = len(self.edges) - 1
        by_cut = np.argsort(omitted, kind="stable")
        by_cut = by_cut[omitted[by_cut] < last]
        omitted = omitted[by_cut]
        rows, row_norms = self.rows[by_cut], self.norms[by_cut]
        total = np.zeros((len(anchors), len(rows)))
        pending = []
        for block in range(last - 1, -1, -1):
            low, high = self.edges[block], self.edges[block + 1]
            held = int(np.searchsorted(omitted, block, "right"))  # rows with postings here
            if held < total.shape[1]:  # the postings of the others have ended
                pending.append(self._alive(
                    total, norms, row_norms, least, slice(held, total.shape[1]), block + 1))
                total = total[:, :held]
            if not held:
                break
            total = total + anchors[:, low:high] @ rows[:held, low:high].T
            pairs = self._alive(total, norms, row_norms, least, slice(0, held), block)
            if len(pairs[0]) <= SPARSE * total.size or not block:
                pending.append(pairs)
                break
        found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if pending:
            anchor, row, score, rest = (np.concatenate(x) for x in zip(*pending, strict=True))
            for block in range(last - 1, -1, -1):  # complete with the columns left
                low, high = self.edges[block], self.edges[block + 1]
                open_ = np.flatnonzero(rest > block)
                score[open_] += np.einsum(
                    "ij,ij->i", anchors[anchor[open_], low:high], rows[row[open_], low:high])
                bound = score + np.where(
                    rest > block, norms[anchor, block] * row_norms[row, block], np.inf)
                kept = bound >= least[anchor]
                anchor, row, score, rest = anchor[kept], row[kept], score[kept], rest[kept]
            good = score >= least[anchor]
            found = [anchor[good], by_cut[row[good]], score[good]]
        return found

    @staticmethod
    def _alive(total, norms, row_norms, least, part, block):
        """(anchor, row, partial score, open blocks) of pairs that may still reach ``least``."""
        bound = total[:, part] + norms[:, block, None] * row_norms[None, part, block]
        anchor, row = np.nonzero(bound >= least[:, None])
        row = row + part.start
        return anchor, row, total[anchor, row], np.full(len(row), block)


class Windows:
    """``per`` windows of scores for each of some anchors, and the best rows of each so far."""

    def __init__(self, ids, labels, vectors, low, high, per: int, k: int, same: bool):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.low, self.high = low, high  # by window: anchor * per + number
        self.per, self.same = per, same
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.best = Best(len(low), k)

    def offer(self, index: Postings, ids: np.ndarray, labels: np.ndarray) -> None:
        """Lower thresholds over a chunk until every window is full or at its lower end."""
        reach = np.repeat(self.norms * index.norms[:, -1].max(initial=0), self.per) + 1
        top = np.minimum(self.high, reach)
        before = np.full(len(top), np.inf)
        for step in STEPS:
            bottom = np.maximum(np.maximum(self.low, -reach), self.best.floor)
            # a window that is full above the last threshold takes nothing below it
            going = (bottom <= top) & (self.best.floor < before)
            least = np.minimum(np.ceil(top - step * (top - bottom)), before)
            least = np.where(going, least, np.inf)
            by_anchor = least.reshape(-1, self.per).min(axis=1)
            asked = np.flatnonzero(np.isfinite(by_anchor))
            if not len(asked):
                return
            anchor, row, score = index.reach(self.vectors[asked], by_anchor[asked])
            anchor = asked[anchor]
            good = (labels[row] == self.labels[anchor]) == self.same
            good &= ids[row] != self.ids[anchor]
            anchor, row, score = anchor[good], row[good], score[good]
            window = (anchor[:, None] * self.per + np.arange(self.per)).ravel()
            row, score = np.repeat(row, self.per), np.repeat(score, self.per)
            new = (score >= least[window]) & (score < before[window]) & (score <= self.high[window])
            if new.any():
                self.best.offer(window[new], ids[row[new]], score[new])
            before = np.where(going, least, before)


def _fill(rows: DataFrame, shipped, dim: int, scale: int, k: int, name: str) -> DataFrame:
    """The best ``k`` rows of each window of the shipped block: window, vec_id, score, rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped()
        parts = [(at, Windows(*(x[at : at + ANCHORS] for x in asked[:3]),
                              *(x[at * asked[5] : (at + ANCHORS) * asked[5]] for x in asked[3:5]),
                              *asked[5:]))
                 for at in range(0, len(asked[0]), ANCHORS)]
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            labels = batch.column("label").to_numpy()
            for at in range(0, len(ids), ROWS):
                vectors = matrix(batch.column("vector").slice(at, ROWS), dim)
                index = Postings(np.floor(scale * vectors))
                for _, windows in parts:
                    windows.offer(index, ids[at : at + ROWS], labels[at : at + ROWS])
        for at, windows in parts:
            best = windows.best
            yield pa.RecordBatch.from_arrays(
                [pa.array(best.query + at * windows.per), pa.array(best.ids),
                 pa.array(best.score.astype(np.int64))], names=["window", "vec_id", "score"])

    found = rows.mapInArrow(run, "window long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "vec_id"))
    return materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k), name)


def participants(vectors: DataFrame, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, vector) of rows with an id, a label and a vector of finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                          F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda x: F.coalesce(
        ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                       & (F.size("vector") > 0) & fine)


SCHEMA = ("anchor_id long, positive_id long, rank int, negative_id long, "
          "positive_score long, negative_score long")


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id",
                   label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``; components become
    floor(scale * x); scores are inner products with the anchor, exact below 2**53; higher
    ones come first, then smaller ids. An anchor's positives are its best other rows of the
    same label; for each, the best rows of another label between ``low`` and ``high`` %
    of the positive's score (a negative score allows none) are its negatives.

    Null ids and labels and vectors that are null, empty or hold null or non-finite
    components take no part; labels are whole numbers; shorter vectors end in zeros. Rows
    that share the anchor's id are not among its positives and negatives; of a repeated
    anchor id the row with the smallest label, then vector, is the anchor. Repeated rows count
    as often as they come; so a positive that comes twice has its negatives twice.
    """
    spark = vectors.sparkSession
    rows = participants(vectors, id_col, label_col, vector_col)
    dim = rows.agg(F.max(F.size("vector"))).first()[0]
    if not dim:
        return spark.createDataFrame([], SCHEMA)
    anchors = materialize(
        rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id")
        .agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*"), "anchors")
    parts = []
    for block in hash_blocks(anchors, "vec_id", anchors.count() * dim * 8, BLOCK_BYTES):
        table = block.toArrow().combine_chunks()
        if not table.num_rows:
            continue
        ids, labels = table["vec_id"].to_numpy(), table["label"].to_numpy()
        asked = np.floor(scale * matrix(table["vector"].combine_chunks(), dim))
        endless = np.full(len(ids), np.inf)
        with lent(spark, (ids, labels, asked, -endless, endless, 1, positives, True)) as shipped:
            near = _fill(rows, shipped, dim, scale, positives, "positives").toArrow()
        window = near["window"].to_numpy() * positives + near["rank"].to_numpy() - 1
        score = near["score"].to_numpy()
        least, most = np.full(len(ids) * positives, np.inf), np.full(len(ids) * positives, -np.inf)
        least[window], most[window] = -((-low * score) // 100), high * score // 100
        with lent(spark, (ids, labels, asked, least, most, positives, negatives, False)) as shipped:
            found = _fill(rows, shipped, dim, scale, negatives, "negatives")
        opened = spark.createDataFrame(pa.table({
            "window": window, "anchor_id": ids[near["window"].to_numpy()],
            "positive_id": near["vec_id"], "positive_score": near["score"]}))
        parts.append(found.join(opened, "window").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
            F.col("vec_id").alias("negative_id"), "positive_score",
            F.col("score").alias("negative_score")))
    return union(spark, parts, SCHEMA)
