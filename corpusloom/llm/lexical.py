"""Ranked lexical search, hybrid: accumulators for short lists, skipping over long ones.

Index. Whole documents are dealt into shards of bounded size as they are scanned; a shard
has one row with its documents (term null) and one row per term with its posting list. It
is a stored table: shard, term, n_docs, at, tf, ids, sizes. Nothing is shuffled to build it.

Search. The terms of a block of items pick their lists; the lists of a shard come together
in one task. There an item's lists are taken in two ways. The *short* ones (term at a time)
are summed up into accumulators; these are one more, bounded iterator: blocks of documents
with the highest accumulated score of each. The *long* ones are traversed document at a time
together with that iterator: a block of documents is skipped if its highest accumulator and
the block maxima of the long lists can't bring a document among the item's best, and inside a
block a long list is probed, largest bound first, only for documents that the rest of the
lists keep competitive. Nothing that could reach the k-th score is left out.

A shard returns at most k documents per item. Items are taken in blocks of about
``BLOCK_TERMS`` terms; the terms of one block at a time are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.blocks import hash_blocks, lent, union
from corpusloom.llm.textops import Scanner, text_slices
from corpusloom.session import materialize

#: Terms for Spark's and DuckDB's regular expressions, after A-Z have become lower case.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 15
BLOCK_TERMS = 1 << 17
BLOCK = 64  # documents per block of block maxima
STRETCH = 16  # blocks that are traversed at once
SHORT = 8  # a list of at most one in SHORT documents of its shard is short
INDEX = ("shard long, term string, n_docs int, at array<int>, tf array<int>, "
         "ids array<long>, sizes array<long>")


def term_bytes() -> np.ndarray:
    solid = np.zeros(256, bool)
    for low, high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
        solid[low : high + 1] = True
    return solid


class Shard:
    """Collects the postings of documents until it is written."""

    def __init__(self, scanner: Scanner, solid: np.ndarray):
        self.scanner, self.solid = scanner, solid
        self.ids, self.sizes, self.parts, self.spellings = [], [], [], []
        self.docs = self.bytes = 0

    def add(self, ids: pa.Array, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends, bounds = self.scanner.spans(data, offsets, self.solid)
        hashes = self.scanner.hashes(data, starts, ends)
        sizes = np.diff(bounds)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((hashes, doc))
        hashes, doc = hashes[order], doc[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        tf = np.diff(np.append(first, len(hashes)))
        self.parts.append((hashes[first], doc[first] + self.docs, tf))
        # one spelling of each term of the slice
        known, at = np.unique(hashes, return_index=True)
        at = order[at]
        length = ends[at] - starts[at]
        edge = np.concatenate([[0], np.cumsum(length)])
        take = np.arange(edge[-1]) + np.repeat(starts[at] - edge[:-1], length)
        self.spellings.append((known, self.scanner.lower[data[take]], length))
        self.ids.append(ids)
        self.sizes.append(sizes.astype(np.int64))
        self.docs += len(sizes)
        self.bytes += len(data)

    def rows(self, number: int) -> pa.RecordBatch:
        """The rows of the index: the documents in the order of their ids, null last."""
        ids = pa.concat_arrays(self.ids)
        order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc = place[doc]
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        known, edges = np.unique(term, return_index=True)
        edges = np.append(edges, len(term))
        spelt, letters, lengths = (np.concatenate(x) for x in zip(*self.spellings, strict=True))
        found, at = np.unique(spelt, return_index=True)
        ends = np.cumsum(lengths)
        starts, lengths = (ends - lengths)[at], lengths[at]
        edge = np.concatenate([[0], np.cumsum(lengths)])
        take = np.arange(edge[-1]) + np.repeat(starts - edge[:-1], lengths)
        names = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(found),
            [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(letters[take])])
        names = names.cast(pa.large_string()).cast(pa.string())
        one = pa.nulls(1, pa.string())
        n = len(known)

        def lists(values):
            return pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], edges]).astype(np.int32)),
                pa.array(values.astype(np.int32)))

        def single(values):
            return pa.concat_arrays([
                pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values),
                pa.nulls(n, pa.list_(pa.int64()))])

        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n + 1, number)), pa.concat_arrays([one, names]),
             pa.array(np.append(len(order), np.diff(edges)).astype(np.int32)),
             lists(doc), lists(tf), single(ids.take(pa.array(order))),
             single(pa.array(np.concatenate(self.sizes)[order]))],
            names=["shard", "term", "n_docs", "at", "tf", "ids", "sizes"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all rows of ``docs`` (see above); ids are whole numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, solid = Scanner(), term_bytes()
        number = TaskContext.get().partitionId() << 32
        shard = Shard(scanner, solid)
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                shard.add(batch.column("doc_id").slice(low, high - low), data, offsets)
                if shard.bytes >= SHARD_BYTES or shard.docs >= SHARD_DOCS:
                    yield shard.rows(number)
                    number, shard = number + 1, Shard(scanner, solid)
        if shard.docs:
            yield shard.rows(number)

    return materialize(rows.mapInArrow(run, INDEX), "lexical-index")


class Lists:
    """The scored posting lists of a shard, and the block maxima of the long ones."""

    def __init__(self, table: pa.Table, terms: dict, total_docs: int, total_terms: int):
        table = table.combine_chunks()
        own = table.filter(pc.is_null(table["term"]))
        self.ids = own["ids"].combine_chunks().flatten()
        sizes = own["sizes"].combine_chunks().flatten().to_numpy()
        self.docs = len(sizes)
        if 25 * int(sizes.max(initial=0)) * total_docs < 1 << 63:
            grown = 25 * sizes * total_docs // max(total_terms, 1)
        else:
            grown = np.array([25 * int(n) * total_docs // max(total_terms, 1) for n in sizes])
        length = 12 * (75 + grown)
        lists = table.filter(pc.is_valid(table["term"]))
        self.place: dict[int, int] = {}  # term number: its list
        self.at, self.score, self.top, self.maxima = [], [], [], []
        at, tf = lists["at"].combine_chunks(), lists["tf"].combine_chunks()
        edges = at.offsets.to_numpy() - (at.offsets[0].as_py() if len(at) else 0)
        at, tf = at.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
        impact = 1_000_000_000 * tf // (1000 * tf + length[at])
        names = lists["term"].to_pylist()
        for i, name in enumerate(names):
            number, weight = terms[name]
            low, high = edges[i], edges[i + 1]
            score = weight * impact[low:high]
            self.place[number] = len(self.at)
            self.at.append(at[low:high])
            self.score.append(score)
            self.top.append(int(score.max()))
            self.maxima.append(self._block_maxima(at[low:high], score) if self.is_long(
                high - low) else None)

    def is_long(self, length: int) -> bool:
        return length * SHORT > self.docs

    def _block_maxima(self, at, score) -> np.ndarray:
        out = np.zeros(-(-self.docs // BLOCK), np.int64)
        np.maximum.at(out, at // BLOCK, score)
        return out

    def best(self, numbers: np.ndarray, times: np.ndarray, k: int):
        """(places, scores) of the k best documents for terms with their repeats."""
        found = [(self.place[n], t) for n, t in zip(numbers.tolist(), times.tolist(), strict=True)
                 if n in self.place]
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        short = [(i, t) for i, t in found if self.maxima[i] is None]
        long_ = sorted(((i, t) for i, t in found if self.maxima[i] is not None),
                       key=lambda x: -self.top[x[0]] * x[1])
        sums = np.zeros(self.docs, np.int64)  # term at a time
        for i, t in short:
            sums[self.at[i]] += t * self.score[i]
        if not long_:
            place = np.flatnonzero(sums)
            return self._cut(place, sums[place], k)
        # the accumulators as one iterator with bounds, beside the long lists
        bounds = np.maximum.reduceat(sums, np.arange(0, self.docs, BLOCK))
        floor = int(np.partition(sums, -k)[-k]) if self.docs >= k else 0
        rest = np.zeros((len(long_) + 1, len(bounds)), np.int64)  # of the lists from i on
        for j in range(len(long_) - 1, -1, -1):
            i, t = long_[j]
            rest[j] = rest[j + 1] + t * self.maxima[i]
        bounds = bounds + rest[0]
        places, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(bounds), STRETCH):
            blocks = np.arange(start, min(start + STRETCH, len(bounds)))
            blocks = blocks[(bounds[blocks] >= floor) & (bounds[blocks] > 0)]
            if not len(blocks):
                continue  # skipped in all lists
            doc = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            doc = doc[doc < self.docs]
            score = sums[doc]
            for j, (i, t) in enumerate(long_):
                open_ = score + rest[j, doc // BLOCK]
                kept = (open_ >= floor) & (open_ > 0)
                doc, score = doc[kept], score[kept]
                if not len(doc):
                    break
                hit = np.searchsorted(self.at[i], doc)
                there = hit < len(self.at[i])
                there[there] = self.at[i][hit[there]] == doc[there]
                score = score + np.where(
                    there, t * self.score[i][np.where(there, hit, 0)], 0)
            kept = (score >= floor) & (score > 0)
            places, scores = self._cut(
                np.append(places, doc[kept]), np.append(scores, score[kept]), k)
            if len(places) == k:
                floor = max(floor, int(scores[-1]))
        return places, scores

    @staticmethod
    def _cut(places, scores, k):
        order = np.lexsort((places, -scores))[:k]
        return places[order], scores[order]


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term, times: the terms of each item; rows that share an id are one item."""
    lowered = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(lowered, F.lit(TERM_PATTERN), F.lit(0))
    return items.select(F.col(id_col).cast("long").alias("item_id"), F.explode(found).alias(
        "term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times"))


SCHEMA = "item_id long, rank int, doc_id long, score long"


def _ranked(index: DataFrame, wanted: DataFrame, shipped, k: int) -> DataFrame:
    """The best ``k`` documents of each item of the shipped block, shard by shard."""

    def run(group: pa.Table) -> pa.Table:
        terms, number, times, edges, names, docs, words = shipped()
        lists = Lists(group, terms, docs, words)
        places, scores, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        for low, high in zip(edges, edges[1:], strict=False):
            place, score = lists.best(number[low:high], times[low:high], k)
            places.append(place)
            scores.append(score)
            sizes.append(len(place))
        return pa.table({
            "item_id": names.take(pa.array(np.repeat(np.arange(len(names)), sizes))),
            "doc_id": lists.ids.take(pa.array(np.concatenate(places))),
            "score": np.concatenate(scores)})

    nothing = F.lit(None).cast("array<long>")
    mine = index.join(F.broadcast(wanted), "term", "left_semi").select(
        "shard", "term", "at", "tf", nothing.alias("ids"), nothing.alias("sizes"))
    shards = index.filter("term IS NULL").select("shard", "term", "at", "tf", "ids", "sizes")
    found = mine.unionAll(shards).groupBy("shard").applyInArrow(
        run, "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(
        F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = found.select("item_id", rank.alias("rank"), "doc_id", "score")
    return materialize(ranked.filter(F.col("rank") <= k), "ranked")


def search(index: DataFrame, items: DataFrame, k: int = 20, id_col: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``k`` best documents of a stored index.

    Scores and ties are those of ``ranked_search``. Counts of documents and terms are those
    of the whole index.
    """
    spark = index.sparkSession
    asked = materialize(item_terms(items, id_col, text_col), "item-terms")
    docs, words = index.filter("term IS NULL").select(
        F.explode("sizes").alias("n")).filter("n > 0").agg(
        F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = []
    for block in hash_blocks(asked, "item_id", asked.count(), BLOCK_TERMS):
        wanted = F.broadcast(block.select("term").distinct())  # at most a block's terms
        df = index.join(wanted, "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
        table = block.join(df, "term").orderBy("item_id").toArrow()
        if not table.num_rows:
            continue
        terms, weights = {}, []
        for term, n in zip(table["term"].to_pylist(), table["df"].to_pylist(), strict=True):
            terms.setdefault(
                term, (len(terms), math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1)))))
        number = np.array([terms[t][0] for t in table["term"].to_pylist()])
        items_of = table["item_id"].combine_chunks()
        runs = pc.rank(items_of, tiebreaker="dense").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(runs)) + 1, [len(runs)]])
        names = items_of.take(pa.array(edges[:-1]))
        times = table["times"].to_numpy()
        with lent(spark, (terms, number, times, edges, names, docs, words)) as shipped:
            parts.append(_ranked(index, block.select("term").distinct(), shipped, k))
    return union(spark, parts, SCHEMA)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents for each item's text.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower case. The
    score of a document sums w * ((10**9 * tf) div (1000 * tf + 12 * m)) over the item's
    terms with their repeats; w = floor(1000 * ln((2N + 2) / (2df + 1))) and m = 75 +
    ((25 * n * N) div L), with N documents that have a term, L terms in them, n terms in the
    document. Documents with a score of 0 are not returned.

    Null and empty texts have no terms: such documents are never found, such items find
    nothing. Equal scores rank by id, a null id last. Rows that share a document id are
    documents of their own, rows that share an item id are one item, null ids included.
    """
    return search(build_index(docs), items, k)
