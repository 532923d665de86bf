"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

1. A document's set: its distinct shingles of ``words`` words. Documents with equal sets are
   one node (a hash of the set), so exact copies cost nothing further.
2. Each set gets a sketch of ``BANDS`` x ``ROWS`` coordinates by rounds of hashed bin
   placement (``linking.fast_sketch``), cut in bands. At a similarity of 0.8 two sets share
   no band with probability (1 - 0.8**6)**32, about 6 in 100,000.
3. Bands make buckets, buckets candidates, candidates are compared on full sets, links give
   components (``linking``).

Only nodes and band keys are shuffled, and the texts of nodes that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.linking import (
    BUCKET_SCHEMA,
    band_keys,
    bucket_batch,
    fast_sketch,
    link,
    memberships,
    passes,
    wanted_filter,
)
from corpusloom.llm.textops import (
    U64,
    Scanner,
    distinct,
    longs,
    mix,
    shingle_hashes,
    ship,
    sums,
    text_slices,
)
from corpusloom.session import materialize

BANDS, ROWS = 32, 6
PERCENT = 80


def _sets(scanner: Scanner, data, offsets, words: int):
    """(distinct shingles, offsets, node of each set); node 0 of an empty set."""
    values, bounds = distinct(*shingle_hashes(*scanner.words(data, offsets), words))
    node = mix(sums(mix(values, 21), bounds) ^ mix(sums(mix(values, 22), bounds), 23), 24)
    return values, bounds, np.where(np.diff(bounds) > 0, node, U64(0))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node, n_shingles and band keys of each document (no bands: empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                values, bounds, node = _sets(scanner, data, offsets, words)
                n = np.diff(bounds)
                keys = band_keys(fast_sketch(values, bounds, BANDS * ROWS), BANDS, ROWS)
                full = np.where(n > 0, BANDS, 0)
                edges = np.concatenate([[0], np.cumsum(full)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), longs(node),
                     pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(edges), longs(keys[n > 0].ravel()))],
                    names=["doc_id", "node", "n_shingles", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, node long, n_shingles long, bands array<long>")


def _bucket_rows(signed: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = batch.column("bands").flatten().to_numpy().view(U64)
                yield bucket_batch(batch.column("node").to_numpy(), keys.reshape(-1, BANDS))

    return signed.filter("n_shingles > 0").select("node", "bands").mapInArrow(run, BUCKET_SCHEMA)


def _node_texts(docs: DataFrame, nodes: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """node, text for the given nodes, one document each.

    ``ids``: doc_id, the documents that stand for them. Fixed-size filters let nearly all
    other documents go before the shuffle.
    """
    near_ids = ship(docs.sparkSession, wanted_filter(ids.select(F.xxhash64("doc_id").alias("node"))))
    near_nodes = ship(docs.sparkSession, wanted_filter(nodes))
    rows = docs.select(F.xxhash64("doc_id").alias("key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, of_ids, of_nodes = Scanner(), near_ids(), near_nodes()
        for batch in batches:
            kept = passes(of_ids, batch.column("key").to_numpy())
            column = batch.column("text").filter(pa.array(kept))
            for low, high, data, offsets in text_slices(column):
                node = _sets(scanner, data, offsets, words)[2]
                good = passes(of_nodes, node)
                yield pa.RecordBatch.from_arrays(
                    [longs(node[good]), column.slice(low, high - low).filter(pa.array(good))],
                    names=["node", "text"])

    found = rows.mapInArrow(run, "node long, text string")
    return found.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = PERCENT,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document.

    Documents are linked when ``percent`` % of the union of their shingle sets is common;
    ``component_id`` is the smallest id that links lead to, ``kept`` whether it is the
    document's own. A text with fewer words than a shingle has is one shingle; null, empty
    and blank texts have none and stay alone. Rows that share an id share their decision if
    their texts are linked; a null id takes part, and stands for itself only where no
    document of its component has an id. Sets are compared by 52-bit shingle hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(rows, words), "signatures")
    members = materialize(memberships(_bucket_rows(signed)), "buckets")
    nodes = materialize(
        members.select("node").unionAll(members.select(F.col("hub").alias("node"))).distinct(),
        "nodes")
    ids = signed.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"))
    texts = materialize(_node_texts(rows, nodes, ids, words), "node-texts")

    def to_sets(scanner, data, offsets):
        return shingle_hashes(*scanner.words(data, offsets), words)

    labels = link(members, texts, to_sets, percent)
    named = signed.filter("n_shingles > 0").select("doc_id", "node", "n_shingles").join(
        labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = signed.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    found = named.join(least, "component").select("doc_id", "n_shingles", "component_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.unionAll(alone).withColumn("kept", kept)
