"""N-gram Jaccard join of documents by signature trees.

Sets. A document's distinct word shingles; documents with equal sets are one leaf. A leaf has
its size and a bitmap of its shingles, about four bits per shingle.

Forest. Two sets that are similar enough and of sizes in one range differ in at most D
shingles, so if shingles are dealt by hash to more than D parts, some part is the same in
both. Every part of a set, with its whole contents, is the root of a tree over the leaves
that have exactly it (see ``parts``). Leaves are in the order of their least hash, which
puts similar sets side by side; a node above them holds the OR of its children's bitmaps,
the range of their sizes, the most shingles that a bitmap of its leaves hides, and the
component of its leaves if they share one.

Join. Each tree is first met by its smallest leaf alone, then two copies of the tree are
traversed together from the roots down. A pair of nodes is dropped if the bits they share
allow no pair below them the overlap that their smallest sizes ask for, or if all their
leaves are in one component already. Pairs of leaves that are left are compared exactly, on
whole texts, and links give components. In the first rounds of this each leaf keeps the pair
whose bits allow the largest overlap, which connects most of a large group; the last round
keeps all pairs, of which few are then left between components.

No link is lost: similar sets share a root, and a dropped pair of nodes has no link that
isn't implied by others. What is shuffled: a row per part of each leaf (about one for three
shingles at a similarity of 0.85), bitmaps of leaves that share a root, and texts of
candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import near
from corpusloom.llm.linking import BUCKET_SCHEMA, components, memberships, verify
from corpusloom.llm.textops import (
    U64,
    Scanner,
    distinct,
    longs,
    mix,
    shingle_hashes,
    text_slices,
)
from corpusloom.session import materialize

RANGE = 1.5  # largest to smallest size of the sets that share a number of parts
FANOUT = 8
BITS, COARSE = 4, 1  # bits per shingle of the bitmaps, rounded up to a power of two
ROUNDS = (True, True, False)  # whether a leaf keeps its closest pair only
FRONTIER = 1 << 18  # pairs of nodes that a traversal holds at once
CHUNK, PART = 1024, 4096  # leaves of the two sides that a task's call holds of a tree
CALL_BYTES = 1 << 20
WORDS = 1 << 21  # 64-bit words of bitmaps that are compared at once


# ------------------------------------------------------------------ sets and bitmaps


def bitmaps(values: np.ndarray, bounds: np.ndarray, per: int):
    """(bytes, offsets): a bitmap of each set, ``per`` bits a shingle or more, 64 at least."""
    sizes = np.diff(bounds)
    width = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(per * sizes, 1))).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(width)])
    marks = np.zeros(edges[-1], bool)
    row = np.repeat(np.arange(len(sizes)), sizes)
    marks[edges[row] + (values.astype(np.int64) & (width[row] - 1))] = True
    return np.packbits(marks, bitorder="little"), edges // 8


def folded(data: np.ndarray, offsets: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The bitmaps of ``rows`` as 64-bit words, folded to ``width`` bits (theirs at most)."""
    out = np.empty((len(rows), width // 64), U64)
    sizes = offsets[rows + 1] - offsets[rows]
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        block = data[offsets[rows[at]][:, None] + np.arange(size)].view(U64)
        while block.shape[1] * 64 > width:
            half = block.shape[1] // 2
            block = block[:, :half] | block[:, half:]
        out[at] = block
    return out


def _bytes_of(column: pa.Array):
    """(bytes, offsets) of a binary column."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def leaves(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, node, n_shingles, low (least hash), coarse and bits of each document's set."""

    def binary(data, edges):
        return pa.Array.from_buffers(
            pa.large_binary(), len(edges) - 1,
            [None, pa.py_buffer(edges), pa.py_buffer(data)]).cast(pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch.column("text")):
                values, bounds, node = near._sets(scanner, data, offsets, words)
                n = np.diff(bounds)
                least = np.zeros(len(n), np.int64)  # values of a set are in order
                least[n > 0] = values[bounds[:-1][n > 0]].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(low, high - low), longs(node),
                     pa.array(n.astype(np.int64)), pa.array(least),
                     binary(*bitmaps(values, bounds, COARSE)),
                     binary(*bitmaps(values, bounds, BITS))],
                    names=["doc_id", "node", "n_shingles", "low", "coarse", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"doc_id {kind}, node long, n_shingles long, low long, coarse binary, bits binary")


def size_ranges(percent: int):
    """(largest size, differences, parts) of each range of sizes, up to any size.

    Two similar sets of which the smaller is in a range have at most ``differences``
    shingles that are in one of them only. There are more parts than that by a margin, as
    parts without a shingle are no roots. Sets of the first range have no similar ones.
    """
    high = [(percent - 1) // (100 - percent) if percent < 100 else 1 << 41]
    while high[-1] < 1 << 40:
        high.append(int(high[-1] * max(RANGE, 105 / percent)) + 1)
    high = np.array(high)
    differences = high * (100 - percent) // percent
    return high, differences, differences + 1 + 2 + differences // 10


def parts(values: np.ndarray, bounds: np.ndarray, percent: int):
    """(root, row): the roots of each set, as hashes.

    A set takes part in the range of its size, and in the one below if it may be similar to
    a set there. If it leaves more parts empty than the margin allows, two such sets might
    agree on empty parts only: these have their least hashes as roots besides, of which
    similar sets share one of the first n - ceil(percent * n / 100) + 1.
    """
    high, differences, number = size_ranges(percent)
    n = np.diff(bounds)
    home = np.searchsorted(high, n)
    found, rows = [np.empty(0, U64)], [np.empty(0, np.int64)]
    lower = np.maximum(home - 1, 0)
    for level, good in ((home, home > 0),
                        (lower, (lower > 0) & (percent * n <= 100 * high[lower]))):
        sets = np.flatnonzero(good)
        if not len(sets):
            continue
        count = number[level[sets]]
        edge = np.concatenate([[0], np.cumsum(count)])
        own = np.repeat(good, n)
        value = values[own]
        row = np.repeat(np.arange(len(sets)), n[sets])
        at = edge[row] + (mix(value.copy(), 41) % count[row].astype(U64)).astype(np.int64)
        total = np.zeros(edge[-1], U64)
        np.add.at(total, at, mix(value.copy(), 42))
        held = np.bincount(at, minlength=edge[-1]) > 0
        owner = np.repeat(np.arange(len(sets)), count)
        place = np.arange(edge[-1]) - edge[owner]
        salt = (level[sets][owner] << 41) + place
        found.append(mix(total[held] + mix(salt[held].astype(U64), 43), 44))
        rows.append(sets[owner[held]])
        empty = count - np.bincount(owner[held], minlength=len(sets))
        sparse = empty > count - 1 - differences[level[sets]]
        first = n[sets] - (percent * n[sets] + 99) // 100 + 1
        start = np.cumsum(n[sets]) - n[sets]
        taken = sparse[row] & (np.arange(len(value)) - start[row] < first[row])
        found.append(mix(value[taken] + mix(level[sets][row[taken]].astype(U64), 45), 46))
        rows.append(sets[row[taken]])
    return np.concatenate(found), np.concatenate(rows)


def roots(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Rows of ``BUCKET_SCHEMA``: each leaf under its roots.

    In a batch the leaves of a root are combined to the smallest, which alone is dealt by
    the root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            bands, nodes = [np.empty(0, U64)], [np.empty(0, np.int64)]
            for _, _, data, offsets in text_slices(batch.column("text")):
                values, bounds, node = near._sets(scanner, data, offsets, words)
                root, row = parts(values, bounds, percent)
                bands.append(root)
                nodes.append(node.view(np.int64)[row])
            band, node = np.concatenate(bands), np.concatenate(nodes)
            order = np.lexsort((node, band))
            band, node = band[order], node[order]
            new = np.ones(len(band), bool)
            new[1:] = (band[1:] != band[:-1]) | (node[1:] != node[:-1])
            band, node = band[new], node[new]
            head = np.ones(len(band), bool)
            head[1:] = band[1:] != band[:-1]
            hub = node[np.maximum.accumulate(np.where(head, np.arange(len(band)), 0))]
            deal = np.where(head, band, mix(node.view(U64), 9))
            yield pa.RecordBatch.from_arrays(
                [longs(deal), longs(band), pa.array(node), pa.array(hub, mask=head)],
                names=["deal", "band", "node", "hub"])

    return docs.select("text").mapInArrow(run, BUCKET_SCHEMA)


# ------------------------------------------------------------------ trees


def spare(shared, size_a, size_b, hidden_a, hidden_b, percent: int) -> np.ndarray:
    """How far ``shared`` bits allow more than the overlap that sets of these sizes need.

    A set has at most (shingles that its bitmap hides) + (its bits that the other has too)
    shingles in common with the other. Below 0 there can be no link.
    """
    overlap = shared + np.minimum(hidden_a, hidden_b)
    return ((100 + percent) * overlap) / np.maximum(size_a + size_b, 1) - percent


class Forest:
    """Signature trees over leaves that are sorted by tree; every tree has the same depth."""

    def __init__(self, tree, sizes, bits, labels, depth: int):
        hidden = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(tree, sizes, sizes, hidden, bits, labels, None)]
        for _ in range(depth):
            tree, low, high, hidden, bits, labels, _ = self.levels[-1]
            head = np.ones(len(tree), bool)
            head[1:] = tree[1:] != tree[:-1]
            at = np.arange(len(tree))
            inside = at - np.maximum.accumulate(np.where(head, at, 0))
            first = np.flatnonzero(inside % FANOUT == 0)
            same = np.minimum.reduceat(labels, first) == np.maximum.reduceat(labels, first)
            self.levels.append((
                tree[first], np.minimum.reduceat(low, first), np.maximum.reduceat(high, first),
                np.maximum.reduceat(hidden, first), np.bitwise_or.reduceat(bits, first, axis=0),
                np.where(same, labels[first], -1),  # -1: of several components
                np.append(first, len(tree))))

    @staticmethod
    def depth_of(tree: np.ndarray) -> int:
        most = int(np.unique(tree, return_counts=True)[1].max(initial=1))
        return math.ceil(math.log(most, FANOUT) - 1e-9) if most > 1 else 0

    def _open(self, other: Forest, level: int, a, b, percent: int):
        """(a, b, spare) of those pairs of nodes that may hold a new link."""
        _, low_a, high_a, hidden_a, bits_a, label_a, _ = self.levels[level]
        _, low_b, high_b, hidden_b, bits_b, label_b, _ = other.levels[level]
        good = (label_a[a] != label_b[b]) | (label_a[a] < 0)
        good &= (100 * high_a[a] >= percent * low_b[b]) & (100 * high_b[b] >= percent * low_a[a])
        a, b = a[good], b[good]
        room = np.empty(len(a))
        step = max(1, WORDS // bits_a.shape[1])
        for start in range(0, len(a), step):
            x, y = a[start : start + step], b[start : start + step]
            shared = np.bitwise_count(bits_a[x] & bits_b[y]).sum(axis=1, dtype=np.int64)
            room[start : start + step] = spare(
                shared, low_a[x], low_b[y], hidden_a[x], hidden_b[y], percent)
        good = room >= -1e-6
        return a[good], b[good], room[good]

    def traverse(self, other: Forest, percent: int) -> Iterator[tuple]:
        """(a, b, spare): pairs of leaves of the same tree that may be linked and are not
        yet, in portions; branches are followed in turn, so few pairs are open at a time."""
        top, top_other = self.levels[-1][0], other.levels[-1][0]
        a = np.flatnonzero(np.isin(top, top_other))
        open_ = [(len(self.levels) - 1, a, np.searchsorted(top_other, top[a]))]
        while open_:
            level, a, b = open_.pop()
            a, b, room = self._open(other, level, a, b, percent)
            if not len(a):
                continue
            if not level:
                yield a, b, room
                continue
            below_a, below_b = self.levels[level][6], other.levels[level][6]
            n_a, n_b = below_a[a + 1] - below_a[a], below_b[b + 1] - below_b[b]
            n = n_a * n_b
            if len(a) > 1 and n.sum() > FRONTIER:
                half = len(a) // 2
                open_ += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide = np.repeat(n_b, n)
            open_.append((level - 1, np.repeat(below_a[a], n) + at // wide,
                          np.repeat(below_b[b], n) + at % wide))


def _leaf_pairs(pairs: DataFrame, table: DataFrame, column: str, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that sizes and the bitmaps ``column`` of ``table`` allow."""
    rows = pairs
    for side in ("a", "b"):
        rows = rows.join(table.select(
            F.col("node").alias(side), F.col("size").alias(f"size_{side}")), side)
    rows = rows.filter(F.expr(
        f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"))
    for side in ("a", "b"):
        rows = rows.join(table.select(
            F.col("node").alias(side), F.col(column).alias(f"bits_{side}")), side)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size_a, size_b = (batch.column(c).to_numpy() for c in ("size_a", "size_b"))
            (data_a, edge_a), (data_b, edge_b) = (
                _bytes_of(batch.column(c)) for c in ("bits_a", "bits_b"))
            width = 8 * np.minimum(np.diff(edge_a), np.diff(edge_b))
            good = np.zeros(batch.num_rows, bool)
            for w in np.unique(width):
                found = np.flatnonzero(width == w)
                step = max(1, 64 * WORDS // int(w))
                for start in range(0, len(found), step):
                    at = found[start : start + step]
                    x, y = folded(data_a, edge_a, at, w), folded(data_b, edge_b, at, w)
                    hidden = [s[at] - np.bitwise_count(v).sum(axis=1, dtype=np.int64)
                              for s, v in ((size_a, x), (size_b, y))]
                    shared = np.bitwise_count(x & y).sum(axis=1, dtype=np.int64)
                    good[at] = spare(
                        shared, size_a[at], size_b[at], *hidden, percent) >= -1e-6
            yield pa.RecordBatch.from_arrays(
                [batch.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _tree_pairs(named: DataFrame, table: DataFrame, percent: int, closest: bool) -> DataFrame:
    """(a, b): pairs of leaves that share a root, are in different components and that the
    traversal of their tree leaves over; ``closest``: of each leaf its best pair only.

    ``named``: band, node, component; ``table``: node, size, low, bits. Leaves outside a
    tree's main component meet all its leaves of other components. A tree is also cut by
    size: a leaf meets those in its own or the next class of sizes, so similar ones surely.
    Large trees are dealt in chunks times parts of bounded size; small ones share a call.
    """
    parts = named.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    most = F.max(F.struct("n", "component"))
    main = parts.groupBy("band").agg(
        most["component"].alias("main"), (F.sum("n") - most["n"]).alias("strays"),
        F.sum("n").alias("all")).select(
        "band", "main", F.ceil(F.col("strays") / CHUNK).alias("chunks"),
        F.ceil(F.col("all") / PART).alias("parts"))
    rows = named.join(main, "band").join(table, "node").withColumn(
        "class", F.floor(F.log("size") / (math.log(100 / percent) * 1.0001)).cast("long"))
    total = rows.agg(F.sum(F.octet_length("bits") + 64)).first()[0] or 0
    rows = rows.withColumn("call", F.pmod("band", F.lit(max(1, math.ceil(total / CALL_BYTES)))))

    def spread(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    key = F.xxhash64("node")
    columns = ["band", "class", "node", "component", "size", "low", "bits"]
    strays = rows.filter("component <> main").select(
        "call", F.pmod(key, "chunks").alias("chunk"), "parts", *columns).select(
        "call", "chunk", spread("parts").alias("part"), F.lit(True).alias("stray"), *columns)
    others = rows.select(
        "call", spread("chunks").alias("chunk"), F.pmod(key, "parts").alias("part"),
        F.lit(False).alias("stray"), *columns)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group["stray"].to_numpy()
        # those outside the main component are in the trees of three classes
        row = np.concatenate([np.arange(len(side)), *[np.flatnonzero(side)] * 2])
        step = np.repeat([0, -1, 1], [len(side), side.sum(), side.sum()])
        tree = mix(group["band"].to_numpy().view(U64)[row]
                   + (group["class"].to_numpy()[row] + step).astype(U64), 47)
        order = np.lexsort((group["node"].to_numpy()[row], group["low"].to_numpy()[row], tree))
        row = row[order]
        tree = np.unique(tree[order], return_inverse=True)[1]
        # components as numbers from 0, as a node of several ones is marked by -1
        label = np.unique(group["component"].to_numpy(), return_inverse=True)[1][row]
        stray, node, size = side[row], group["node"].to_numpy()[row], group["size"].to_numpy()[row]
        data, edges = _bytes_of(group["bits"].combine_chunks())
        first = np.flatnonzero(np.diff(tree, prepend=-1))
        width = 8 * np.minimum.reduceat(np.diff(edges)[row], first)[tree]
        out = [np.empty((0, 2), np.int64)]
        for w in np.unique(width):
            sides = [np.flatnonzero(x & (width == w)) for x in (stray, ~stray)]
            if not len(sides[0]) or not len(sides[1]):
                continue
            depth = max(Forest.depth_of(tree[at]) for at in sides)
            left, right = (
                Forest(tree[at], size[at], folded(data, edges, row[at], w), label[at], depth)
                for at in sides)
            best, partner = np.full(len(sides[0]), -1.0), np.zeros(len(sides[0]), np.int64)
            for a, b, room in left.traverse(right, percent):
                if closest:
                    order = np.lexsort((room, a))
                    last = order[np.append(np.diff(a[order]) != 0, True)]
                    last = last[room[last] > best[a[last]]]
                    best[a[last]], partner[a[last]] = room[last], sides[1][b[last]]
                else:
                    pairs = np.stack([node[sides[0][a]], node[sides[1][b]]], axis=1)
                    out.append(np.unique(np.sort(pairs, axis=1), axis=0))
            if closest:
                met = best > -1
                out.append(np.sort(np.stack(
                    [node[sides[0][met]], node[partner[met]]], axis=1), axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return strays.unionAll(others).groupBy("call", "chunk", "part").applyInArrow(
        run, "a long, b long").distinct()


# ------------------------------------------------------------------ join


def _compare(pairs: DataFrame, rows: DataFrame, signed: DataFrame, words: int,
             percent: int) -> DataFrame:
    """Those of the stored ``pairs`` (a, b) that are links, by their whole sets."""
    nodes = materialize(pairs.select(F.col("a").alias("node")).unionAll(
        pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    ids = signed.join(nodes, "node", "left_semi").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"))
    texts = near._node_texts(rows, nodes, ids, words)

    def to_sets(scanner, data, offsets):
        return shingle_hashes(*scanner.words(data, offsets), words)

    return materialize(
        verify(pairs, materialize(texts, "node-texts"), to_sets, percent), "linked")


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per document.

    Two documents are linked when at least ``percent`` % of the union of their sets of
    distinct shingles of ``words`` words is common; ``component_id`` is the smallest id that
    links lead to, the document's own included. A text with fewer words than a shingle has
    is one shingle; null, empty and blank texts have none and stay alone. Rows that share an
    id may be in different components; a null id takes part, and names a component only
    where no document of it has an id. Sets are compared by 52-bit shingle hashes.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(leaves(rows, words), "leaves")
    members = materialize(memberships(roots(rows, words, percent)).distinct(), "roots")
    nodes = members.select("node").unionAll(members.select(F.col("hub").alias("node"))).distinct()
    table = materialize(signed.join(nodes, "node", "left_semi").dropDuplicates(["node"]).select(
        "node", F.col("n_shingles").alias("size"), "low", "coarse", "bits"), "tree-leaves")

    # each tree against its smallest leaf
    pairs = members.select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    pairs = materialize(_leaf_pairs(pairs, table, "coarse", percent), "pairs")
    tested = materialize(_leaf_pairs(pairs, table, "bits", percent), "tested")
    labels = materialize(
        components(_compare(tested, rows, signed, words, percent)), "labels")

    # each tree against itself, where that can connect something more
    members = materialize(members.select("band", "node").unionAll(
        members.select("band", F.col("hub").alias("node"))).distinct(), "members")
    for closest in ROUNDS:
        named = members.join(labels, "node", "left").select(
            "band", "node", F.coalesce("component", "node").alias("component"))
        open_ = named.groupBy("band").agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"),
            F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).filter("n > 2 AND low <> high")  # trees of two are settled
        open_ = open_.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")
        named = materialize(named.join(open_, "band", "left_semi"), "members")
        found = _tree_pairs(named, table, percent, closest)
        new = materialize(found.join(tested, ["a", "b"], "left_anti"), "tested")
        if new.isEmpty():
            continue
        more = _compare(new, rows, signed, words, percent)
        old = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = materialize(components(old.unionAll(more)), "labels")
        tested = tested.unionAll(new)
        members = named.select("band", "node")

    own = signed.filter("n_shingles > 0").select("doc_id", "node", "n_shingles").join(
        labels, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component"))
    least = own.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    alone = signed.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.join(least, "component").select(
        "doc_id", "n_shingles", "component_id").unionAll(alone)
