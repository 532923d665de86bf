"""From band keys to components of near-equal items, without pairs of a whole bucket.

Items with equal content are one *node* (a 64-bit hash of the content) before anything else.
Nodes that share a band key are a bucket. In a batch of a task a bucket is combined to its
smallest node, the hub, so a bucket that holds a third of all rows reaches the shuffle as
one row per batch; after it the same is done over the batches.

A bucket can be thinned before anything is stored: rows that carry the bits of their sketch
(``sketch_bits``) are compared by these, each with all others of its bucket, and those that
are far from all leave (``near_memberships``).

Verification. Each member is compared with its hub, exactly, on whole contents; links form
components. Where a bucket still spans several components, the members outside its main
component are compared with all members of other components. That happens inside tasks, on
chunks of bounded size, and only links leave them: no candidate is given up, and no pairs
are made as rows. Copies of one text link with their hub, so what is left is small unless a
bucket holds many texts that are alike but below the threshold.

Components. Alternating large-star and small-star steps on an edge table, each step a join
with grouped minima; every round is written to the shared folder, so lineage stays short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.textops import FULL, U64, Scanner, distinct, longs, mix, text_slices
from corpusloom.session import materialize

CHUNK_SETS, CHUNK_BYTES = 256, 1 << 20
PART_SETS, PART_BYTES = 2048, 4 << 20
MATCHES = 1 << 22  # common elements that a task lists at once
FILTER_BITS = 24  # size of the filter of wanted nodes: 2 MB, whatever the data
BUCKET_SCHEMA = "deal long, band long, node long, hub long"
SKETCH_SCHEMA = "deal long, band long, node long, bits long, hub long"
LEADS = 62  # the bit of a node that others of its batch are combined to
NEAR_BITS = 18  # of 60 sketch bits, as many may differ: at a similarity of 0.8 more do once in 10^6
THINNED = 1 << 13  # larger buckets are kept whole


# ------------------------------------------------------------------ signatures


def fast_sketch(values: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Similarity sketch of each set: a row of ``size`` coordinates.

    ``values`` are hashes of the elements. In round i every element is placed in one hashed bin with a value of that round, and a
    bin keeps the least; from round ``size`` on all elements go to bin i - ``size``. A set
    leaves when its bins are full, so each coordinate is filled for certain, large sets need
    one round, and two sets agree in a coordinate with the probability of their similarity,
    concentrated like that of independent samples. An empty set keeps the highest value.
    """
    sets, counts = len(bounds) - 1, np.diff(bounds)
    out = np.full(sets * size, FULL, U64)
    base = np.repeat(np.arange(sets) * size, counts)  # first bin of each element's set
    factors = np.random.default_rng(777).integers(1, 1 << 63, 2 * size, dtype=U64) | U64(1)
    free = np.ones(sets * size, bool)
    for i in range(2 * size):
        if not len(values):
            break
        x = values * factors[i]
        high = x >> U64(32)
        x ^= high
        x *= U64(0x9FB21C651E98DF25)
        if i < size:
            np.right_shift(x, U64(32), out=high)
            high *= U64(size)
            high >>= U64(32)
            place = high.view(np.int64)
            place += base
        else:
            place = base + (i - size)
        if i:  # what falls into bins that an earlier round filled is higher than theirs
            low = np.flatnonzero(free[place])
            x, place = x[low], place[low]
        x &= U64(0xFFFFFFFF)
        x |= U64(i << 32)
        np.minimum.at(out, place, x)
        np.equal(out, FULL, out=free)
        open_ = free.reshape(sets, size).any(axis=1)
        keep = np.repeat(open_, counts)
        counts = np.where(open_, counts, 0)
        values, base = values[keep], base[keep]
    return out.reshape(sets, size)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band: the hash of ``rows`` coordinates and the band's number."""
    keys = np.empty((len(sketch), bands), U64)
    for b in range(bands):
        key = np.full(len(sketch), U64(b + 1), U64)
        for j in range(b * rows, (b + 1) * rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + sketch[:, j], 5)
        keys[:, b] = key
    return keys


def bucket_batch(nodes: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows of ``BUCKET_SCHEMA``: each bucket of the batch is combined to its smallest node.

    The smallest node goes to the shuffle under the band's key; the others already know
    their hub and are dealt by their own hash.
    """
    nodes, first = np.unique(nodes.view(np.int64), return_index=True)
    keys = keys[first]
    band = keys.ravel()
    node = np.repeat(nodes, keys.shape[1])
    order = np.argsort(band, kind="stable")  # nodes stay sorted within a band
    band, node = band[order], node[order]
    head = np.concatenate([[True], band[1:] != band[:-1]]) if len(band) else np.empty(0, bool)
    at = np.maximum.accumulate(np.where(head, np.arange(len(band)), 0)) if len(band) else head
    hub = node[at] if len(band) else node
    deal = np.where(head, band, mix(node.view(U64), 9))
    return pa.RecordBatch.from_arrays(
        [longs(deal), longs(band), pa.array(node), pa.array(hub, mask=head)],
        names=["deal", "band", "node", "hub"])


def memberships(rows: DataFrame) -> DataFrame:
    """band, hub, node: every node of a bucket but its hub, with a hub that shares the band."""
    first = F.first("node").over(Window.partitionBy("deal", "band").orderBy("node"))
    return (
        rows.withColumn("hub", F.coalesce("hub", first))
        .filter("hub <> node").select("band", "hub", "node")
    )


def sketch_bits(sketch: np.ndarray) -> np.ndarray:
    """One bit of each coordinate (at most ``LEADS``) as one number per set."""
    bits = np.zeros(len(sketch), U64)
    for j in range(sketch.shape[1]):
        bits |= ((sketch[:, j] * U64(0x9E3779B97F4A7C15)) >> U64(63)) << U64(j)
    return bits


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b) & U64((1 << LEADS) - 1)) > NEAR_BITS


def sketch_batch(nodes: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """Rows of ``SKETCH_SCHEMA``: like ``bucket_batch``, but only nodes whose bits are near
    those of the batch's smallest node are combined to it, and that one is marked."""
    nodes, first = np.unique(nodes.view(np.int64), return_index=True)
    band = keys[first].ravel()
    node = np.repeat(nodes, keys.shape[1])
    bits = np.repeat(bits[first], keys.shape[1])
    order = np.argsort(band, kind="stable")  # nodes stay sorted within a band
    band, node, bits = band[order], node[order], bits[order]
    head = np.diff(band, prepend=~band[:1]) != 0
    at = np.maximum.accumulate(np.where(head, np.arange(len(band)), 0))
    alone = head | _far(bits, bits[at])
    hub = node[at]
    bits[at[~alone]] |= U64(1 << LEADS)
    deal = np.where(alone, band, mix(node.view(U64), 9))
    return pa.RecordBatch.from_arrays(
        [longs(deal), longs(band), pa.array(node), longs(bits), pa.array(hub, mask=alone)],
        names=["deal", "band", "node", "bits", "hub"])


def _thin(band: np.ndarray, node: np.ndarray, bits: np.ndarray):
    """(band, hub, node) of whole buckets in order, without nodes that are far from all
    others of their bucket. A bucket with a marked node, or beyond ``THINNED``, stays whole."""
    same = band[1:] == band[:-1]
    shared = np.flatnonzero(np.append(same, False) | np.append(False, same)[: len(band)])
    if not len(shared):
        return band[:0], node[:0], node[:0]
    shared = shared[np.lexsort((node[shared], band[shared]))]
    band, node, bits = band[shared], node[shared], bits[shared]
    start = np.flatnonzero(np.diff(band, prepend=~band[:1]) | np.diff(node, prepend=~node[:1]))
    band, node, bits = band[start], node[start], np.bitwise_or.reduceat(bits, start)
    head = np.diff(band, prepend=~band[:1]) != 0
    bucket = np.cumsum(head) - 1
    sizes = np.bincount(bucket)
    whole = np.bitwise_or.reduceat(bits, np.flatnonzero(head)) >> U64(LEADS) != 0
    whole |= sizes > THINNED
    kept = whole[bucket]
    place = np.arange(len(band)) - np.flatnonzero(head)[bucket]
    left = np.where(kept, 0, sizes[bucket] - 1 - place)  # later nodes of the bucket to meet
    at, step = np.flatnonzero(left), 1
    while len(at):
        near = at[~_far(bits[at], bits[at + step])]
        kept[near] = kept[near + step] = True
        step += 1
        at = at[left[at] >= step]
    band, node = band[kept], node[kept]
    head = np.diff(band, prepend=~band[:1]) != 0
    hub = node[np.maximum.accumulate(np.where(head, np.arange(len(band)), 0))]
    return band[~head], hub[~head], node[~head]


def near_memberships(rows: DataFrame) -> DataFrame:
    """``memberships`` of rows as of ``sketch_batch``, thinned.

    Two nodes that share a band are both members of it, or their bits are far apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        rest, open_ = (empty, empty, empty.view(U64)), None

        def made(band, hub, node):
            return pa.RecordBatch.from_arrays(
                [pa.array(band), pa.array(hub), pa.array(node)], names=["band", "hub", "node"])

        for batch in batches:
            combined = batch.filter(pc.is_valid(batch.column("hub")))
            if combined.num_rows:
                yield combined.select(["band", "hub", "node"])
            heads = batch.filter(pc.is_null(batch.column("hub")))
            band, node, bits = (heads.column(c).to_numpy() for c in ("band", "node", "bits"))
            if open_ is not None:  # the bucket that is kept whole goes on
                same = band == open_[0]
                others = same & (node != open_[1])
                yield made(band[others], np.full(others.sum(), open_[1]), node[others])
                band, node, bits = band[~same], node[~same], bits[~same]
            rest = tuple(np.concatenate(both) for both in zip(
                rest, (band, node, bits.view(U64)), strict=True))
            if not len(rest[0]):
                continue
            last = int(np.searchsorted(rest[0], rest[0][-1], "left"))
            yield made(*_thin(*(column[:last] for column in rest)))
            rest = tuple(column[last:] for column in rest)
            if len(rest[0]) > 4 * THINNED:
                open_ = rest[0][0], rest[1][0]
                others = rest[1] != open_[1]
                yield made(rest[0][others], np.full(others.sum(), open_[1]), rest[1][others])
                rest = (empty, empty, empty.view(U64))
        yield made(*_thin(*rest))

    return rows.repartition("deal").sortWithinPartitions("band").mapInArrow(
        run, "band long, hub long, node long")


# ------------------------------------------------------------------ verification


def wanted_filter(nodes: DataFrame, column: str = "node") -> np.ndarray:
    """A bitmap of fixed size that has the bit of every given number (and perhaps others)."""
    words = nodes.select(_slot(F.col(column)).alias("slot"))
    words = words.select(
        F.shiftright("slot", 6).alias("word"),
        F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    return table


def _slot(column):
    """A number's bit in the filter; ``slots`` is the same in numpy."""
    mixed = column.bitwiseXOR(F.shiftrightunsigned(column, 29))
    return mixed.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))


def slots(values: np.ndarray) -> np.ndarray:
    values = values.view(U64)
    return ((values ^ (values >> U64(29))) & U64((1 << FILTER_BITS) - 1)).astype(np.int64)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = slots(values)
    return (table[slot >> 6] >> (slot & 63)) & 1 == 1


def compare(values_a, bounds_a, values_b, bounds_b):
    """(intersection, union) sizes of pairs of sets given as ranges; at most 4,096 pairs."""
    a, edge_a = distinct(values_a, bounds_a)
    b, edge_b = distinct(values_b, bounds_b)
    size_a, size_b = np.diff(edge_a), np.diff(edge_b)
    row = np.arange(len(size_a), dtype=U64) << U64(52)
    both = np.sort(np.concatenate([a | np.repeat(row, size_a), b | np.repeat(row, size_b)]))
    equal = both[1:][both[1:] == both[:-1]] >> U64(52)
    inter = np.bincount(equal.astype(np.int64), minlength=len(size_a))
    return inter, size_a + size_b - inter


def verify(pairs: DataFrame, texts: DataFrame, to_sets: Callable, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have at least ``percent`` % in common.

    ``texts``: node, text; ``to_sets(scanner, data, offsets)`` gives (elements, offsets).
    """
    rows = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
    rows = rows.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            sizes = (pc.binary_length(batch.column("ta")).to_numpy().astype(np.int64)
                     + pc.binary_length(batch.column("tb")).to_numpy())
            part = np.cumsum(sizes) // (1 << 20)
            low = 0
            while low < batch.num_rows:
                high = min(int(np.searchsorted(part, part[low], "right")), low + 4096)
                sides = []
                for name in ("ta", "tb"):
                    column = batch.column(name).slice(low, high - low)
                    (_, _, data, offsets), = text_slices(column, 1 << 62)
                    sides += to_sets(scanner, data, offsets)
                inter, union = compare(*sides)
                good = pa.array(100 * inter >= percent * union)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(low, high - low).filter(good) for c in ("a", "b")],
                    names=["a", "b"])
                low = high

    return rows.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


# ------------------------------------------------------------------ components


def _are_stars(e: DataFrame) -> bool:
    """Whether every left node has one right node and no right node is a left one."""
    twice = e.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    inner = e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return twice.isEmpty() and inner.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for the nodes of ``edges`` (a, b)."""
    # a > b from here on
    e = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges")
    while not _are_stars(e):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m"))
        large = large.filter("a <> m").select("a", F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e")
        ).select("e.a", F.col("e.m").alias("b")).filter("a <> b").distinct()
        e = materialize(small, "edges")
    roots = e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _pairs(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _distinct_sets(scanner: Scanner, column: pa.Array, to_sets: Callable):
    """(elements, offsets) of the texts of a column, each set's elements once."""
    parts, sizes = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for _, _, data, offsets in text_slices(column):
        values, bounds = distinct(*to_sets(scanner, data, offsets))
        parts.append(values)
        sizes.append(np.diff(bounds))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


def common_counts(a, bounds_a, b, bounds_b):
    """Yield (first, last + 1, matrix): common elements of every set of ``a`` with those
    sets of ``b``, a few at a time so that memory stays bounded."""
    sets = len(bounds_a) - 1
    owner = np.repeat(np.arange(sets), np.diff(bounds_a))
    order = np.argsort(a, kind="stable")
    a, owner = a[order], owner[order]
    low = 0
    while low < len(bounds_b) - 1:
        room = bounds_b[low] + max(1, MATCHES // max(1, sets))
        high = max(low + 1, int(np.searchsorted(bounds_b, room, "right")) - 1)
        values = b[bounds_b[low] : bounds_b[high]]
        of = np.repeat(np.arange(high - low), np.diff(bounds_b[low : high + 1]))
        left, right = np.searchsorted(a, values, "left"), np.searchsorted(a, values, "right")
        n = right - left
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        pair = owner[at] * (high - low) + np.repeat(of, n)
        yield low, high, np.bincount(pair, minlength=sets * (high - low)).reshape(sets, -1)
        low = high


def _compare_strays(named: DataFrame, texts: DataFrame, to_sets: Callable,
                    percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that are in different components.

    ``named``: band, node, component. Members outside a bucket's main component (the one
    with most of its members) are compared with all members of other components, inside
    tasks: a task gets a chunk of those and a part of the members, both of bounded bytes.
    Small buckets share a task's call.
    """
    size = F.col("size")
    sized = named.join(texts.select("node", F.octet_length("text").alias("size")), "node")
    parts = sized.groupBy("band", "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    most = F.max(F.struct("n", "component", "bytes"))
    main = parts.groupBy("band").agg(
        most["component"].alias("main"),
        (F.sum("n") - most["n"]).alias("stray_n"), F.sum("n").alias("all_n"),
        (F.sum("bytes") - most["bytes"]).alias("stray_bytes"), F.sum("bytes").alias("all_bytes"),
    ).filter("stray_n > 0").select(
        "band", "main",
        F.greatest(F.ceil(F.col("stray_n") / CHUNK_SETS), F.ceil(F.col("stray_bytes") / CHUNK_BYTES))
        .alias("chunks"),
        F.greatest(F.ceil(F.col("all_n") / PART_SETS), F.ceil(F.col("all_bytes") / PART_BYTES))
        .alias("parts"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    calls = max(1, math.ceil(total / PART_BYTES))
    rows = named.join(main, "band").join(texts, "node").withColumn(
        "call", F.pmod("band", F.lit(calls)))

    def spread(count):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    key = F.xxhash64("node")
    strays = rows.filter("component <> main").select(
        "call", "band", F.pmod(key, "chunks").alias("chunk"), spread("parts").alias("part"),
        F.lit(True).alias("stray"), "node", "component", "text")
    others = rows.select(
        "call", "band", spread("chunks").alias("chunk"), F.pmod(key, "parts").alias("part"),
        F.lit(False).alias("stray"), "node", "component", "text")

    def run(group: pa.Table) -> pa.Table:
        scanner = Scanner()
        sides = []
        for stray in (True, False):
            side = group.filter(pc.equal(group["stray"], stray)).sort_by("band").combine_chunks()
            text = side["text"].combine_chunks() if side.num_rows else pa.array([], pa.string())
            sides.append((side["band"].to_numpy(), side["node"].to_numpy(),
                          side["component"].to_numpy(), *_distinct_sets(scanner, text, to_sets)))
        (band_x, x, comp_x, ex, bx), (band_y, y, comp_y, ey, by) = sides
        size_x, size_y = np.diff(bx), np.diff(by)
        out = [np.empty((0, 2), np.int64)]
        for band in np.unique(band_x):
            x0, x1 = np.searchsorted(band_x, band, "left"), np.searchsorted(band_x, band, "right")
            y0, y1 = np.searchsorted(band_y, band, "left"), np.searchsorted(band_y, band, "right")
            if y0 == y1:
                continue
            for low, high, inter in common_counts(
                    ex[bx[x0] : bx[x1]], bx[x0 : x1 + 1] - bx[x0],
                    ey[by[y0] : by[y1]], by[y0 : y1 + 1] - by[y0]):
                low, high = y0 + low, y0 + high
                union = size_x[x0:x1, None] + size_y[None, low:high] - inter
                good = 100 * inter >= percent * union
                i, j = np.nonzero(good & (comp_x[x0:x1, None] != comp_y[None, low:high]))
                out.append(np.stack([x[x0 + i], y[low + j]], axis=1))
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return strays.unionAll(others).groupBy("call", "chunk", "part").applyInArrow(
        run, "a long, b long")


def link(members: DataFrame, texts: DataFrame, to_sets: Callable, percent: int) -> DataFrame:
    """node, component of all nodes that have a link.

    ``members``: a stored table band, hub, node; ``texts``: a stored table node, text.
    Complete: two nodes that share a band end in one component or were compared.
    """
    tested = materialize(members.select(*_pairs("hub", "node")).distinct(), "tested")
    linked = materialize(verify(tested, texts, to_sets, percent), "linked")
    labels = materialize(components(linked), "labels")
    # buckets of two are settled by now; of those that are equal row by row one is enough
    row = F.xxhash64("hub", "node")
    large = members.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.shiftright(row, 24)).alias("upper"),
        F.sum(row.bitwiseAND(F.lit((1 << 40) - 1))).alias("lower"),
    ).filter("n > 1").groupBy("n", "upper", "lower").agg(F.min("band").alias("band"))
    all_ = members.select("band", "node").unionAll(
        members.select("band", F.col("hub").alias("node"))).distinct()
    named = all_.join(large.select("band"), "band").join(labels, "node", "left").select(
        "band", "node", F.coalesce("component", "node").alias("component"))
    more = materialize(
        _compare_strays(materialize(named, "members"), texts, to_sets, percent).distinct(),
        "linked")
    if more.isEmpty():
        return labels
    old = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return materialize(components(old.unionAll(more)), "labels")
