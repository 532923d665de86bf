"""Fuzzy line de-duplication over a corpus.

A line is compared without the blanks at its ends and with A-Z in lower case; lines without
anything else are left alone. Its set are its shingles of ``SHINGLE`` characters (a shorter
line is one shingle). MinHash signatures of these sets, cut in ``BANDS`` bands of ``ROWS``, bring
candidates together; those whose signatures are far apart go, the others are compared on whole lines, and links join lines into
components (``linking``). Of each component the first line, by id and line number, stays.

Equal lines are one node (a 64-bit hash), whatever their number. What is shuffled: band
keys, one row per line with its hash, the lines that share a bucket, and once the documents
themselves, to which the lists of dropped lines are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.linking import (
    SKETCH_SCHEMA,
    band_keys,
    fast_sketch,
    link,
    near_memberships,
    passes,
    sketch_batch,
    sketch_bits,
    wanted_filter,
)
from corpusloom.llm.textops import SLICE, U64, Scanner, longs, mix, ship, text_slices
from corpusloom.session import materialize

SHINGLE = 5
BANDS, ROWS = 12, 5
FACTORS = np.random.default_rng(555).integers(1, 1 << 63, SHINGLE, dtype=U64) | U64(1)
PERCENT = 80
NEWLINE = 10
HANDED = 1 << 16  # rows that a task hands to Spark at once


def line_spans(scanner: Scanner, data, offsets):
    """(text of each line that has words, its number, its start and end without blanks)."""
    breaks = np.flatnonzero(data == NEWLINE)
    words, stops, bounds = scanner.spans(data, offsets)
    # the first word after each line's start, text by text
    before = np.searchsorted(breaks, offsets)
    number = np.diff(before) + 1
    line = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    text = np.repeat(np.arange(len(number)), number)
    at = np.searchsorted(words, breaks)
    first = np.insert(at, before[:-1], bounds[:-1])
    past = np.insert(at, before[1:], bounds[1:])
    full = past > first
    return text[full], line[full], words[first[full]], stops[past[full] - 1]


def characters(scanner: Scanner, data):
    """(a number for each character, from 1 on; the byte at which each begins, or None if all
    are of one byte)."""
    lower = scanner.lower[data]
    if not len(data) or data.max() < 0x80:
        return lower.astype(U64) + U64(1), None
    lead = (data & 0xC0) != 0x80
    at, code = np.flatnonzero(lead), lower[lead].astype(U64)
    # the bytes of a character, which are two to four here
    wide = np.flatnonzero(code >= U64(0xC0))
    four = np.ndarray(
        (len(data),), "<u4", np.concatenate([lower, np.zeros(4, np.uint8)]), strides=(1,))
    size = np.append(at, len(data))[wide + 1] - at[wide]
    code[wide] = four[at[wide]].astype(U64) & ((U64(1) << (U64(8) * size.astype(U64))) - U64(1))
    code += U64(1)
    return code, at


def line_sets(scanner: Scanner, data, starts, ends):
    """(hashes of the shingles, offsets) of byte ranges that are in order and apart."""
    code, at = characters(scanner, data)
    first, past = (starts, ends) if at is None else (
        np.searchsorted(at, starts), np.searchsorted(at, ends))
    sizes = past - first
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    step = np.zeros(len(code) + 2, np.int8)  # +1 where a line's shingles begin, -1 after them
    step[first] += 1
    step[first + counts] -= 1
    inside = np.cumsum(step[: len(code)], dtype=np.int8).view(bool)
    every, term = code * FACTORS[0], np.empty_like(code)
    for j in range(1, min(SHINGLE, len(code))):
        every[:-j] += np.multiply(code[j:], FACTORS[j], out=term[j:])
    values = every[inside]
    for i in np.flatnonzero(sizes < SHINGLE):
        part = code[first[i] : past[i]]
        values[bounds[i]] = (part * FACTORS[: len(part)]).sum(dtype=U64)
    return mix(values, 31), bounds


def _text_sets(scanner, data, offsets):
    """The shingles of texts that are one line each."""
    return line_sets(scanner, data, offsets[:-1], offsets[1:])


def _bucket_rows(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            nodes, keys, bits = [np.empty(0, U64)], [np.empty((0, BANDS), U64)], [np.empty(0, U64)]
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE >> 1):
                _, _, starts, ends = line_spans(scanner, data, offsets)
                node = scanner.hashes(data, starts, ends)
                first = np.sort(np.unique(node, return_index=True)[1])
                values, bounds = line_sets(scanner, data, starts[first], ends[first])
                nodes.append(node[first])
                sketch = fast_sketch(values, bounds, BANDS * ROWS)
                keys.append(band_keys(sketch, BANDS, ROWS))
                bits.append(sketch_bits(sketch))
            rows = sketch_batch(*(np.concatenate(part) for part in (nodes, keys, bits)))
            for low in range(0, rows.num_rows, HANDED):
                yield rows.slice(low, HANDED)

    return docs.select("text").mapInArrow(run, SKETCH_SCHEMA)


def line_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """doc_id, row, line, node of every line with words, and its text if it is among ``nodes``.

    A batch gives the text of a node once. A fixed-size filter stands for ``nodes``, so a few
    others have their text, too.
    """
    wanted = ship(docs.sparkSession, wanted_filter(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, table = Scanner(), wanted()
        for batch in batches:
            for low, _, data, offsets in text_slices(batch.column("text"), SLICE >> 1):
                text, number, starts, ends = line_spans(scanner, data, offsets)
                node = scanner.hashes(data, starts, ends)
                at = np.flatnonzero(passes(table, node))
                at = at[np.sort(np.unique(node[at], return_index=True)[1])]
                raw = data.tobytes()
                lines = np.full(len(node), None, object)
                for i, s, e in zip(at.tolist(), starts[at].tolist(), ends[at].tolist(), strict=True):
                    lines[i] = raw[s:e].decode()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(low + text)),
                     batch.column("row").take(pa.array(low + text)),
                     pa.array(number.astype(np.int32)), longs(node), pa.array(lines, pa.string())],
                    names=["doc_id", "row", "line", "node", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(
        run, f"doc_id {kind}, row long, line int, node long, text string")


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """row, lines: for each of ``docs`` (doc_id, row, text) the numbers of the lines that go."""
    members = materialize(near_memberships(_bucket_rows(docs)), "line-buckets")
    nodes = materialize(
        members.select("node").unionAll(members.select(F.col("hub").alias("node"))).distinct(),
        "line-nodes")
    places = materialize(line_nodes(docs, nodes), "lines")
    found = places.filter(F.col("text").isNotNull()).select("node", "text")
    texts = materialize(
        found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "line-texts")
    labels = link(members, texts, _text_sets, percent)
    # lines that equal or resemble another: all others stay
    places = places.select("doc_id", "row", "line", "node")
    repeated = places.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    touched = repeated.select("node", F.lit(None).cast("long").alias("component")).unionAll(
        labels.select("node", "component")).groupBy("node").agg(
        F.max("component").alias("component"))
    named = materialize(places.join(touched, "node").select(
        "doc_id", "row", "line", F.coalesce("component", "node").alias("key")), "touched-lines")
    # null ids come last, so that a line of an identified document stays if there is one
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row", "line")
    keepers = named.groupBy("key").agg(F.min(place).alias("first"))
    return (
        named.join(keepers, "key")
        .filter((F.col("row") != F.col("first.row")) | (F.col("line") != F.col("first.line")))
        .groupBy("row").agg(F.collect_set("line").alias("lines"))
    )


def dedup_lines(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text", drop_emptied: bool = False) -> DataFrame:
    """``docs`` with the text cut to the lines that stay, n_lines and n_dropped.

    ``n_lines`` counts lines with words, ``n_dropped`` those that went; ``drop_emptied``
    leaves out documents that lost all their lines (and the two counts). A text without such
    lines is unchanged (null stays null). A line goes with its line break, so what stays is
    joined as before. Documents are told apart by id and text (a 64-bit hash of both): rows
    that share an id, null included, lose only their own lines; rows that repeat both id and
    text are one document, so equal rows stay equal. Columns
    of the input called n_lines or n_dropped are replaced. Very long lines and texts are
    treated whole; the list of dropped lines never exceeds a document's own lines.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), row.alias("row"), F.col(text_col).alias("text"))
    drops = duplicate_lines(rows, percent).select(
        F.col("row").alias("_id"), F.col("lines").alias("_lines"))
    others = [c for c in docs.columns if drop_emptied or c not in ("n_lines", "n_dropped")]
    names = [f"_c{i}" for i in range(len(others))]
    joined = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)))
    text = names[others.index(text_col)]
    joined = joined.withColumn("_id", F.xxhash64(names[others.index(id_col)], text)).join(
        drops, "_id", "left").drop("_id")

    def cut(text: str, lines: list[int]) -> tuple[str, int]:
        parts, gone = text.split("\n"), set(lines)
        kept = [p for i, p in enumerate(parts) if i not in gone]
        return "\n".join(kept), sum(i < len(parts) for i in gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            counts = [np.empty(0, np.int64)]
            column = batch.column(text)
            for _, _, data, offsets in text_slices(column):
                of_text = line_spans(scanner, data, offsets)[0]
                counts.append(np.bincount(of_text, minlength=len(offsets) - 1))
            gone = [0] * batch.num_rows
            changed = pc.and_(pc.is_valid(batch.column("_lines")), pc.is_valid(column))
            at = pa.array(np.flatnonzero(changed.to_numpy(zero_copy_only=False)))
            texts = []
            for i, old, lines in zip(at.to_pylist(), column.take(at).to_pylist(),
                                     batch.column("_lines").take(at).to_pylist(), strict=True):
                new, gone[i] = cut(old, lines)
                texts.append(new)
            if texts:
                column = pc.replace_with_mask(column, changed, pa.array(texts, column.type))
            columns = [column if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.concatenate(counts).astype(np.int64)),
                 pa.array(gone, pa.int64())], names=[*names, "_n", "_gone"])

    kinds = "".join(f"{n} {joined.schema[n].dataType.simpleString()}, " for n in names)
    out = joined.mapInArrow(run, f"{kinds}_n long, _gone long")
    if drop_emptied:
        return out.filter("_n = 0 OR _gone < _n").drop("_n", "_gone").toDF(*others)
    return out.toDF(*others, "n_lines", "n_dropped")
