"""Numpy helpers for tasks: bounded slices of a text column, words, shingles, hashes.

A word is a run of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Every helper
works on UTF-8 bytes of whole texts; a slice holds whole documents and about ``SLICE``
bytes, or one document if that is longer.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

SLICE = 1 << 18  # arrays of a slice stay in the processor's caches
BLANKS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: The same class for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

U64 = np.uint64
FULL = U64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ U64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple]:
    """(first row, last row + 1, bytes, offsets) of a string column; null reads as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    low = 0
    while low < len(column):
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), low + 4096)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


class Scanner:
    """Finds and hashes words; one per task, as it holds tables that grow to the slice."""

    def __init__(self):
        letters = np.random.default_rng(20240229)
        self.codes = letters.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.codes = self.codes[self.lower]
        self.exact_codes = letters.integers(1, 1 << 63, 256, dtype=U64) | U64(1)
        self.solid = np.ones(256, bool)
        self.solid[list(BLANKS)] = False
        self.base = 0x2545F4914F6CDD1D | 3
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.backs = np.ones(1, U64)

    def _powers(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * len(self.powers), SLICE)
            with np.errstate(over="ignore"):
                for name, base in (("powers", self.base), ("backs", self.inverse)):
                    steps = np.full(n, U64(base), U64)
                    steps[0] = 1
                    setattr(self, name, np.cumprod(steps, dtype=U64))

    def spans(self, data, offsets, solid=None):
        """(starts, ends, offsets of each text's words) of maximal runs of solid bytes."""
        inside = (self.solid if solid is None else solid)[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < len(data)]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        tails = offsets[1:][offsets[1:] > 0] - 1
        last[tails] = inside[tails]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, offsets)

    def hashes(self, data, starts, ends, exact: bool = False) -> np.ndarray:
        """64-bit hashes of the byte ranges; A-Z count as a-z unless ``exact``."""
        if not len(starts):
            return np.empty(0, U64)
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, U64)
        codes = self.exact_codes if exact else self.codes
        np.cumsum(codes[data] * self.powers[: len(data)], out=total[1:])
        value = (total[ends] - total[starts]) * self.backs[starts]
        return mix(value + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15))

    def words(self, data, offsets):
        """(word hashes, offsets of each text's words)."""
        starts, ends, bounds = self.spans(data, offsets)
        return self.hashes(data, starts, ends), bounds


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int):
    """(shingle hashes, offsets): runs of k words; fewer words make one shingle."""
    counts = np.diff(bounds)
    made = np.where(counts == 0, 0, np.maximum(counts - k + 1, 1))
    out = np.concatenate([[0], np.cumsum(made)])
    if not out[-1]:
        return np.empty(0, U64), out
    row = np.repeat(np.arange(len(counts)), made)
    at = np.arange(out[-1]) - out[row] + bounds[row]
    value = np.zeros(len(at), U64)
    for j in range(k):
        inside = at + j < bounds[row + 1]
        word = words[np.minimum(at + j, len(words) - 1)]
        value = mix(value * U64(0x9E3779B97F4A7C15) + np.where(inside, word, U64(0)), j + 1)
    return value, out


def distinct(values: np.ndarray, bounds: np.ndarray):
    """(distinct values of each set, offsets), as 52-bit numbers comparable everywhere.

    Sets are told apart by the upper 12 bits of the sort key, so a slice has at most 4,096.
    """
    counts = np.diff(bounds)
    row = np.repeat(np.arange(len(counts), dtype=U64), counts)
    key = np.sort((row << U64(52)) | (values >> U64(12)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    sizes = np.bincount((key >> U64(52)).astype(np.int64), minlength=len(counts))
    return key & U64((1 << 52) - 1), np.concatenate([[0], np.cumsum(sizes)])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of each range; 0 of an empty one."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit numbers as Spark longs."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def ship(spark, value) -> Callable:
    """Broadcast ``value``, classes by value too; the result gives it inside a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


def word_counts(docs, keep: list[str], text_col: str = "text", out: str = "size"):
    """``keep`` columns of ``docs`` and the number of words of each whole text (null: 0)."""
    rows = docs.select(*keep, docs[text_col].alias("_text"))

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            counts = [np.empty(0, np.int64)]
            for _, _, data, offsets in text_slices(batch.column("_text")):
                counts.append(np.diff(scanner.spans(data, offsets)[2]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.concatenate(counts))],
                names=[*keep, out],
            )

    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return rows.mapInArrow(run, f"{kinds}`{out}` long")
