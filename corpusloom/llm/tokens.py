"""Token counts by finite-state transducers compiled from a byte-level BPE file.

Two deterministic machines are compiled from the tokenizer's file:

* the *splitter*: the file's split pattern as an automaton with eight states over eight
  symbols (a character's class, with what the pattern looks ahead at folded into it). A
  transition says whether its character begins a piece;
* the *merger*: a transducer over bytes whose transitions carry the change of the number
  of tokens, so the sum on the way through a piece is its count (see ``Merger``). It is
  linear in a piece's length. Transitions are built when first taken and kept per task, and
  so are the counts of whole pieces.

A text is cut in chunks of characters. A chunk's effect is a map from each entry state to
its exit state; maps of all chunks compose by a parallel prefix scan (doubling), which
gives each chunk's entry state, and a second pass emits the piece boundaries. Hence a very
long text is no longer a sequential job, and no text is truncated.

Cases: null counts as empty, an empty text has 0 bytes and 0 tokens; special strings in a
text are one token, as the library does by default; a repeated row gives a repeated row;
lone columns with other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textops import FULL, U64, mix, ship, sums, text_slices

CHUNK = 64
#: Pieces whose counts a task keeps; beyond it the table starts anew (a cache, no limit).
KEPT_PIECES = 1 << 21
#: Transitions that a task keeps; beyond it they are built anew (a cache, no limit).
KEPT_ARCS = 1 << 18
NEVER = 1 << 40
#: State of the merger before a piece: no bytes, no token, no tokens fewer.
START = (b"", (-1,), (0,))

# Symbols and states of the splitter.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, BLANK_RUN, BLANK_LAST, SPACE_LAST, EDGE = range(9)
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_BLANKS, ONE_LEFT, TWO_LEFT = range(8)
# The split pattern that the automaton states, and its white space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
         0x202F, 0x205F, 0x3000]
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

SEPARATOR, SPECIAL = 0x110000, 0x110001


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if the character begins a piece), both indexed symbol * 8 + state."""
    goes, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    for symbol, inside in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        goes[symbol] = inside
        begins[symbol, [inside, AFTER_SPACE]] = 0
    for symbol, left in ((QUOTE1, ONE_LEFT), (QUOTE2, TWO_LEFT)):
        goes[symbol] = left
        goes[symbol, [IN_OTHERS, AFTER_SPACE]] = IN_OTHERS
        begins[symbol, [IN_OTHERS, AFTER_SPACE]] = 0
    goes[LETTER, TWO_LEFT], goes[LETTER, ONE_LEFT] = ONE_LEFT, CLOSED
    begins[LETTER, [ONE_LEFT, TWO_LEFT]] = 0
    goes[BLANK_RUN] = IN_BLANKS
    begins[BLANK_RUN, IN_BLANKS] = 0
    goes[BLANK_LAST], goes[SPACE_LAST], goes[EDGE] = CLOSED, AFTER_SPACE, CLOSED
    return goes.ravel(), begins.ravel()


def classes() -> np.ndarray:
    """The class of every code point and of the two marks beyond the last."""
    table = np.full(SPECIAL + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, symbol in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for run in regex.finditer(kind, every):
            low, high = ord(every[run.start()]), ord(every[run.end() - 1])
            table[low : high + 1] = symbol
    table[0xD800:0xE000] = OTHER
    table[WHITE] = BLANK_RUN
    table[[SEPARATOR, SPECIAL]] = EDGE
    return table


def symbols(points: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Each character's symbol; ``points`` ends with a separator."""
    out = table[points]
    blank = out == BLANK_RUN
    after = out[1:]
    last = np.flatnonzero(blank[:-1] & (after != BLANK_RUN) & (after != EDGE))
    out[last] = np.where(points[last] == 32, SPACE_LAST, BLANK_LAST)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        end = len(points) - 1
        one, two = points[np.minimum(quotes + 1, end)], points[np.minimum(quotes + 2, end)]
        short = np.isin(one, [ord(c) for c in SHORT_ENDINGS])
        long = np.zeros(len(quotes), bool)
        for a, b in LONG_ENDINGS:
            long |= (one == ord(a)) & (two == ord(b))
        out[quotes[short]] = QUOTE1
        out[quotes[long]] = QUOTE2
    return out


def boundaries(symbol: np.ndarray, goes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """1 where a piece begins: chunk maps, their prefix scan, then the emitting pass."""
    n = len(symbol)
    rows = -(-n // CHUNK)
    block = np.full(rows * CHUNK, EDGE, np.uint8)
    block[:n] = symbol
    steps = np.ascontiguousarray(block.reshape(rows, CHUNK).T).astype(np.int64) << 3
    maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
    for step in steps:
        maps = goes[step[:, None] | maps]
    shift = 1
    while shift < rows:  # afterwards maps[i] leads through chunks 0 to i
        later = np.take_along_axis(maps[shift:], maps[:-shift].astype(np.int64), axis=1)
        maps = np.concatenate([maps[:shift], later])
        shift *= 2
    state = np.concatenate([[CLOSED], maps[:-1, CLOSED]]).astype(np.uint8)
    out = np.empty((CHUNK, rows), np.uint8)
    for j, step in enumerate(steps):
        at = step | state
        out[j] = begins[at]
        state = goes[at]
    return out.T.ravel()[:n]


def stay_apart(ranks: dict, left: tuple, right: tuple, but: tuple = ()) -> bool:
    """Whether merging never joins two neighbours, both of which come about by themselves.

    ``left`` lists the symbols that stand at the right edge of the left neighbour, one after
    the other, each with the rank of the merge that ends it; ``right`` those at the left edge
    of the right one. A merge over the border happens if its rank comes before both ends; of
    equal ranks the leftmost place goes first. ``but``: a pair that does not count.
    """
    i = j = 0
    while True:
        (a, end_a), (b, end_b) = left[i], right[j]
        rank = ranks.get((a, b))
        if rank is not None and rank[0] < end_a and rank[0] <= end_b and (a, b) != but:
            return False
        if end_a <= end_b:
            if end_a == NEVER:
                return True
            i += 1
        else:
            j += 1


def compile_merges(ranks: dict[tuple[int, int], tuple[int, int]], byte_ids: list[int]) -> dict:
    """The vocabulary as the machine reads it.

    ``tokens``: number of each entry that its own bytes give; ``starts``: all beginnings of
    these; ``left_edge``, ``right_edge``: the symbols at an entry's edges while it comes about.
    """
    text = {number: bytes((byte,)) for byte, number in enumerate(byte_ids)}
    left_edge = {number: ((number, NEVER),) for number in byte_ids}
    right_edge = dict(left_edge)
    for (a, b), (rank, made) in ranks.items():  # in the order of ranks
        if made in text or a not in text or b not in text:
            continue
        if stay_apart(ranks, right_edge[a], left_edge[b], (a, b)):
            text[made] = text[a] + text[b]
            left_edge[made] = (*left_edge[a][:-1], (a, rank), (made, NEVER))
            right_edge[made] = (*right_edge[b][:-1], (b, rank), (made, NEVER))
    starts = {entry[:n] for entry in text.values() for n in range(1, len(entry) + 1)}
    return {"tokens": {entry: number for number, entry in text.items()}, "starts": starts,
            "left_edge": left_edge, "right_edge": right_edge, "ranks": ranks}


class Merger:
    """Token counts of pieces by a counting transducer, kept by the hash of the piece.

    The tokens of a text's beginning are known by its last token alone: the one entry that
    ends there and stays apart from the last token of what is before it. A state holds what
    later tokens can depend on: the longest run of last bytes that begins an entry, the last
    token after each of these bytes, and how many tokens fewer the text had there. It is
    bounded by the longest entry, so the machine is finite and deterministic; its transitions
    carry the change of the count. They are built when first taken, and a word of any length
    is one walk through them.
    """

    def __init__(self, spec: dict):
        self.tokens, self.starts, self.ranks = spec["tokens"], spec["starts"], spec["ranks"]
        self.left_edge, self.right_edge = spec["left_edge"], spec["right_edge"]
        self.arcs: dict[int, tuple[int, int]] = {}
        self.apart: dict[int, bool] = {}
        self._restart()
        self.known = np.empty(0, U64)
        self.count = np.empty(0, np.int32)

    def counts(self, hashes: np.ndarray, piece_bytes) -> np.ndarray:
        """Counts for distinct sorted ``hashes``; ``piece_bytes(i)`` gives the i-th piece."""
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        found = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes), np.int32)
        out[found] = self.count[at[found]]
        new = np.flatnonzero(~found)
        if len(new):
            out[new] = self.compile([piece_bytes(i) for i in new])
            if len(self.known) + len(new) > KEPT_PIECES:
                self.known, self.count = self.known[:0], self.count[:0]
            place = np.searchsorted(self.known, hashes[new])
            self.known = np.insert(self.known, place, hashes[new])
            self.count = np.insert(self.count, place, out[new])
        return out

    def compile(self, pieces: list[bytes]) -> list[int]:
        """The counts that the transitions emit on the way through each piece."""
        if len(self.arcs) > KEPT_ARCS:
            self._restart()
        arcs, out = self.arcs, []
        for piece in pieces:
            state = total = 0
            for byte in piece:
                arc = arcs.get(state << 8 | byte)
                if arc is None:
                    if len(arcs) > KEPT_ARCS:
                        state = self._restart(self.states[state])
                    arc = self._arc(state, byte)
                state, emitted = arc
                total += emitted
            out.append(total)
        return out

    def _restart(self, state: tuple = START) -> int:
        """Forget all states but the first and ``state``; the number of the latter."""
        self.states, self.numbers = [START], {START: 0}
        self.arcs.clear()
        self.apart.clear()
        return self._number(state)

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _arc(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of a state by a byte, built when it is first taken."""
        window, last, behind = self.states[state]
        longer = window + bytes((byte,))
        reach = longer
        while reach not in self.starts:
            reach = reach[1:]
        # the one vocabulary entry that can follow what stands before it
        at = len(longer) - len(reach)
        while True:
            token = self.tokens.get(longer[at:])
            if token is not None and (last[at] < 0 or self._stay_apart(last[at], token)):
                break
            at += 1
        emitted = behind[at] + 1
        cut = len(longer) - len(reach)
        arc = self._number((reach, (*last[cut:], token),
                            (*(n - emitted for n in behind[cut:]), 0))), emitted
        self.arcs[state << 8 | byte] = arc
        return arc

    def _stay_apart(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.apart.get(key)
        if known is None:
            known = self.apart[key] = stay_apart(
                self.ranks, self.right_edge[left], self.left_edge[right])
        return known


class Counter:
    """The compiled tokenizer of one task."""

    def __init__(self, spec: dict):
        self.goes, self.begins = splitter()
        self.table = classes()
        self.special = [np.array(list(map(ord, s)), np.uint32) for s in spec["special"]]
        self.merger = Merger(spec["merger"])
        rng = np.random.default_rng(11)
        self.codes = rng.integers(1, 1 << 63, 1 << 16, dtype=U64) | U64(1)
        base = 0x2545F4914F6CDD1D | 3
        self.base, self.inverse = U64(base), U64(pow(base, -1, 1 << 64))
        self.powers = self.backs = np.ones(1, U64)

    def _points(self, data: np.ndarray, offsets: np.ndarray):
        """Code points with a separator after each text; special strings as one mark."""
        lead = (data & 0xC0) != 0x80
        total = np.concatenate([[0], np.cumsum(lead)])
        raw = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        cuts = total[offsets]
        points = np.insert(raw, cuts[1:], np.uint32(SEPARATOR))
        ends = cuts[1:] + np.arange(len(cuts) - 1)  # places of the separators
        for special in self.special:
            n = len(special)
            at = np.flatnonzero(points[: len(points) - n + 1] == special[0])
            for j in range(1, n):
                at = at[points[at + j] == special[j]]
            if len(at):
                at = at[np.concatenate([[True], np.diff(at) >= n])]
                points = points.copy()
                points[at] = SPECIAL
                drop = (at[:, None] + np.arange(1, n)).ravel()
                ends = ends - np.searchsorted(drop, ends)
                points = np.delete(points, drop)
        return points, ends

    def _hashes(self, points, starts, ends):
        n = len(points) + 1
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("backs", self.inverse)):
                steps = np.full(2 * n, base, U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        code = self.codes[points & 0xFFFF] + (points >> 16).astype(U64)
        total = np.zeros(n, U64)
        np.cumsum(code * self.powers[: n - 1], out=total[1:])
        return mix((total[ends] - total[starts]) * self.backs[starts] + (ends - starts).astype(U64))

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Token counts of the texts of one slice."""
        if not len(data):
            return np.zeros(len(offsets) - 1, np.int64)
        points, ends = self._points(data, offsets)
        symbol = symbols(points, self.table)
        start = np.flatnonzero(boundaries(symbol, self.goes, self.begins))
        stop = np.concatenate([start[1:], [len(points)]])
        mark = symbol[start] == EDGE
        special = points[start] == SPECIAL
        hashes = self._hashes(points, start, stop)
        hashes[mark] = FULL
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)

        def piece(i):
            at = first[i]
            return points[start[at] : stop[at]].tobytes().decode("utf-32-le").encode()

        marks = unique == FULL
        counts = np.zeros(len(unique), np.int64)
        plain = np.flatnonzero(~marks)
        counts[plain] = self.merger.counts(unique[plain], lambda i: piece(plain[i]))
        each = counts[inverse]
        each[special] = 1
        of_text = np.searchsorted(start, np.concatenate([[0], ends + 1]))
        return sums(each, of_text)


def read_spec(path: str) -> dict:
    """What the machines are compiled from: merge ranks, byte ids and special strings."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or spec["normalizer"]:
        raise ValueError("a byte-level BPE file without a normalizer is needed")
    if split["add_prefix_space"] or not split.get("use_regex", True):
        raise ValueError("only the standard split pattern is compiled")
    vocab = model["vocab"]
    # the format's printable stand-ins of bytes: printable ones stand for themselves, the
    # others follow from code point 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    stand_in = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    ranks = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
    return {
        "merger": compile_merges(ranks, [vocab[stand_in[b]] for b in range(256)]),
        "special": [t["content"] for t in spec["added_tokens"]],
    }


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text_col: str = "text",
                 id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``path``: a tokenizer file that the driver reads; its compiled tables are broadcast
    (a vocabulary's size, whatever the corpus). The table is scanned once, without a shuffle.
    """
    spec = ship(docs.sparkSession, read_spec(path))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec())
        for batch in batches:
            sizes, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, _, data, offsets in text_slices(batch.column("text")):
                sizes.append(np.diff(offsets))
                counts.append(counter.count(data, offsets))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(sizes)), pa.array(n),
                 pa.array(n > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
