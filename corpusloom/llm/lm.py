"""Language-model scores of whole documents by a gated recurrent network.

Corpus counts. Every task counts the words of its training documents; summed per word over
the whole corpus they give the unigram base and the network's vocabulary: the most frequent
words, an end mark, and groups for all other words (a hash of their first two bytes). A
word outside the vocabulary has the group's probability times its add-0.1 share of the
group, so every text has a proper probability.

Network. A gated recurrent unit in numpy; the output softmax is factored by class (class of
the token, then token in the class). It is trained by back-propagation truncated to windows,
with the state carried from window to window, on all training documents, which are cut into
stretches and stored as tokens. Training is data-parallel: in each round a part of the
stretches is dealt to lanes, every lane starts from the broadcast weights and trains on its
own stretches inside a task, and the lanes' weights are averaged by their tokens, piece by
piece, in tasks as well. Only the averaged weights, of fixed size, come to the driver. Every
stretch is used at least once; few stretches are passed over up to ``EPOCHS`` times. Initial
biases are the unigram frequencies.

Scoring. One scan: many documents side by side, window by window with the state carried, so
a document's log-likelihood is that of its whole text however long it is. The counts of the
most frequent words are broadcast (at most ``HEAD`` rows). Rarer words of a document, a small
part of all, are joined with the counts by a shuffle and summed per document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.langid import in_fold
from corpusloom.llm.textops import SLICE, U64, Scanner, longs, mix, ship, sums, text_slices
from corpusloom.session import materialize, new_table_path

HEAD = 1 << 18
CLASSES, PER_CLASS, HIDDEN = 64, 64, 16
VOCABULARY = CLASSES * PER_CLASS
GROUPS = 255
BEGIN_BITS = 20  # of a word's hash, by which its place in the head is looked up
END = 0  # the end mark, which also stands before a text's first word
WINDOW, WINDOWS = 32, 4  # steps of truncated back-propagation; windows per training stretch
STRETCHES = 4096  # so many stretches have EPOCHS passes; more have fewer, but at least one
EPOCHS = 4
BATCH = 256
CACHED = 2048  # rows of logits that stay in the processor's caches
ROUNDS = 8  # times that the lanes' weights are averaged in a pass
LANE = 4096  # least stretches of a lane where there are so many
LANES = 64  # lanes of a round from which on lanes grow, up to four times LANE
PIECES = 32  # the weights are averaged in so many groups
SMOOTHING = 0.1
HELD_WORDS = 1 << 20  # distinct words that a counting task holds before it hands them on


def word_groups(scanner: Scanner, data, starts, ends) -> np.ndarray:
    """Group of each word, from 0: a hash of its first two bytes."""
    first = scanner.lower[data[starts]].astype(np.uint32)
    second = scanner.lower[data[np.minimum(starts + 1, len(data) - 1)]].astype(np.uint32)
    key = first * 256 + np.where(ends - starts > 1, second, np.uint32(0))
    return (((key * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(GROUPS)).astype(np.int32)


def runs(values: np.ndarray):
    """(distinct values, an order that sorts, where in it each value begins)."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    return ordered[first], order, first


def word_totals(texts: DataFrame) -> DataFrame:
    """word (64-bit hash), grp, n: summed over all of ``texts`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        held, size = [], 0

        def merged():
            words, groups, n = (np.concatenate(part) for part in zip(*held, strict=True))
            unique, order, first = runs(words)
            return unique, groups[order[first]], np.add.reduceat(n[order], first)

        def record(words, groups, n):
            return pa.RecordBatch.from_arrays(
                [longs(words), pa.array(groups), pa.array(n)], names=["word", "grp", "n"])

        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE >> 1):
                starts, ends, _ = scanner.spans(data, offsets)
                if not len(starts):
                    continue
                words = scanner.hashes(data, starts, ends)
                unique, order, first = runs(words)
                one = order[first]
                held.append((unique, word_groups(scanner, data, starts[one], ends[one]),
                             np.diff(first, append=len(words))))
                size += len(unique)
                if size > 2 * HELD_WORDS:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD_WORDS:
                        yield record(*held[0])
                        held, size = [], 0
        if held:
            yield record(*merged())

    parts = texts.select("text").mapInArrow(run, "word long, grp int, n long")
    return parts.groupBy("word", "grp").agg(F.sum("n").alias("n"))


class Lexicon:
    """Corpus totals, the vocabulary and the counts of the most frequent words."""

    def __init__(self, counts: DataFrame, documents: int):
        """``counts`` as of ``word_totals``; ``documents``: training texts, each has an end."""
        words, total = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        self.ends = documents
        self.total = (total or 0) + documents
        self.distinct = words + (documents > 0)
        self.base = math.log10(self.total + SMOOTHING * (self.distinct + 1))
        # the count that at most HEAD words reach, from a histogram of fixed size
        level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
        rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect()
        held, least = 0, 1 << 30
        for row in sorted(rows, key=lambda r: -r["level"]):
            held += row["words"]
            if held > HEAD:
                break
            least = row["level"]
        head = counts.filter(level >= least).toArrow()
        order = np.argsort(head["word"].to_numpy().view(U64))
        self.head = head["word"].to_numpy().view(U64)[order]
        self.head_n = head["n"].to_numpy()[order].astype(np.float64)
        # vocabulary: 0 is the end mark, then groups, then words by count
        room = VOCABULARY - 1 - GROUPS
        best = np.lexsort((self.head, -self.head_n))[:room]
        self.head_id = np.full(len(self.head), -1, np.int32)
        self.head_id[best] = np.arange(len(best)) + 1 + GROUPS
        groups = counts.groupBy("grp").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
        table = groups.toArrow()
        group_n, group_v = np.zeros(GROUPS), np.zeros(GROUPS)
        group_n[table["grp"].to_numpy()] = table["n"].to_numpy()
        group_v[table["grp"].to_numpy()] = table["v"].to_numpy()
        grp = head["grp"].to_numpy()[order][best]
        group_n -= np.bincount(grp, self.head_n[best], GROUPS)[:GROUPS]
        group_v -= np.bincount(grp, minlength=GROUPS)[:GROUPS]
        self.group_log = np.log10(group_n + SMOOTHING * (group_v + 1))
        weight = np.full(VOCABULARY, SMOOTHING)
        weight[END] += documents
        weight[1 : 1 + GROUPS] += group_n
        weight[1 + GROUPS : 1 + GROUPS + len(best)] += self.head_n[best]
        weight[1 + GROUPS + len(best) :] = 1e-9  # unused places
        # frequent tokens are dealt over the classes, so that no class holds them all
        rank = np.argsort(-weight, kind="stable")
        place = np.empty(VOCABULARY, np.int32)
        deal = np.arange(VOCABULARY)
        place[rank] = (deal % CLASSES) * PER_CLASS + deal // CLASSES
        self.place = place
        self.weight = weight
        self.starts = self.head_log = None

    def head_logs(self) -> np.ndarray:
        """log10 of each head word's smoothed count, made once per task."""
        if self.head_log is None:
            self.head_log = np.log10(self.head_n + SMOOTHING)
        return self.head_log

    def look_up(self, words: np.ndarray, groups: np.ndarray):
        """(token of each word, its place in the head or -1)."""
        if len(self.head):
            last = len(self.head) - 1
            if self.starts is None:  # the first word with each beginning, made once per task
                begin = np.arange(1 << BEGIN_BITS, dtype=U64) << U64(64 - BEGIN_BITS)
                self.starts = np.minimum(np.searchsorted(self.head, begin), last)
            at = self.starts[words >> U64(64 - BEGIN_BITS)]
            low = np.flatnonzero(self.head[at] < words)
            while len(low):
                low = low[at[low] < last]
                at[low] += 1
                low = low[self.head[at[low]] < words[low]]
            at = np.where(self.head[at] == words, at, -1)
            token = np.where(at >= 0, self.head_id[at], -1)
        else:
            at = np.full(len(words), -1)
            token = at
        return np.where(token >= 0, token, groups + 1).astype(np.int32), at


class Network:
    """Gated recurrent unit with a class-factored softmax; float32 throughout."""

    def __init__(self, lexicon: Lexicon, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.place = lexicon.place
        weight = np.empty(VOCABULARY)
        weight[lexicon.place] = lexicon.weight
        by_class = weight.reshape(CLASSES, PER_CLASS)
        of_class = by_class.sum(axis=1)
        self.p = {
            "inputs": draw(VOCABULARY, 3 * HIDDEN),  # token embedding and input weights
            "state": draw(HIDDEN, 3 * HIDDEN),
            "class_w": draw(HIDDEN, CLASSES),
            "class_b": np.log(of_class / of_class.sum()).astype(np.float32),
            "token_w": draw(CLASSES, HIDDEN, PER_CLASS),
            "token_b": np.log(by_class / of_class[:, None]).astype(np.float32),
        }

    def step(self, tokens: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Next states after reading ``tokens`` (in place order)."""
        n = HIDDEN
        x = np.take(self.p["inputs"], tokens, axis=0)
        s = h @ self.p["state"]
        gates = x[:, : 2 * n] + s[:, : 2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        new = gates[:, n:] * s[:, 2 * n :]
        new += x[:, 2 * n :]
        np.tanh(new, out=new)
        h = h - new
        h *= gates[:, :n]
        h += new
        return h

    def _bounded(self, weights: str, bias: str) -> bool:
        """Whether no state, whose numbers are within 1, leads to a logit beyond 60."""
        return float((np.abs(self.p[weights]).sum(axis=-2) + self.p[bias]).max()) < 59

    def log_likelihood(self, states: np.ndarray, targets: np.ndarray, grads: dict | None = None):
        """Natural log-probability of each target; with ``grads``, the gradient of their
        negative sum is added there and that to the states returned as well."""
        p = self.p
        cls, inner = targets // PER_CLASS, targets % PER_CLASS
        out = np.empty(len(targets), states.dtype)
        back = np.empty_like(states) if grads is not None else None
        ones = np.ones(max(CLASSES, PER_CLASS), states.dtype)
        cut_classes = not self._bounded("class_w", "class_b")
        cut_tokens = not self._bounded("token_w", "token_b")
        for low in range(0, len(targets), CACHED):
            part = slice(low, low + CACHED)
            own, at = states[part], np.arange(len(targets[part]))
            logits = own @ p["class_w"]
            logits += p["class_b"]
            if cut_classes:
                np.minimum(logits, 60, out=logits)
            picked = logits[at, cls[part]]
            np.exp(logits, out=logits)
            total = logits @ ones[:CLASSES]
            out[part] = picked - np.log(total)
            if grads is not None:
                logits *= (1 / total)[:, None]
                logits[at, cls[part]] -= 1
                grads["class_w"] += own.T @ logits
                grads["class_b"] += logits.sum(axis=0)
                back[part] = logits @ p["class_w"].T
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
        states, inner = states[order], inner[order]
        picked, totals = np.empty(len(targets), states.dtype), np.empty(len(targets), states.dtype)
        more = np.empty_like(states) if grads is not None else None
        line = np.arange(CACHED)
        for c in range(CLASSES):
            weights, bias = p["token_w"][c], p["token_b"][c]
            for low in range(edges[c], edges[c + 1], CACHED):
                part = slice(low, min(low + CACHED, edges[c + 1]))
                own, place = states[part], (line[: part.stop - low], inner[part])
                e = own @ weights
                e += bias
                if cut_tokens:
                    np.minimum(e, 60, out=e)
                picked[part] = e[place]
                np.exp(e, out=e)
                total = np.matmul(e, ones[:PER_CLASS], out=totals[part])
                if grads is not None:
                    e *= (1 / total)[:, None]
                    e[place] -= 1
                    grads["token_w"][c] += own.T @ e
                    grads["token_b"][c] += e.sum(axis=0)
                    np.matmul(e, weights.T, out=more[part])
        out[order] += picked - np.log(totals)
        if grads is None:
            return out
        back[order] += more
        return out, back

    def window_gradients(self, inputs, targets, live, h):
        """(gradients of the mean loss, last state, mean log-likelihood) of one window."""
        n, (rows, steps) = HIDDEN, inputs.shape
        state, turned = self.p["state"], np.ascontiguousarray(self.p["state"].T)
        x = np.take(self.p["inputs"], inputs.T, axis=0)  # step by step
        before = np.empty((steps, rows, n), state.dtype)
        after, new, rest = np.empty_like(before), np.empty_like(before), np.empty_like(before)
        gates = np.empty((steps, rows, 2 * n), state.dtype)
        for t in range(steps):
            before[t] = h
            s = h @ state
            g = np.add(x[t, :, : 2 * n], s[:, : 2 * n], out=gates[t])
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            rest[t] = s[:, 2 * n :]
            c = np.multiply(g[:, n:], rest[t], out=new[t])
            c += x[t, :, 2 * n :]
            np.tanh(c, out=c)
            h = np.subtract(h, c, out=after[t])
            h *= g[:, :n]
            h += c
        grads = {name: np.zeros_like(value) for name, value in self.p.items()}
        out, back = self.log_likelihood(after[live.T], targets.T[live.T], grads)
        d_after = np.zeros_like(after)
        d_after[live.T] = back
        z, r = gates[:, :, :n], gates[:, :, n:]
        to_new = (1 - z) * (1 - new * new)
        to_z = (before - new) * z * (1 - z)
        to_r = rest * r * (1 - r)
        d_x = np.empty((steps, rows, 3 * n), state.dtype)
        d_s = np.empty_like(d_x)
        d = np.zeros((rows, n), state.dtype)
        for t in range(steps - 1, -1, -1):
            d += d_after[t]
            own = np.multiply(d, to_new[t], out=d_x[t, :, 2 * n :])
            np.multiply(d, to_z[t], out=d_x[t, :, :n])
            np.multiply(own, to_r[t], out=d_x[t, :, n : 2 * n])
            d_s[t, :, : 2 * n] = d_x[t, :, : 2 * n]
            np.multiply(own, r[t], out=d_s[t, :, 2 * n :])
            d *= z[t]
            d += d_s[t] @ turned
        grads["state"] += before.reshape(-1, n).T @ d_s.reshape(-1, 3 * n)
        read = inputs.T.ravel()
        order = np.argsort(read.astype(np.int16), kind="stable")
        first = np.flatnonzero(np.diff(read[order], prepend=-1))
        grads["inputs"][read[order][first]] = np.add.reduceat(
            d_x.reshape(-1, 3 * n)[order], first, axis=0)
        count = max(1, int(live.sum()))
        for value in grads.values():
            value /= count
        return grads, h, float(out.sum()) / count

    def train(self, stretches: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.02,
              seed: int = 5, moments: list | None = None, span: tuple = (0.0, 1.0)) -> list:
        """Adam over stretches (token arrays that begin with the token before the first).

        ``moments`` are those that an earlier call gave back; ``span`` is the part of the
        whole training that this call does, by which the rate falls.
        """
        if moments is None:
            moments = [{k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2)] + [0]
        if not stretches:
            return moments
        first, second, before = moments
        rng = np.random.default_rng(seed)
        batches = -(-len(stretches) // BATCH)  # of even sizes, as all count alike
        done, steps = 0, epochs * WINDOWS * batches
        for _ in range(epochs):
            for rows in np.array_split(rng.permutation(len(stretches)), batches):
                part = [stretches[i] for i in rows]
                block = np.full((len(part), WINDOW * WINDOWS + 1), -1, np.int64)
                for row, tokens in zip(block, part, strict=True):
                    row[: len(tokens)] = self.place[tokens]
                h = np.zeros((len(part), HIDDEN), np.float32)
                for w in range(WINDOWS):
                    cut = block[:, w * WINDOW : (w + 1) * WINDOW + 1]
                    live = cut[:, 1:] >= 0
                    if not live.any():
                        break
                    grads, h, _ = self.window_gradients(
                        np.maximum(cut[:, :-1], 0), np.maximum(cut[:, 1:], 0), live, h)
                    done += 1
                    at = span[0] + (span[1] - span[0]) * done / (steps + 1)
                    pace = rate * max(0.05, 1 - at)
                    rise = np.float32(pace / (1 - 0.9 ** (before + done)))
                    scale = np.float32(1 / math.sqrt(1 - 0.999 ** (before + done)))
                    for name, g in grads.items():  # in place, each array a few times
                        np.clip(g, -1, 1, out=g)
                        m, v = first[name], second[name]
                        m *= np.float32(0.9)
                        v *= np.float32(0.999)
                        m += np.float32(0.1) * g
                        np.square(g, out=g)
                        g *= np.float32(0.001)
                        v += g
                        np.sqrt(v, out=g)
                        g *= scale
                        g += np.float32(1e-8)
                        np.divide(m, g, out=g)
                        g *= rise
                        self.p[name] -= g
        return [first, second, before + done]

    def score(self, tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log10 probability of each token sequence (``bounds`` as offsets), in windows."""
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        lengths, begin = lengths[order], bounds[:-1][order]
        result = np.zeros(len(order))
        h = np.zeros((len(order), HIDDEN), np.float32)
        last = np.full(len(order), self.place[END], np.int64)
        tokens = self.place[tokens].astype(np.int64)
        for low in range(0, int(lengths[0]) if len(lengths) else 0, WINDOW):
            active = int(np.searchsorted(-lengths, -low, "left"))
            states, targets, owners = [], [], []
            for t in range(low, low + WINDOW):
                active = int(np.searchsorted(-lengths, -t, "left"))
                if not active:
                    break
                h = h[:active]
                h = self.step(last[:active], h)
                target = tokens[begin[:active] + t]
                states.append(h)
                targets.append(target)
                owners.append(np.arange(active))
                last = target
            states, targets = np.concatenate(states), np.concatenate(targets)
            owners = np.concatenate(owners)
            found = self.log_likelihood(states, targets)
            result[: owners.max() + 1] += np.bincount(owners, found)
        out = np.empty(len(order))
        out[order] = result / math.log(10)
        return out


def _stretches(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """draw, tokens: all stretches of all training texts.

    ``texts``: uid, text. A stretch starts at a text's begin or at a multiple of its length
    and has the token before its first, so every token and end mark is a target once. Rows
    that repeat a text in a batch are drawn apart.
    """
    size = WINDOW * WINDOWS
    shipped = ship(texts.sparkSession, lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, lexicon = Scanner(), shipped()
        for batch in batches:
            uid = batch.column("uid").to_numpy().view(U64)
            order = np.argsort(uid, kind="stable")
            head = np.diff(uid[order], prepend=~uid[order[:1]]) != 0
            copy = np.empty(len(uid), U64)
            copy[order] = np.arange(len(uid)) - np.maximum.accumulate(
                np.where(head, np.arange(len(uid)), 0))
            uid = uid ^ mix(copy, 3)
            for low, _, data, offsets in text_slices(batch.column("text"), SLICE >> 1):
                starts, ends, bounds = scanner.spans(data, offsets)
                words = scanner.hashes(data, starts, ends)
                token, _ = lexicon.look_up(words, word_groups(scanner, data, starts, ends))
                counts = np.diff(bounds) + 1  # with the end mark
                # an end mark before and after each text
                token = np.insert(token, np.concatenate([bounds[:-1], bounds[1:]]), END)
                begin = np.concatenate([[0], np.cumsum(counts + 1)])[:-1]
                parts = -(-counts // size)
                row = np.repeat(np.arange(len(counts)), parts)
                number = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                lengths = np.minimum(size, counts[row] - number * size) + 1
                edges = np.concatenate([[0], np.cumsum(lengths)])
                at = np.arange(edges[-1]) + np.repeat(
                    begin[row] + number * size - edges[:-1], lengths)
                draw = mix(uid[low + row] ^ mix(number.astype(U64), 1), 2)
                yield pa.RecordBatch.from_arrays(
                    [longs(draw), pa.ListArray.from_arrays(
                        pa.array(edges.astype(np.int32)), pa.array(token[at].astype(np.int16)))],
                    names=["draw", "tokens"])

    return texts.mapInArrow(run, "draw long, tokens array<smallint>")


def _lane_trainer(shipped, epochs: int, seed: int, span: tuple):
    """Trains on the stretches of one lane; gives weights and moments in pieces."""

    def run(table: pa.Table) -> pa.Table:
        network, moments = shipped()
        lengths = table["tokens"].combine_chunks().value_lengths().to_numpy()
        order = np.lexsort((lengths, table["draw"].to_numpy()))
        column = table["tokens"].combine_chunks()
        values, edges = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lengths)])
        own = [values[edges[i] : edges[i + 1]] for i in order]
        first, second, done = network.train(own, epochs, seed=seed, moments=moments, span=span)
        flat = np.concatenate([group[name].ravel() for group in (network.p, first, second)
                               for name in network.p])
        pieces = np.array_split(flat, PIECES)
        count = int(lengths.sum() - len(lengths)) * epochs
        return pa.table({
            "lane": pa.array(np.full(PIECES, table["lane"][0].as_py(), np.int32)),
            "piece": pa.array(np.arange(PIECES, dtype=np.int32)),
            "targets": pa.array(np.full(PIECES, count, np.int64)),
            "done": pa.array(np.full(PIECES, done, np.int64)),
            "numbers": pa.array([p.tobytes() for p in pieces], pa.binary())})

    return run


def _average(table: pa.Table) -> pa.Table:
    """One piece of the lanes' numbers, averaged by the targets of each lane."""
    order = np.argsort(table["lane"].to_numpy())
    targets = table["targets"].to_numpy()
    total = np.zeros(len(table["numbers"][0].as_py()) // 4)
    for i in order.tolist():
        total += targets[i] * np.frombuffer(table["numbers"][i].as_py(), np.float32)
    mean = (total / targets.sum()).astype(np.float32)
    return pa.table({
        "piece": table["piece"].slice(0, 1),
        "targets": pa.array([int(targets.sum())]),
        "done": pa.array([int(table["done"].to_numpy().max())]),
        "numbers": pa.array([mean.tobytes()], pa.binary())})


def fit(network: Network, texts: DataFrame, lexicon: Lexicon, stretches: int = STRETCHES,
        lane: int = LANE) -> int:
    """Trains ``network`` on all ``texts`` (uid, text); gives the targets it was trained on.

    Passes over a text count. Each round's lanes train in tasks from the same weights.
    """
    spark = texts.sparkSession
    part = F.pmod(F.xxhash64("draw"), F.lit(ROUNDS)).cast("int")
    path = new_table_path(spark, "stretches")
    _stretches(texts, lexicon).withColumn("part", part).write.partitionBy("part").parquet(path)
    stored = spark.read.schema("draw long, tokens array<smallint>, part int").parquet(path)
    total = stored.count()
    if not total:
        return 0
    passes = min(EPOCHS, max(1, -(-EPOCHS * stretches // total)))
    # few stretches are one lane, which makes all passes by itself
    whole = total <= lane
    rounds = 1 if whole else passes * ROUNDS
    lanes = 1 if whole else max(1, min(-(-total // (ROUNDS * lane)),
                                       max(LANES, -(-total // (ROUNDS * 4 * lane)))))
    moments, trained = None, 0
    names = list(network.p)
    shapes = {name: value.shape for name, value in network.p.items()}
    for number in range(rounds):
        shipped = ship(spark, (network, moments))
        span = (number / rounds, (number + 1) / rounds)
        own = stored if whole else stored.filter(F.col("part") == number % ROUNDS)
        deal = F.pmod(F.xxhash64("draw", F.lit(number)), F.lit(lanes)).cast("int")
        made = own.select(deal.alias("lane"), "draw", "tokens").groupBy("lane").applyInArrow(
            _lane_trainer(shipped, passes if whole else 1, 5 + number, span),
            "lane int, piece int, targets long, done long, numbers binary")
        rows = made.groupBy("piece").applyInArrow(
            _average, "piece int, targets long, done long, numbers binary").collect()
        if not rows:
            continue
        rows.sort(key=lambda r: r["piece"])
        flat = np.concatenate([np.frombuffer(r["numbers"], np.float32) for r in rows])
        groups = []
        for group in np.split(flat, 3):
            cuts = np.cumsum([math.prod(shapes[n]) for n in names])[:-1]
            groups.append({n: x.reshape(shapes[n]).copy()
                           for n, x in zip(names, np.split(group, cuts), strict=True)})
        network.p, moments = groups[0], [groups[1], groups[2], rows[0]["done"]]
        trained += rows[0]["targets"]
    return trained


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    stretches: int = STRETCHES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Learns from all documents outside the held-out tenth (crc32 of the id); all are scored.
    Null text counts as empty and has one token, the end; a null id is not held out;
    repeated rows count, and are scored, as often as they come; other columns are ignored;
    an empty table gives an empty result. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("doc_id"), in_fold(F.col(id_col), 10, 0).alias("held_out"),
        F.col(text_col).alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = materialize(word_totals(training), "words")
    lexicon = Lexicon(counts, training.select("held_out").count())
    network = Network(lexicon)
    keyed = training.select(F.xxhash64("doc_id", "text").alias("uid"), "text")
    fit(network, keyed, lexicon, stretches)
    shipped = ship(spark, (lexicon, network))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        lexicon, network = shipped()
        for batch in batches:
            tokens, lengths, known, base, inner, rare = [], [], [], [], [], []
            for _, _, data, offsets in text_slices(batch.column("text"), SLICE >> 1):
                starts, ends, bounds = scanner.spans(data, offsets)
                words = scanner.hashes(data, starts, ends)
                groups = word_groups(scanner, data, starts, ends)
                token, at = lexicon.look_up(words, groups)
                held = at >= 0
                logs = np.zeros(len(words))
                logs[held] = lexicon.head_logs()[at[held]]
                outside = token <= GROUPS  # words that their group stands for
                group = np.clip(token - 1, 0, GROUPS - 1)
                share = np.where(outside, logs - lexicon.group_log[group], 0.0)
                known.append(sums(held.astype(np.int64), bounds))
                base.append(sums(logs, bounds))
                inner.append(sums(share, bounds))
                missing = words[~held]
                edges = np.concatenate([[0], np.cumsum(sums((~held).astype(np.int64), bounds))])
                rare.append(pa.ListArray.from_arrays(
                    pa.array(edges.astype(np.int32)), longs(missing)))
                ends_at = bounds[1:]
                tokens.append(np.insert(token, ends_at, END))
                lengths.append(np.diff(bounds) + 1)
            if not lengths:
                continue
            lengths = np.concatenate(lengths)
            model = network.score(
                np.concatenate(tokens), np.concatenate([[0], np.cumsum(lengths)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"),
                 pa.array(lengths.astype(np.int64)), pa.array(np.concatenate(known)),
                 pa.array(np.concatenate(base)), pa.array(model + np.concatenate(inner)),
                 pa.concat_arrays(rare)],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "model", "rare"])

    scanned = rows.mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, "
        "model double, rare array<long>")
    scored = materialize(
        scanned.withColumn("row", F.monotonically_increasing_id()), "scored")
    words = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(
        F.count(F.lit(1)).alias("times"))
    n = F.coalesce("n", F.lit(0))
    tails = words.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("tail_known"),
        F.sum(F.log10(n + SMOOTHING) * F.col("times")).alias("tail"))
    end = math.log10(lexicon.ends + SMOOTHING)
    tail = F.coalesce("tail", F.lit(0.0))
    return scored.join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0)) + F.lit(int(lexicon.ends > 0)))
        .cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("base") + tail + end - F.col("n_tokens") * F.lit(lexicon.base))
        .alias("base_score"),
        (F.col("model") + tail).alias("score"))
