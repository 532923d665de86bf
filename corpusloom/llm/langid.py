"""Language identification as inference of a mixture of languages per document.

Learning counts hashed byte 4-grams per language over all labelled training texts. A word's
likelihood in a language is the product over its n-grams. For each document,
expectation-maximisation estimates the languages' shares over its words; the set of
languages is then grown from the best single one, taking the next by share while the gain
in log-likelihood exceeds the penalty (Schwarz criterion), with the shares estimated anew.

Only counts leave the tasks: one row per (language, n-gram bucket) of a task, summed before
and after the shuffle. The model, at most ``MOST_LANGUAGES`` x ``BUCKETS`` numbers whatever
the corpus, is broadcast; prediction is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.textops import Scanner, ship, text_slices
from corpusloom.session import materialize

BUCKETS = 1 << 16
#: Bound of the broadcast model: beyond it the languages with the most text are learned.
MOST_LANGUAGES = 256
HELD_LANGUAGES = 32  # count tables that a task holds before it hands them on
SMOOTHING = 0.5
ROUNDS = 10
PART = 0.1  # share of a text from which on a language counts as one of its few
UNKNOWN = "und"


def in_fold(column, modulus: int, remainder: int):
    """crc32(id as text) mod ``modulus`` = ``remainder``; false for a null id."""
    fold = F.crc32(column.cast("string").cast("binary")) % modulus == remainder
    return F.coalesce(fold, F.lit(False))


def word_grams(scanner: Scanner, data: np.ndarray, offsets: np.ndarray):
    """(bucket of each byte of a word, word starts among them, words' offsets per text).

    The gram of a byte is the byte before it, itself and two after it; beyond the word's
    ends blanks stand in.
    """
    starts, ends, bounds = scanner.spans(data, offsets)
    if not len(starts):
        return np.empty(0, np.uint16), np.empty(0, np.int64), bounds
    low = scanner.lower[data]
    inside = scanner.solid[data]
    padded = np.full(len(low) + 3, 32, np.uint8)
    padded[1:-2] = np.where(inside, low, 32)
    a, b, c, d = (padded[j : j + len(low)].astype(np.uint32) for j in range(4))
    a[starts] = 32  # a text may follow another without a blank
    c[ends - 1] = 32
    d[ends - 1] = 32
    two = ends - 2 >= starts
    d[ends[two] - 2] = 32
    gram = a | (b << 8) | (c << 16) | (d << 24)
    bucket = ((gram * np.uint32(2654435761)) >> np.uint32(16)).astype(np.uint16)[inside]
    first = np.concatenate([[0], np.cumsum(ends - starts)[:-1]])
    return bucket, first, bounds


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, bucket, n over rows (lang, text) with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, held = Scanner(), {}

        def flush():
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                     pa.array(counts[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            codes = batch.column("lang").dictionary_encode()
            names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
            for low, high, data, offsets in text_slices(batch.column("text")):
                bucket, first, bounds = word_grams(scanner, data, offsets)
                edge = np.concatenate([first, [len(bucket)]])[bounds]
                row = np.repeat(codes[low:high], np.diff(edge))
                for code in np.unique(row):
                    name = names[code]
                    if name not in held:
                        if len(held) >= HELD_LANGUAGES:
                            yield from flush()
                        held[name] = np.zeros(BUCKETS, np.int64)
                    held[name] += np.bincount(bucket[row == code], minlength=BUCKETS)
        yield from flush()

    rows = docs.filter(F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text")
    parts = rows.mapInArrow(run, "lang string, bucket int, n long")
    return parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages (sorted) and the log-probabilities of n-gram buckets in each."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = counts + SMOOTHING
        self.logs = np.log(smooth / smooth.sum(axis=1, keepdims=True)).astype(np.float32)

    @classmethod
    def fit(cls, docs: DataFrame) -> Model:
        counts = materialize(gram_counts(docs), "grams")
        most = (
            counts.groupBy("lang").agg(F.sum("n").alias("all"))
            .orderBy(F.desc("all"), "lang").limit(MOST_LANGUAGES).toArrow()
        )
        languages = sorted(most["lang"].to_pylist())
        table = np.zeros((len(languages), BUCKETS))
        if languages:
            rows = counts.filter(F.col("lang").isin(languages)).toArrow()
            place = {name: i for i, name in enumerate(languages)}
            code = rows["lang"].combine_chunks().dictionary_encode()
            at = np.array([place[x] for x in code.dictionary.to_pylist()], np.int64)
            table[at[code.indices.to_numpy()], rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return cls(languages, table)


def _shares(relative, bounds, start, rounds: int):
    """EM over the words of several texts; ``start`` has a row of shares per text."""
    sizes = np.diff(bounds)
    shares = start
    for _ in range(rounds):
        joint = relative * np.repeat(shares, sizes, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, bounds[:-1], axis=0) / sizes[:, None]
        moved = np.abs(new - shares).max(initial=0)
        shares = new
        if moved < 1e-3:
            break
    return shares


def mixtures(model: Model, scanner: Scanner, data, offsets) -> np.ndarray:
    """Shares of the languages in each text; a row of zeros for a text without words."""
    count = len(model.languages)
    out = np.zeros((len(offsets) - 1, count))
    bucket, first, bounds = word_grams(scanner, data, offsets)
    filled = np.flatnonzero(np.diff(bounds))
    if not len(filled) or not count:
        return out
    bounds = np.concatenate([bounds[filled], bounds[-1:]])
    logs = np.empty((len(first), count), np.float32)
    for i, table in enumerate(model.logs):
        logs[:, i] = np.add.reduceat(table[bucket], first)
    top = logs.max(axis=1, keepdims=True)
    relative = np.maximum(np.exp(logs - top), np.float32(1e-30))
    logs -= top  # what every set of languages shares does not matter below
    texts = len(filled)
    full = _shares(relative, bounds, np.full((texts, count), 1 / count, np.float32), ROUNDS)
    single = np.add.reduceat(logs, bounds[:-1], axis=0, dtype=np.float64)
    best = single.argmax(axis=1)
    fit = single[np.arange(texts), best]
    shares = np.zeros((texts, count))
    shares[np.arange(texts), best] = 1
    chosen = shares > 0
    growing = np.arange(texts)
    sizes = np.diff(bounds)
    penalty = 0.5 * np.log(np.maximum(sizes, 2))
    for _ in range(count - 1):
        nxt = np.where(chosen[growing], -1, full[growing]).argmax(axis=1)
        # a language that no word favours cannot raise the likelihood
        useful = full[growing, nxt] * sizes[growing] > 0.5
        growing, nxt = growing[useful], nxt[useful]
        if not len(growing):
            break
        sets = chosen[growing]
        sets[np.arange(len(growing)), nxt] = True
        words = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in growing])
        edge = np.concatenate([[0], np.cumsum(sizes[growing])])
        part = relative[words]
        start = (sets / sets.sum(axis=1, keepdims=True)).astype(np.float32)
        new = _shares(part, edge, start, ROUNDS)
        likely = (part * np.repeat(new, sizes[growing], axis=0)).sum(axis=1)
        gain = np.add.reduceat(np.log(likely, dtype=np.float64), edge[:-1]) - fit[growing]
        won = gain > penalty[growing]
        growing = growing[won]
        shares[growing], chosen[growing] = new[won], sets[won]
        fit[growing] += gain[won]
    out[filled] = shares
    return out


def _predict(rows: DataFrame, names: list[str], model: Model) -> DataFrame:
    """``names`` of ``rows`` and the prediction for its column ``_text``."""
    shipped = ship(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, model = Scanner(), shipped()
        languages = [*model.languages, UNKNOWN]
        for batch in batches:
            parts = [np.zeros((0, len(model.languages)))]
            for _, _, data, offsets in text_slices(batch.column("_text")):
                parts.append(mixtures(model, scanner, data, offsets))
            shares = np.concatenate(parts)
            order = np.argsort(-shares, axis=1, kind="stable")
            sets, values = [], []
            for row, by in zip(shares, order, strict=True):
                by = by[row[by] > 0]
                sets.append([languages[i] for i in by])
                values.append(row[by].tolist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names),
                 pa.array([s[0] if s else UNKNOWN for s in sets], pa.string()),
                 pa.array([min(v[0], 1.0) if v else 0.0 for v in values], pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(values, pa.list_(pa.float64()))],
                names=[*names, "_pred", "_score", "_languages", "_shares"])

    kinds = "".join(f"{n} {rows.schema[n].dataType.simpleString()}, " for n in names)
    return rows.mapInArrow(
        run, f"{kinds}_pred string, _score double, _languages array<string>, "
        "_shares array<double>")


def _lettered(text_col: str):
    """The text, or null if it has no letter."""
    return F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col)).alias("_text")


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score (share of that language), languages and shares.

    ``languages``: the selected set, largest share first (ties by name), with ``shares``.
    ``und`` with score 0 and empty arrays: null or empty text, no letter in it, or no
    language learned. Rows are independent: repeated rows get equal results, an empty table
    an empty one; null ids pass through, and other columns are not looked at.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)),
        _lettered(text_col))
    return _predict(rows, names, model).select(
        *(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)),
        F.col("_pred").alias("lang_pred"), F.col("_score").alias("score"),
        F.col("_languages").alias("languages"), F.col("_shares").alias("shares"))


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text",
                    lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one language or a few.

    The languages that hold a share of ``PART`` or more must hold ``least`` together, so
    mixtures stay and texts that no few languages explain go, as do those that are ``und``.
    A null language is filled with the predicted one.
    """
    names = [f"_k{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text, lang = (names[docs.columns.index(c)] for c in (text_col, lang_col))
    has_letter = F.col(text).rlike(r"\p{L}")
    others = [n for n in names if n != text]
    found = _predict(
        rows.filter(has_letter).withColumnRenamed(text, "_text"), [*others, "_text"], model)
    held = F.aggregate(
        F.filter("_shares", lambda x: x >= PART), F.lit(0.0), lambda total, x: total + x)
    found = found.filter((F.col("_pred") != UNKNOWN) & (held >= least))
    found = found.withColumn(lang, F.coalesce(lang, "_pred"))
    return found.select(
        *(F.col("_text" if n == text else n).alias(c)
          for n, c in zip(names, docs.columns, strict=True)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang") -> DataFrame:
    """Learn from labelled rows outside the held-out fold and predict every row:
    doc_id, held_out, lang_pred, score, languages, shares."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), in_fold(F.col(id_col), 4, 2).alias("held_out"),
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = Model.fit(rows.filter(~F.col("held_out")))
    return identify(rows, model, ["doc_id", "held_out"])
