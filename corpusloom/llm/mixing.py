"""Mixing sources to target weights by Sainte-Lague apportionment of equal token blocks.

1. Targets: all words are shared out by source weight; a target stops at ``most_repeats``
   times its source's words and the excess is shared again by weight among the others.
2. The mix is cut into equal blocks of tokens. Blocks go to sources one by one, each to the
   highest quotient target / (2 * seats + 1). Only the quotients near a source's share can
   decide, so the seats below are given at once and the rest is ranked.
3. A source's blocks are apportioned to its shards (hash buckets of documents, as many as
   its row count asks for) in the same way, by the shard's words, which gives integer quotas
   per source and shard. The words by which a source's blocks miss its target, about a block
   at most, are settled among its shards in their order, within what a shard can give.
4. In a shard, documents stand in a seeded order and the words are taken from that stream:
   whole passes first, then the leading blocks of it.

Only (id, source, size) rows are shuffled, sums are combined before the shuffle, and
ordered work happens in (source, shard) groups of about ``shard_rows`` documents, so a
source with a third of all rows is spread like the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.textops import Scanner, text_slices, word_counts
from corpusloom.session import materialize

MOST_REPEATS = 3
BLOCK_TOKENS = 1024
SHARD_ROWS = 4096


def source_targets(sources: DataFrame, weight: Column | None = None,
                   most_repeats: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with place, weight and target.

    Default weights: 1, 2, 3, repeating, over the sources by code point, null last.
    """
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    placed = sources.withColumn("place", F.row_number().over(by_name))
    placed = placed.withColumn(
        "weight", (weight if weight is not None else F.pmod(F.col("place") - 1, F.lit(3)) + 1)
        .cast("double"))
    # Sources reach their limit in the order of size / weight: if those up to one are full,
    # the level of the rest follows from what they leave.
    full = F.col("source_size") * F.lit(float(most_repeats))
    order = Window.orderBy(full / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    leveled = placed.withColumn("_level", level)
    # the first source that its level does not fill sets the level of all after it
    open_ = F.col("_level") * F.col("weight") < full
    common = F.min(F.when(open_, F.struct(full / F.col("weight"), "place", "_level"))).over(every)
    return leveled.withColumn("_common", common["_level"]).withColumn(
        "target", F.least(full, F.coalesce(F.col("_common") * F.col("weight"), full))
    ).drop("_level", "_common")


def apportion(groups: DataFrame, votes: Column, seats: Column, within: list[str],
              tie: str) -> DataFrame:
    """``groups`` with ``quota``: ``seats`` of each ``within`` group by highest quotients.

    Equal quotients go to the smaller ``tie``. A quota lies within n / 2 times its share of
    the exact proportion, n being the number of competitors, so only those quotients are
    made and ranked; all lower ones are seats for certain.
    """
    w = Window.partitionBy(*within)
    base = groups.withColumn("_votes", votes.cast("double")).withColumn("_seats", seats)
    share = F.try_divide(F.col("_votes"), F.sum("_votes").over(w))
    rows = base.withColumn("_share", F.coalesce(share, F.lit(0.0))).withColumn(
        "_n", F.count(F.lit(1)).over(w)
    )
    reach = F.ceil(F.col("_share") * F.col("_n") / 2) + 2
    rows = rows.withColumn("_sure", F.greatest(
        F.floor(F.col("_share") * F.col("_seats")) - reach, F.lit(0)).cast("long"))
    rows = rows.withColumn("_open", F.col("_seats") - F.sum("_sure").over(w))
    ranked = rows.filter("_votes > 0").select(
        *within, tie, "_open", "_votes",
        F.explode(F.sequence(F.col("_sure"), F.col("_sure") + (2 * reach + 1).cast("long")))
        .alias("_seat"),
    )
    quotient = F.col("_votes") / (2 * F.col("_seat") + 1)
    order = Window.partitionBy(*within).orderBy(F.desc(quotient), tie, "_seat")
    won = (
        ranked.withColumn("_rank", F.row_number().over(order)).filter("_rank <= _open")
        .groupBy(*within, tie).agg(F.count(F.lit(1)).alias("_won"))
    )
    return (
        rows.join(won.withColumnsRenamed({c: f"_w_{c}" for c in [*within, tie]}),
                  [F.col(c).eqNullSafe(F.col(f"_w_{c}")) for c in [*within, tie]], "left")
        .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .select(*groups.columns, "quota")
    )


def _settled(shares: DataFrame, limit: Column, block_tokens: int) -> DataFrame:
    """``shares`` with ``take``: the words of each shard, which sum up to the source's target.

    A shard gives its blocks, ``limit`` at most. What the target has more is taken from the
    shards in their order as far as their limits allow; what it has less is left out likewise.
    """
    every = Window.partitionBy("place")
    before = every.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    given = F.least(limit, F.col("quota") * block_tokens).cast("long")
    rows = shares.withColumn("_given", given).withColumn("_room", limit.cast("long") - given)
    gap = F.round("target").cast("long") - F.sum("_given").over(every)

    def part(amount: Column, room: str) -> Column:
        earlier = F.coalesce(F.sum(room).over(before), F.lit(0))
        return F.least(F.col(room), F.greatest(F.lit(0), amount - earlier))

    take = F.col("_given") + part(gap, "_room") - part(-gap, "_given")
    return rows.withColumn("take", take).drop("_given", "_room")


def mix_sources(docs: DataFrame, most_repeats: int = MOST_REPEATS, seed: int = 0,
                block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS,
                id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, shard, quota.

    ``row_col``: a row number to carry along, as column row (else null).

    ``size``: words of the text (null: 0); ``taken``: words that the mix takes of the
    document, repeats counted, at most ``most_repeats`` times its size. A null source is a
    source of its own; null ids are kept; repeated rows are documents of their own, and
    which of equal rows is taken does not matter; an empty table gives an empty result.
    A source's taken words are its target, rounded, at any size of the input; ``quota`` counts
    the whole blocks among them.
    """
    sizes = materialize(word_counts(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                    F.col(row_col).alias("row") if row_col else F.lit(None).cast("long").alias("row"),
                    F.col(text_col).alias("text")), ["doc_id", "source", "row"]), "mix-sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    counts = sizes.groupBy(F.col("source").alias("_source")).agg(
        F.ceil(F.count(F.lit(1)) / shard_rows).alias("_shards"))
    # a hash of id and size: rows that repeat one id are spread if their texts differ
    sizes = sizes.join(counts, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "source", "row", "size",
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed)), "_shards").cast("int").alias("shard"))
    groups = sizes.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    groups = materialize(groups, "mix-groups")
    by_source = source_targets(
        groups.groupBy("source").agg(F.sum("shard_size").alias("source_size")),
        most_repeats=most_repeats)
    blocks = F.lit(total // block_tokens).cast("long")
    quotas = materialize(
        apportion(by_source.withColumn("all", F.lit(0)), F.col("target"), blocks, ["all"],
                  "place").drop("all").withColumnRenamed("quota", "source_quota"),
        "mix-quotas")
    shard_rows_ = groups.join(
        quotas.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))
    ).drop("_source")
    shares = apportion(shard_rows_, F.col("shard_size"), F.col("source_quota"), ["place"], "shard")
    shares = materialize(
        _settled(shares, F.col("shard_size") * most_repeats, block_tokens), "mix-shares"
    ).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size",
             "source_size", "target", "quota", "take")
    joined = sizes.join(
        shares, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))
    )
    seeded = Window.partitionBy("_source", "_shard").orderBy(
        F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "size"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum("size").over(seeded) - F.col("size")
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("take") / F.col("shard_size")))
    rest = F.col("take") - F.coalesce(passes, F.lit(0)) * F.col("shard_size")
    taken = F.coalesce(passes, F.lit(0)) * F.col("size") + F.least(
        F.col("size"), F.greatest(F.lit(0), rest - F.col("_start")))
    return joined.withColumn("_start", start).select(
        "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source",
        "shard", "quota", "row")


def apply_mix(docs: DataFrame, stored_row: str | None = None, **options) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: repeated for every whole pass, and once
    more cut after the words of a partial pass; all columns of ``docs``.

    Options are those of ``mix_sources``. ``stored_row``: a column of ``docs``, a stored
    table, with a number of each row; without it the rows are numbered and stored here, as
    numbers made anew in each scan differ when files are split differently. ``n_chars``, if there is such a column, follows the text.
    """
    text_col = options.get("text_col", "text")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    if stored_row:
        rows = rows.withColumn("_row", F.col(names[docs.columns.index(stored_row)]))
    else:
        rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    place = {c: names[docs.columns.index(options.get(f"{c}_col", d))]
             for c, d in (("id", "doc_id"), ("text", "text"), ("source", "source"))}
    options = {k: v for k, v in options.items() if not k.endswith("_col")}
    taken = mix_sources(
        rows, id_col=place["id"], text_col=place["text"], source_col=place["source"],
        row_col="_row", **options)
    taken = taken.filter("taken > 0").select(
        F.col("row").alias("_row"), F.floor(F.col("taken") / F.col("size")).alias("_passes"),
        (F.col("taken") % F.col("size")).alias("_rest"))
    text = place["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            passes = batch.column("_passes").to_numpy()
            rest = batch.column("_rest").to_numpy()
            whole = batch.take(pa.array(np.repeat(np.arange(len(passes)), passes)))
            part = np.flatnonzero(rest)
            cut = batch.take(pa.array(part))
            texts = []
            column = cut.column(text)
            for low, high, data, offsets in text_slices(column):
                _, ends, bounds = scanner.spans(data, offsets)
                raw, stop = data.tobytes(), ends[bounds[:-1] + rest[part[low:high]] - 1]
                texts += [raw[a:b].decode() for a, b in zip(
                    offsets[:-1].tolist(), stop.tolist(), strict=True)]
            for rows_, column in ((whole, whole.column(text)), (cut, pa.array(texts, pa.string()))):
                yield pa.RecordBatch.from_arrays(
                    [column if n == text else rows_.column(n) for n in names], names=names)

    out = rows.join(taken, "_row")
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    out = out.select(*names, "_passes", "_rest").mapInArrow(run, kinds).toDF(*docs.columns)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length(f"`{text_col}`").cast(kind))
    return out
