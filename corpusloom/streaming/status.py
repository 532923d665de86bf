"""Continuously maintained catalog status and corpus totals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.operators import catalog as cat
from corpusloom.session import materialize, new_table_path, remove_path

COMPACT_EVERY = 20


def latest_status(events: DataFrame) -> DataFrame:
    """Newest status per document; works on tables and on streams alike.

    The newest event is a running maximum, so state is one row per document and each
    task sends one row per document to the shuffle.
    """
    return events.groupBy("id").agg(
        F.max_by("status", "version").alias("status"), F.count("*").alias("n_updates")
    )


def latest_rows(events: DataFrame) -> DataFrame:
    """Newest status and counts per document, as ``latest_status`` for whole rows."""
    row = F.struct("status", "total_pages", "total_chunks")
    newest = events.groupBy("id").agg(F.max_by(row, "version").alias("row"))
    return newest.select("id", "row.*")


def corpus_totals(rows: DataFrame) -> DataFrame:
    """Documents per status, with pages and chunks of the completed ones.

    ``rows`` holds the current row of each document (see ``latest_rows``): an update
    replaces what the document counted before.
    """
    done = F.col("status") == "completed"
    return rows.groupBy("status").agg(
        F.count("*").alias("n_documents"),
        F.coalesce(F.sum(F.when(done, F.coalesce("total_pages", F.lit(0)))), F.lit(0)).alias("n_pages"),
        F.coalesce(F.sum(F.when(done, F.coalesce("total_chunks", F.lit(0)))), F.lit(0)).alias(
            "n_chunks"
        ),
    )


def maintain(stream: DataFrame, table: str, checkpoint: str, key: str | None):
    """Keep ``table`` current from an aggregated stream; returns the started query.

    With a key the query runs in update mode: a micro-batch appends its changed rows
    under its batch id, so a repeated batch overwrites itself, and ``current`` reads the
    newest row per key. Without a key every batch rewrites the whole (small) result. Every
    ``COMPACT_EVERY`` batches the earlier ones, which are committed by then, become one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % COMPACT_EVERY == 0:
            compact(batch.sparkSession, table, batch_id, key)
        target = f"{table}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(target)

    return (
        stream.writeStream.outputMode("update" if key else "complete")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def compact(spark: SparkSession, table: str, before: int, key: str | None) -> None:
    """Merge the batches before ``before`` into the last of them; repeating it is harmless."""
    rows = spark.read.parquet(table).where(F.col("batch") < before)
    numbers = sorted(r[0] for r in rows.select("batch").distinct().collect())
    if len(numbers) < 2:
        return
    if key:
        merged = materialize(cat.last_version(rows, "batch", key).drop("batch"), "snapshot")
        merged.write.mode("overwrite").parquet(f"{table}/batch={numbers[-1]}")
    for number in numbers[:-1]:
        remove_path(spark, f"{table}/batch={number}")


def has_batches(spark: SparkSession, table: str) -> bool:
    """Whether the table has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path))


def current(spark: SparkSession, table: str, key: str | None) -> DataFrame:
    """The maintained rows as of the newest batch."""
    rows = spark.read.parquet(table)
    if key:
        return cat.last_version(rows, "batch", key).drop("batch")
    newest = rows.agg(F.max("batch").alias("batch"))  # one row
    return rows.join(F.broadcast(newest), "batch").drop("batch")


# ----------------------------------------------------------- totals with retraction

TOTALS = "status string, n_documents long, n_pages long, n_chunks long"


def total_changes(events: DataFrame) -> DataFrame:
    """What every update changes in the totals: minus the document's old row, plus its new.

    ``events``: a stream of id, status, total_pages, total_chunks and version. State is the
    current row of each document; an update that is older than it changes nothing. Of the
    updates of a document in one micro-batch the newest counts.
    """
    plain = events.select(
        "id", "status", F.coalesce("total_pages", F.lit(0)).cast("long").alias("total_pages"),
        F.coalesce("total_chunks", F.lit(0)).cast("long").alias("total_chunks"),
        F.col("version").cast("long").alias("version"))

    def row(values: tuple, sign: int) -> tuple:
        done = values[0] == "completed"
        return (values[0], sign, sign * values[1] if done else 0, sign * values[2] if done else 0)

    def change(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState):
        newest = max((p.loc[p["version"].idxmax()] for p in parts), key=lambda r: r["version"])
        new = (newest["status"], int(newest["total_pages"]), int(newest["total_chunks"]))
        old = state.get if state.exists else None
        if old is not None and old[3] >= int(newest["version"]):
            return
        state.update((*new, int(newest["version"])))
        rows = [row(new, 1)] if old is None else [row(tuple(old[:3]), -1), row(new, 1)]
        yield pd.DataFrame(rows, columns=["status", "n_documents", "n_pages", "n_chunks"])

    kinds = "status string, total_pages long, total_chunks long, version long"
    return plain.groupBy("id").applyInPandasWithState(
        change, TOTALS, kinds, "update", GroupStateTimeout.NoTimeout)


def maintain_totals(events: DataFrame, table: str, checkpoint: str):
    """Keep corpus totals per status right after every micro-batch; returns the query.

    A micro-batch writes its few sums of changes under its number, so a repeated batch
    replaces itself and ``totals`` adds them up.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("status").agg(
            *[F.sum(c).alias(c) for c in ("n_documents", "n_pages", "n_chunks")])
        sums.coalesce(1).write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        total_changes(events).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def totals(spark: SparkSession, table: str, after: int | None = None) -> DataFrame:
    """The totals now, or as they were after micro-batch number ``after``."""
    rows = spark.read.schema(f"{TOTALS}, batch int").parquet(table)
    if after is not None:
        rows = rows.where(F.col("batch") <= after)
    return rows.groupBy("status").agg(
        *[F.sum(c).alias(c) for c in ("n_documents", "n_pages", "n_chunks")]
    ).where(F.col("n_documents") > 0)


def run_to_end(spark: SparkSession, stream: DataFrame, name: str, key: str | None) -> DataFrame:
    """Process everything that is available once and return the maintained table."""
    table, checkpoint = new_table_path(spark, name), new_table_path(spark, f"{name}-state")
    maintain(stream, table, checkpoint, key).awaitTermination()
    return current(spark, table, key)
