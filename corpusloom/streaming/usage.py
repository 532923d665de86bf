"""Usage counts of a stream by event time: tumbling windows, a watermark, late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.streaming import status


def window_counts(events: DataFrame, every: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Requests and the sum of ``value`` per window and event type, as they change.

    ``events``: ts, event_type and value. A window is closed, and its state goes, at the end
    of the micro-batch before which an event came that is ``delay`` past its end; events
    that come for a closed window are late and dropped.
    """
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", every).alias("window"), "event_type")
        .agg(F.count(F.lit(1)).alias("n_requests"), F.sum("value").alias("total"))
        .select(
            F.concat_ws("|", F.col("window.start").cast("string"), "event_type").alias("id"),
            F.col("window.start").cast("timestamp_ntz").alias("window_start"), "event_type",
            "n_requests", "total")
    )


def run_counts(spark: SparkSession, events: DataFrame, table: str, checkpoint: str,
               every: str = "1 hour", delay: str = "2 hours") -> tuple[DataFrame, int]:
    """Process what is available; (the current windows, events dropped as late in this run).

    Late events are those that came in and are in no window: rows read, less what the
    windows gained.
    """
    before = _counted(spark, table)
    query = status.maintain(window_counts(events, every, delay), table, checkpoint, "id")
    query.awaitTermination()
    came = sum(p["numInputRows"] for p in query.recentProgress)
    rows = status.current(spark, table, "id")
    return rows, came - (_counted(spark, table) - before)


def _counted(spark: SparkSession, table: str) -> int:
    if not status.has_batches(spark, table):
        return 0
    return status.current(spark, table, "id").agg(F.sum("n_requests")).first()[0] or 0
