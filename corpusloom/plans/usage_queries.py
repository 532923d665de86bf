"""Queries over the event log: cubes, sketches, windows of a stream, running totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import usage
from corpusloom.plans.ingest_queries import _status_stream
from corpusloom.plans.registry import query
from corpusloom.session import materialize, new_table_path
from corpusloom.sources import readers
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import status
from corpusloom.streaming import usage as stream_usage_


def logged(spark, d):
    """The events as a log by day, appended in two parts."""
    path = new_table_path(spark, "log")
    events = readers.read_table(spark, d, "events")
    usage.append_log(events.where("event_id % 2 = 0"), path)
    usage.append_log(events.where("event_id % 2 = 1"), path)
    return usage.read_log(spark, path)


@query("usage_cube", """
SELECT day, event_type, grouping(day, event_type)::BIGINT AS level, count(*) AS n_requests,
  round(sum(value), 2) AS total, floor(round(sum(value) * 100) / count(*)) AS mean, min(value) AS least, max(value) AS most
FROM (SELECT *, ts::DATE AS day FROM events) GROUP BY CUBE (day, event_type)
""")
def usage_cube(spark, d):
    cube = usage.usage_cube(logged(spark, d), ["day", "event_type"])
    whole = F.floor(F.round(F.col("total") * 100) / F.col("n_requests"))  # in whole cents
    return cube.withColumn("mean", whole.cast("double")).withColumn("total", F.round("total", 2))


@query("usage_span", """
SELECT event_type, count(*) AS n_requests FROM events
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY event_type
""")
def usage_span(spark, d):
    """One week of the log, of whose folders alone files are read."""
    path = new_table_path(spark, "log")
    usage.append_log(readers.read_table(spark, d, "events"), path)
    week = usage.read_log(spark, path, "2024-01-05", "2024-01-11")
    return week.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_requests"))


@query("usage_sketches", """
SELECT event_type, count(*) AS n_requests, true AS users_close, true AS p50_close, true AS p90_close
FROM events GROUP BY event_type
""")
def usage_sketches(spark, d):
    """Merged hourly sketches against the log: within 8 % in users, 0.03 in rank."""
    log = materialize(logged(spark, d), "log-rows")
    hours = materialize(usage.hourly_sketches(log, ["event_type"]), "hours")
    merged = usage.merged_sketches(hours, ["event_type"], (0.5, 0.9))
    users = log.groupBy("event_type").agg(F.count_distinct("user_id").alias("true_users"))
    ranks = log.join(merged, "event_type").groupBy("event_type").agg(*[
        part.alias(name) for p in ("p50", "p90") for name, part in (
            (f"{p}_below", F.avg((F.col("value") < F.col(p)).cast("double"))),
            (f"{p}_upto", F.avg((F.col("value") <= F.col(p)).cast("double"))))])

    def close(p: str, rank: float):
        return ((F.col(f"{p}_below") <= rank + 0.03) & (F.col(f"{p}_upto") >= rank - 0.03)).alias(
            f"{p}_close")

    return merged.join(users, "event_type").join(ranks, "event_type").select(
        "event_type", "n_requests",
        (F.abs(F.col("n_users") - F.col("true_users")) <= 0.08 * F.col("true_users") + 1).alias(
            "users_close"), close("p50", 0.5), close("p90", 0.9))


_arrivals = "CASE WHEN event_id % 50 = 0 THEN 4 ELSE least((dayofmonth(ts) - 1) // 8, 3) END"


@query("stream_usage", f"""
WITH arrived AS (SELECT *, {_arrivals} AS part FROM events),
marks AS (
  SELECT part, (SELECT max(ts) FROM arrived e WHERE e.part < p.part - 1) - INTERVAL 2 HOUR AS mark
  FROM (SELECT DISTINCT part FROM arrived) p),
kept AS (
  SELECT *, mark IS NOT NULL AND date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark AS late
  FROM arrived JOIN marks USING (part))
SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n_requests,
  round(sum(value), 2) AS total, (SELECT count(*) FROM kept WHERE late) AS n_late
FROM kept WHERE NOT late GROUP BY ALL
""")
def stream_usage(spark, d):
    """The events by the hour as they arrive in five parts; every fiftieth comes last."""
    folder = new_table_path(spark, "arrivals")
    events = readers.read_table(spark, d, "events")
    part = F.when(F.col("event_id") % 50 == 0, 4).otherwise(
        F.least(F.floor((F.dayofmonth("ts") - 1) / 8), F.lit(3)))
    for number in range(5):
        events.where(part == number).coalesce(1).write.mode("append").parquet(folder)
    rows, late = stream_usage_.run_counts(
        spark, stream.document_stream(spark, folder, schemas.EVENTS, files_per_batch=1),
        new_table_path(spark, "windows"), new_table_path(spark, "windows-state"))
    return rows.select("window_start", "event_type", "n_requests",
                       F.round("total", 2).alias("total"), F.lit(late).cast("long").alias("n_late"))


@query("stream_totals", """
SELECT status, count(*) AS n_documents,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN total_pages END), 0) AS BIGINT) AS n_pages,
  CAST(coalesce(sum(CASE WHEN status = 'completed' THEN total_chunks END), 0) AS BIGINT) AS n_chunks
FROM (SELECT id, arg_max(status, version) AS status, max_by(r, version).p AS total_pages,
        max_by(r, version).c AS total_chunks
      FROM (SELECT *, {'p': total_pages, 'c': total_chunks} AS r FROM status_events) GROUP BY id)
GROUP BY status
""", ("status_events",))
def stream_totals(spark, d):
    """Totals that the stream itself keeps, old rows taken back."""
    table = new_table_path(spark, "totals")
    status.maintain_totals(
        _status_stream(spark, d), table, new_table_path(spark, "totals-state")).awaitTermination()
    return status.totals(spark, table)
