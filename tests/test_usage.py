"""The event log, sketches, windows of a stream, and totals that take old rows back."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpusloom.operators import usage
from corpusloom.sources import views
from corpusloom.streaming import status
from corpusloom.streaming import usage as stream_usage

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
START = dt.datetime(2024, 3, 1)


def events(rows):
    return [(i, START + dt.timedelta(minutes=m), u, kind, float(v), None)
            for i, (m, u, kind, v) in enumerate(rows)]


def test_log_is_appended_and_pruned_by_day(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = events([(0, 1, "a", 1), (24 * 60, 1, "a", 2), (48 * 60, 2, "b", 3)])
    usage.append_log(spark.createDataFrame(rows[:2], EVENTS), path)
    files = sorted(tmp_path.rglob("*.parquet"))
    usage.append_log(spark.createDataFrame(rows[2:], EVENTS), path)
    assert set(files) <= set(tmp_path.rglob("*.parquet"))
    some = usage.read_log(spark, path, "2024-03-02", "2024-03-02")
    assert [r["event_id"] for r in some.collect()] == [1]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_cube_has_every_level(spark):
    log = spark.createDataFrame([("x", "p", 1.0), ("x", "q", 3.0), ("y", "p", None)],
                                "kind string, place string, value double")
    got = {(r["level"], r["kind"], r["place"]): (r["n_requests"], r["total"])
           for r in usage.usage_cube(log, ["kind", "place"]).collect()}
    assert got[3, None, None] == (3, 4.0)
    assert got[1, "x", None] == (2, 4.0) and got[2, None, "p"] == (2, 1.0)
    assert got[0, "y", "p"] == (1, None) and len(got) == 8


def test_sketches_of_hours_merge_to_those_of_a_span(spark):
    rng = random.Random(4)
    rows = events([(rng.randrange(6 * 60), rng.randrange(3000), rng.choice("ab"), rng.random())
                   for _ in range(20_000)])
    log = spark.createDataFrame(rows, EVENTS)
    hours = usage.hourly_sketches(log, ["event_type"])
    assert hours.count() == 12
    for low, high in ((0, 6), (2, 4)):
        span = F.col("hour").between(START + dt.timedelta(hours=low),
                                     START + dt.timedelta(hours=high - 1))
        for r in usage.merged_sketches(hours, ["event_type"], where=span).collect():
            own = [x for x in rows if x[3] == r["event_type"]
                   and low <= (x[1] - START).total_seconds() / 3600 < high]
            users = len({x[2] for x in own})
            assert r["n_requests"] == len(own)
            assert abs(r["n_users"] - users) <= 0.08 * users
            for name, rank in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
                assert abs(sum(x[4] <= r[name] for x in own) / len(own) - rank) < 0.02


def test_windows_take_late_events_until_they_close(spark, tmp_path):
    parts = [
        [(5, 1, "a", 1), (50, 1, "a", 2)],
        [(70, 1, "a", 4), (20, 1, "a", 8)],  # 20 comes late but in time
        [(400, 1, "a", 16)],                 # closes what ended before 280
        [(410, 1, "b", 32)],
        [(30, 1, "a", 64), (350, 1, "a", 128)],  # 30 is too late
    ]
    folder = str(tmp_path / "in")
    for part in parts:
        spark.createDataFrame(events(part), EVENTS).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    where = str(tmp_path / "table"), str(tmp_path / "state")
    rows, late = stream_usage.run_counts(spark, source, *where)
    got = {((r["window_start"] - START).seconds // 3600, r["event_type"]): (r["n_requests"], r["total"])
           for r in rows.collect()}
    assert got == {(0, "a"): (3, 11.0), (1, "a"): (1, 4.0), (6, "a"): (1, 16.0), (6, "b"): (1, 32.0),
                   (5, "a"): (1, 128.0)}
    assert late == 1
    spark.createDataFrame(events([(10, 1, "a", 1), (420, 1, "b", 1)]), EVENTS).write.mode(
        "append").parquet(folder)
    rows, late = stream_usage.run_counts(spark, source, *where)  # goes on from its state
    assert late == 1 and rows.where("event_type = 'b'").first()["n_requests"] >= 1


def test_totals_are_right_after_every_micro_batch(spark, tmp_path):
    events_ = views.status_events(spark, SF).drop("ts")
    rows, schema = events_.collect(), events_.schema
    random.Random(3).shuffle(rows)  # updates come in any order
    cuts = [rows[i::4] for i in range(4)]
    folder, table = str(tmp_path / "in"), str(tmp_path / "totals")
    for part in cuts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    status.maintain_totals(source, table, str(tmp_path / "state")).awaitTermination()
    for number in range(4):
        seen = spark.createDataFrame(sum(cuts[: number + 1], []), schema)
        want = status.corpus_totals(status.latest_rows(seen)).collect()
        got = status.totals(spark, table, number).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
