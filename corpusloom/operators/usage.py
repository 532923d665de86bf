"""The query log and its dashboard: an append-only log by day, cubes, mergeable sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USERS_BITS = 12  # a distinct count is within about 1.04 / sqrt(2**12) = 1.6 %, standard error
RANKS_K = 400  # a quantile's rank is within about 0.9 %, at 99 %


def append_log(events: DataFrame, path: str) -> None:
    """Add ``events`` (ts and others) to the log, in folders by day; nothing is rewritten."""
    events.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def read_log(spark: SparkSession, path: str, first: str | None = None,
             last: str | None = None) -> DataFrame:
    """The log, or its days from ``first`` to ``last``, of which alone files are read."""
    log = spark.read.parquet(path)
    if first:
        log = log.where(F.col("day") >= F.lit(first).cast("date"))
    if last:
        log = log.where(F.col("day") <= F.lit(last).cast("date"))
    return log


def usage_cube(log: DataFrame, dimensions: list[str], value: str = "value") -> DataFrame:
    """Requests and the sum, mean and extremes of ``value`` for every set of dimensions.

    ``level`` is the grouping id: a bit per dimension, the first highest, set where the row
    is a total over it (its column is NULL then).
    """
    x = F.col(value)
    return log.cube(*dimensions).agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n_requests"),
        F.sum(x).alias("total"), F.avg(x).alias("mean"), F.min(x).alias("least"),
        F.max(x).alias("most"))


def hourly_sketches(log: DataFrame, keys: list[str], user: str = "user_id",
                    value: str = "value") -> DataFrame:
    """A row per hour and key: requests, a sketch of distinct users and one of quantiles."""
    return log.groupBy(F.date_trunc("hour", "ts").alias("hour"), *keys).agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.hll_sketch_agg(user, F.lit(USERS_BITS)).alias("users"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), RANKS_K).alias("ranks"))


def merged_sketches(sketches: DataFrame, keys: list[str], ranks: tuple[float, ...] = (0.5, 0.9, 0.99),
                    where: Column | None = None) -> DataFrame:
    """Requests, distinct users and quantiles of ``value`` over any span of stored hours.

    The log isn't read again: sketches of hours are merged, so a year costs as many rows as
    it has hours. Columns are n_requests, n_users and p<rank> such as p50.
    """
    rows = sketches if where is None else sketches.where(where)
    merged = rows.groupBy(*keys).agg(
        F.sum("n_requests").alias("n_requests"), F.hll_union_agg("users").alias("users"),
        F.kll_merge_agg_double("ranks", RANKS_K).alias("ranks"))
    return merged.select(
        *keys, "n_requests", F.hll_sketch_estimate("users").alias("n_users"),
        *[F.kll_sketch_get_quantile_double("ranks", F.lit(r)).alias(f"p{round(100 * r)}")
          for r in ranks])
