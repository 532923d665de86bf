"""Session helper and the one place that decides where intermediate tables go."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
_WORKING: dict[int, list[str]] = {}  # by thread; plain values, as the package is pickled whole

#: with it Spark deletes the shuffle files of a write as soon as the write is done
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only when the session names none (tests, local runs) a fresh temporary folder is
    made, one per process.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not _LOCAL_DIR:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        _LOCAL_DIR.append(tempfile.mkdtemp(prefix="corpusloom-"))
    return _LOCAL_DIR[0]


def new_table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system its path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Writes in this block leave no shuffle files behind; they would stay until the driver
    happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Tables that ``materialize`` writes in this block are deleted at its end, their shuffle
    files as soon as they are written. Gives the list of their paths.

    For jobs that return nothing that reads them.
    """
    made: list[str] = []
    thread = threading.get_ident()
    outer = _WORKING.get(thread)
    _WORKING[thread] = made
    try:
        yield made
    finally:
        del _WORKING[thread]
        if outer is not None:
            _WORKING[thread] = outer
        for path in made:
            remove_path(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage durably: a lost executor re-reads the files and never recomputes.
    """
    path = new_table_path(df.sparkSession, name)
    made = _WORKING.get(threading.get_ident())
    if made is None:
        df.write.mode("overwrite").parquet(path)
    else:
        made.append(path)
        with shuffles_removed(df.sparkSession):
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
