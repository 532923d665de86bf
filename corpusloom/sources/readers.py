"""Reading and writing tables: Parquet, text, files, and the partitioned chunk store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


FEW_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Give more cores work on a table of a few splits, such as one small file.

    A table of ``FEW_SPLITS`` splits or more is returned as it is, however many cores there
    are, so only tables of a few GB are ever dealt anew.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= min(cores, FEW_SPLITS):
        return df
    return df.repartition(min(cores, FEW_SPLITS))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as one document each."""
    return spark.read.text(path, wholetext=True).select(
        tx.basename(F.input_file_name()).alias("source_file"), F.col("value").alias("text")
    )


def write_chunks(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Store chunks partitioned by type, so that typed searches read their part only."""
    chunks.write.mode(mode).partitionBy("content_type").parquet(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
