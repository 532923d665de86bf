"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, folder) and returns a DataFrame; its result is written as
Parquet and read again as the next stage's documents. All stages but the last return the
columns of documents. A stage decides for rows, not for ids: equal ids, null ids and rows
that repeat each other are told apart by the file and the row number in it, which are the
same in every scan however files are split; documents that are no files are stored first.

Nothing here is a cap or a sample: every stage works on all rows and whole texts.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import langid, lines, mixing, near, packing
from corpusloom.session import materialize

#: A document goes if no few languages hold this share of its words.
LEAST_SHARE = 0.5


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, made longer until ``docs`` has no such column."""
    have = {c.lower() for c in docs.columns}
    while name.lower() in have:
        name += "_"
    return name


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells rows apart alike in every scan, and its name."""
    name = _fresh(docs, "_place")
    try:
        file = docs.metadataColumn("_metadata")
        return docs.withColumn(name, F.struct(
            F.xxhash64(file["file_path"]).alias("file"), file["row_index"].alias("row"))), name
    except AnalysisException:  # not the rows of Parquet files
        numbered = docs.withColumn(name, F.monotonically_increasing_id())
        return materialize(numbered, "numbered"), name


def _keyed(docs: DataFrame, place: str) -> tuple[DataFrame, str]:
    """``docs`` with an order of rows by id, null last, then place, and its name."""
    name = _fresh(docs, "_key")
    return docs.withColumn(name, F.struct(
        F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
        F.col(place).alias("place"))), name


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a language: learned from all labelled rows, applied to all rows.

    Null and empty texts, texts without a letter and texts of which no few languages hold
    half of the words go, mixtures stay; a null language is filled in.
    """
    model = langid.Model.fit(docs.select("lang", "text"))
    return langid.keep_identified(docs, model, LEAST_SHARE)


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the lines that equal or nearly equal an earlier line of the corpus.

    A document that loses all its lines goes; ``n_chars`` follows the text.
    """
    rows, key = _keyed(*_placed(docs))
    kept = lines.dedup_lines(rows, id_col=key, drop_emptied=True).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    rows, place = _placed(docs)
    keyed, key = _keyed(rows, place)
    found = near.near_duplicates(keyed, id_col=key)
    gone = found.filter("NOT kept").select(F.col("doc_id").getField("place").alias(place))
    return rows.join(gone, place, "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the mix takes, repeated or cut as it takes them."""
    rows, place = _placed(docs)
    return mixing.apply_mix(rows, stored_row=place).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row per piece of a document with its training sequence (see ``packing.pack``)."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The packed sequences of ``documents``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
