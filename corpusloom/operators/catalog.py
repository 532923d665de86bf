"""Document catalog: one row per document, changed by whole-table rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as tx

REPEATED_KEYS = 100_000  # hashes of repeated keys that are shipped at once

# Texts shown to readers.
NO_PAPERS = "No papers have been uploaded and processed yet."


def dedup_by_filename(uploads: DataFrame) -> DataFrame:
    """First upload per filename by ``seq``; the row limit is applied before the shuffle."""
    first = Window.partitionBy("filename").orderBy("seq")
    return uploads.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def last_version(rows: DataFrame, version: str, key: str = "id") -> DataFrame:
    """Highest ``version`` per key; each task drops a key's older rows before the shuffle.

    Equal versions of a key go by the whole row, so that reruns agree. That text is made
    after the shuffle, and only for rows whose version is shared.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(version))
    newest = rows.withColumn("_n", F.rank().over(latest)).where("_n = 1").withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(key)))
    whole = F.when(F.col("_n") > 1, F.to_json(F.struct(*rows.columns)))
    first = Window.partitionBy(key).orderBy(whole)
    return newest.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def last_of_repeated(rows: DataFrame, version: str, key: str, keys: DataFrame) -> DataFrame:
    """``last_version`` of wide rows of which few share a key: the others stay where they are.

    ``keys`` is a table that is cheap to read and has ``key`` of all ``rows`` at least. Keys
    that come twice are found by their hash; rows whose hash is met again are compared with
    all others of the key as ever. Where many keys repeat, all rows are.
    """
    hashed = F.xxhash64(key)
    repeated = keys.select(hashed.alias("_hash")).groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_hash")
    found = repeated.limit(REPEATED_KEYS + 1).collect()
    if not found:
        return rows
    if len(found) > REPEATED_KEYS:
        return last_version(rows, version, key)
    few = F.broadcast(rows.sparkSession.createDataFrame(found, "_hash long"))
    marked = rows.withColumn("_hash", hashed)
    again = last_version(marked.join(few, "_hash", "left_semi").drop("_hash"), version, key)
    return marked.join(few, "_hash", "left_anti").drop("_hash").unionByName(again)


def catalog_upsert(catalog: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Insert-or-replace by id, last write wins; catalog rows count as the oldest."""
    current = catalog.withColumn(version, F.lit(-1).cast("long"))
    return last_version(current.unionByName(updates), version).drop(version)


def catalog_apply_status(catalog: DataFrame, updates: DataFrame, version: str = "version") -> DataFrame:
    """Set status and both counts by id. Counts missing in an update become 0."""
    newest = last_version(updates, version).select(
        "id",
        F.col("status").alias("_status"),
        F.coalesce("total_chunks", F.lit(0)).alias("_chunks"),
        F.coalesce("total_pages", F.lit(0)).alias("_pages"),
    )
    hit = F.col("_status").isNotNull()
    return (
        catalog.join(newest, "id", "left")
        .withColumn("total_chunks", F.when(hit, F.col("_chunks")).otherwise(F.col("total_chunks")))
        .withColumn("total_pages", F.when(hit, F.col("_pages")).otherwise(F.col("total_pages")))
        .withColumn("status", F.coalesce("_status", "status"))
        .drop("_status", "_chunks", "_pages")
    )


def catalog_lookup(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    return catalog.join(ids.select("id"), "id", "left_semi")


def catalog_list(catalog: DataFrame) -> DataFrame:
    """All rows, newest first, without the storage path."""
    return catalog.drop("file_path").orderBy(F.desc("ingested_at"), F.asc("id"))


def catalog_delete_cascade(
    catalog: DataFrame, chunks: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remaining catalog, remaining chunks, and per requested id what was removed.

    Chunks go by filename: a second catalog row of the same file loses its chunks too.
    """
    wanted = ids.select("id")
    doomed = catalog.join(wanted, "id", "left_semi").select("id", "filename")
    files = doomed.select(F.col("filename").alias("source_file")).distinct()
    kept_catalog = catalog.join(wanted, "id", "left_anti")
    kept_chunks = chunks.join(files, "source_file", "left_anti")
    per_file = (
        chunks.select("source_file")
        .join(files, "source_file", "left_semi")
        .groupBy("source_file")
        .agg(F.count("*").alias("removed_chunks"))
    )
    report = (
        ids.select("id")
        .distinct()
        .join(doomed, "id", "left")
        .join(per_file.withColumnRenamed("source_file", "filename"), "filename", "left")
        .select(
            "id",
            F.col("filename").isNotNull().alias("found"),
            F.coalesce("removed_chunks", F.lit(0)).alias("removed_chunks"),
        )
    )
    return kept_catalog, kept_chunks, report


def chunk_upsert(existing: DataFrame | None, chunks: DataFrame, version: str = "version",
                 keys: DataFrame | None = None) -> DataFrame:
    """Rows to store: embedded chunks only, NULL text metadata as "", newest per id.

    ``keys``, the stored ``chunk_id`` of all chunks, spares rows with an id of their own the
    shuffle (see ``last_of_repeated``).
    """
    ready = chunks.where(F.col("embedding").isNotNull())
    for name in ("image_path", "image_description", "latex_source"):
        ready = ready.withColumn(name, F.coalesce(name, F.lit("")))
    ready = ready.withColumn(
        "table_data_json", F.coalesce(F.to_json("table_data"), F.lit(""))
    ).drop("table_data")
    if existing is not None:
        ready = existing.withColumn(version, F.lit(-1).cast("long")).unionByName(ready)
    if existing is None and keys is not None:
        return last_of_repeated(ready, version, "chunk_id", keys).drop(version)
    return last_version(ready, version, key="chunk_id").drop(version)


def list_sources(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.col("source_file") != "").select("source_file").distinct().orderBy(
        "source_file"
    )


def chunk_count(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("n_chunks"))


def chunks_by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.drop("embedding").join(
        ids.select("chunk_id"), "chunk_id", "left_semi"
    )


def chunks_by_source(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.drop("embedding").join(
        sources.select("source_file"), "source_file", "left_semi"
    )


def paper_line() -> Column:
    return F.format_string(
        "- %s  (%d pages, %d chunks)", F.col("filename"), F.col("total_pages"), F.col("total_chunks")
    )


def completed_papers(catalog: DataFrame) -> DataFrame:
    """One display line per completed document, or the single default line.

    Newest first. The default is added by a count over the filtered table, not by
    collecting it.
    """
    done = catalog.where(F.col("status") == "completed").select(
        "id", "ingested_at", paper_line().alias("line")
    )
    default = (
        done.agg(F.count("*").alias("n"))
        .where("n = 0")
        .select(
            F.lit(None).cast("string").alias("id"),
            F.lit(None).cast("timestamp").alias("ingested_at"),
            F.lit(NO_PAPERS).alias("line"),
        )
    )
    return done.unionByName(default).orderBy(F.desc("ingested_at"), F.asc("id"))


def corpus_stats(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count("*").alias("n_papers"),
        F.sum(F.coalesce("total_pages", F.lit(0))).alias("n_pages"),
        F.sum(F.coalesce("total_chunks", F.lit(0))).alias("n_chunks"),
    )


def any_processing(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.coalesce(F.bool_or(F.col("status") == "processing"), F.lit(False)).alias("any_processing")
    )


def ingest_outcome(
    documents: DataFrame, elements: DataFrame, chunks: DataFrame, pages: DataFrame
) -> DataFrame:
    """Final status per document: completed with counts, or failed with zeroes."""
    n_elements = elements.groupBy("source_file").agg(F.count("*").alias("n_elements"))
    n_chunks = chunks.groupBy("source_file").agg(F.count("*").alias("n_chunks"))
    done = (F.coalesce("n_elements", F.lit(0)) > 0) & (F.coalesce("n_chunks", F.lit(0)) > 0)
    return (
        documents.select("source_file")
        .join(n_elements, "source_file", "left")
        .join(n_chunks, "source_file", "left")
        .join(pages, "source_file", "left")
        .select(
            "source_file",
            F.when(done, "completed").otherwise("failed").alias("status"),
            F.when(done, F.col("n_chunks")).otherwise(0).alias("total_chunks"),
            F.when(done, F.coalesce("total_pages", F.lit(0))).otherwise(0).alias("total_pages"),
        )
    )


def comparable_pairs(catalog: DataFrame, requests: DataFrame) -> DataFrame:
    """Requested pairs ``(first, second)`` that may be compared.

    Both documents must be completed and have different filenames. Pairs are checked as
    requested: the full list of pairs grows with the square of the catalog.
    """
    done = catalog.where(F.col("status") == "completed").select("id", "filename")
    return (
        requests.join(done.toDF("first", "first_file"), "first")
        .join(done.toDF("second", "second_file"), "second")
        .where(F.col("first_file") != F.col("second_file"))
        .select("first", "second", "first_file", "second_file")
    )


def scan_corpus(spark, path: str, extension: str = "pdf") -> DataFrame:
    """Names and contents of files with the wanted extension, in any letter case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return accept_extension(
        files.withColumn("filename", tx.basename(F.col("path"))), "filename", extension
    )


def accept_extension(df: DataFrame, name_col: str = "filename", extension: str = "pdf") -> DataFrame:
    return df.where(F.lower(name_col).endswith(f".{extension.lower()}"))
