"""Streams give the same rows as batches, and re-delivered files add nothing."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.operators import embedding, retrieval
from corpusloom.plans import ingest
from corpusloom.sources import readers, views
from corpusloom.streaming import ingest as stream
from corpusloom.streaming import status

SF = "/root/testdata/sf0.001"


def docs(spark, names):
    rng = random.Random(9)
    rows = [(n, " ".join(rng.choice(["alpha", "beta", "gamma", "delta."]) for _ in range(300))) for n in names]
    return spark.createDataFrame(rows, "source_file string, text string").coalesce(1)


def run(spark, folder, store, state):
    schema = "source_file string, text string"
    from pyspark.sql.types import StructType
    source = stream.document_stream(spark, str(folder), StructType.fromDDL(schema), files_per_batch=1)
    catalog = f"{store}-catalog"
    stream.stream_ingest(source, str(store), catalog, str(state), features=16).awaitTermination()
    listed = ingest.read_store(spark, catalog).collect()
    assert len(listed) == len({r["id"] for r in listed})
    assert {r["status"] for r in listed} == {"completed"}
    return stream.stored_chunks(spark, str(store))


def test_redelivery_does_not_duplicate(spark, tmp_path):
    folder, store, state = tmp_path / "in", tmp_path / "store", tmp_path / "state"
    first = docs(spark, ["a", "b"])
    first.write.parquet(str(folder))
    ids = {r["chunk_id"] for r in run(spark, folder, store, state).collect()}
    assert ids == {r["chunk_id"] for r in ingest.chunk_documents(first).collect()}
    first.write.mode("append").parquet(str(folder))            # the same documents again
    docs(spark, ["c"]).write.mode("append").parquet(str(folder))
    rows = run(spark, folder, store, state).collect()
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 for r in rows)
    assert len(rows) == len({r["chunk_id"] for r in rows})
    assert {r["source_file"] for r in rows} == {"a", "b", "c"}
    assert len(run(spark, folder, store, tmp_path / "state3").collect()) == len(rows)  # new checkpoint
    again = run(spark, folder, tmp_path / "store2", tmp_path / "state2")  # from scratch: same ids
    assert {r["chunk_id"] for r in again.collect()} == {r["chunk_id"] for r in rows}


def test_stream_status_in_many_batches(spark, tmp_path):
    events = views.status_events(spark, SF).drop("ts")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    source = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    got = status.run_to_end(spark, status.latest_status(source), "s", "id")
    want = status.latest_status(events)
    assert sorted(map(tuple, got.select("id", "status", "n_updates").collect())) == sorted(map(tuple, want.collect()))
    rows = status.run_to_end(spark, status.latest_rows(source), "t", "id")
    want = status.corpus_totals(status.latest_rows(events))
    assert sorted(map(tuple, status.corpus_totals(rows).collect())) == sorted(map(tuple, want.collect()))


def test_status_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(status, "COMPACT_EVERY", 2)
    events = views.status_events(spark, SF).drop("ts")
    events.repartition(7).write.parquet(str(tmp_path / "in"))
    source = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
              .parquet(str(tmp_path / "in")))
    table = str(tmp_path / "table")
    status.maintain(status.latest_status(source), table, str(tmp_path / "state"), "id").awaitTermination()
    assert len(list((tmp_path / "table").glob("batch=*"))) <= 3
    got = status.current(spark, table, "id").select("id", "status", "n_updates").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, status.latest_status(events).collect()))


def test_totals_count_a_document_once(spark):
    events = spark.createDataFrame(
        [("d1", "completed", 5, 6, 1), ("d1", "completed", 7, 8, 2), ("d1", "failed", None, None, 3),
         ("d2", "processing", None, None, 4), ("d2", "completed", 3, 2, 5)],
        "id string, status string, total_chunks long, total_pages long, version long")
    got = status.corpus_totals(status.latest_rows(events)).collect()
    assert {tuple(r) for r in got} == {("failed", 1, 0, 0), ("completed", 1, 2, 3)}


def test_text_search_finds_the_passage(spark):
    corpus = docs(spark, [f"d{i}" for i in range(5)]).union(
        spark.createDataFrame([("needle", "quasar nebula photon lens")], "source_file string, text string"))
    chunks, outcome, model = ingest.ingest_batch(corpus)
    q = spark.createDataFrame([("q", "photon quasar")], "query_id string, text string")
    hits = retrieval.retrieve(model.embed(q, "text", "vector"), chunks, 3)
    best = retrieval.attach_chunks(hits, chunks).where("rank = 1").first()
    assert best["source_file"] == "needle"
    assert {r["status"] for r in outcome.collect()} == {"completed"}


def test_embeddings_are_unit_vectors_and_shared(spark):
    corpus = spark.createDataFrame([("a", "one two three"), ("b", "two three four"), ("c", "")],
                                   "id string, content string")
    model = embedding.HashedTfIdf(64).fit(corpus)
    got = {r["id"]: r["embedding"] for r in model.embed(corpus).collect()}
    assert got["c"] is None and abs(np.linalg.norm(got["a"]) - 1) < 1e-6
    again = {r["id"]: r["v"] for r in model.embed(corpus, "content", "v").collect()}
    assert again["a"] == got["a"]


def test_user_function_sees_small_batches(spark):
    def sizes(texts):
        assert len(texts) <= 4
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([(i, "x" * i) for i in range(23)], "id int, content string")
    got = {r["id"]: r["embedding"] for r in embedding.embed_with(df, sizes, batch=4).collect()}
    assert got == {i: [float(i), 1.0] for i in range(23)}


def test_chunk_store_is_partitioned_by_type(spark, tmp_path):
    chunks = views.chunk_vectors(spark, SF)
    readers.write_chunks(chunks, str(tmp_path / "store"))
    tables = readers.read_chunks(spark, str(tmp_path / "store")).where(F.col("content_type") == "table")
    plan = tables._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(content_type" in plan
    assert tables.count() == chunks.where("content_type = 'table'").count()


def test_corpus_files_by_extension(spark, tmp_path):
    from corpusloom.operators.catalog import scan_corpus
    for name in ("a.pdf", "b.PDF", "c.txt", "d.pdf.bak"):
        (tmp_path / name).write_text("content of " + name)
    got = {r["filename"]: bytes(r["content"]) for r in scan_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": b"content of a.pdf", "b.PDF": b"content of b.PDF"}
    texts = {r["source_file"]: r["text"] for r in readers.read_texts(spark, str(tmp_path / "c.txt")).collect()}
    assert texts == {"c.txt": "content of c.txt"}


def test_schemas_match_the_tables(spark):
    for name, schema in (("documents", schemas.DOCUMENTS), ("events", schemas.EVENTS)):
        assert [(f.name, f.dataType) for f in readers.read_table(spark, SF, name).schema] == [
            (f.name, f.dataType) for f in schema]


@pytest.mark.parametrize("parts", [None, 3])
def test_table_stream_reads_a_file_or_a_folder(spark, tmp_path, parts):
    rows = spark.createDataFrame([(i, f"Methods\ntext {i}") for i in range(6)], "doc_id long, text string")
    if parts:
        rows.repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    else:
        rows.toPandas().to_parquet(tmp_path / "documents.parquet")
    docs = stream.table_stream(spark, str(tmp_path), "documents", rows.schema).selectExpr(
        "concat('doc_', doc_id) AS source_file", "text")
    store, catalog = str(tmp_path / "store"), str(tmp_path / "catalog")
    stream.stream_ingest(docs, store, catalog, str(tmp_path / "state")).awaitTermination()
    got = stream.stored_chunks(spark, store).select("source_file", "content").collect()
    assert sorted(map(tuple, got)) == [(f"doc_{i}", f"text {i}") for i in range(6)]
