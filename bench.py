"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query runs
twice into a sink that discards rows; the second run is reported, the first under "cold".
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "text_metrics", "blend_score", "split_sentences", "sectionize", "sectionize_documents",
    "chunk_text", "chunk_elements", "table_elements", "knn_exact", "knn_filtered", "knn_ann",
    "task_retrieval", "pack_context", "citations", "answer_shell", "neighbor_context",
    "text_search", "answer_requests", "ingest_batch", "answer_f1", "best_of_passes", "catalog_upsert",
    "catalog_delete_cascade", "chunk_upsert", "history_window", "agent_run_stats",
    "hit_rate_at_k", "latency_percentiles", "stream_status", "stream_ingest",
]


def main() -> None:
    from corpusloom.plans import all_queries
    from corpusloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = all_queries()
    cold, warm = {}, {}
    for name in names:
        for times in (cold, warm):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    rates = {}
    if "text_metrics" in warm:
        rates["metric_docs_per_s"] = round(docs / warm["text_metrics"], 1)
    if "chunk_text" in warm:
        rates["chunked_docs_per_s"] = round(docs / warm["chunk_text"], 1)
    if "knn_exact" in warm:
        rates["knn_pairs_per_s"] = round(200 * vectors / warm["knn_exact"], 1)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total_warm", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "cold": cold, "rates": rates, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
