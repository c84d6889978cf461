"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import catalog  # noqa: E402
from lodestone.session import local_session  # noqa: E402

HEADLINES = [
    "flagship_lexical_evaluation", "d01_bm25_index", "d02_bm25_search_children", "d03_bm25_search_parents",
    "d05_knn_exact", "d06_knn_approx", "d10_rrf_fuse", "d02_bm25_search_stored", "d28_retrieve_chroma_bm25_rrf", "d28_retrieve_source_boost", "d28_retrieve_reranker",
    "g09_summarize_run", "g11_doc_type_summary", "g14_failure_reasons", "g21_final_contexts",
    "b05_normalize_documents", "c01_sample_gold_plus_background", "c03_recursive_split", "c08_chunk_parent_child",
    "c08_chunk_parent_child_semantic", "a11_build_index_rows", "e06_evidence_check", "f05_build_graph",
    "f10_graph_search_depth1", "h01_pair_turns", "h09_drop_semantic_duplicates", "h11_search_memories",
    "s04_admission_windows", "s05_stream_stage_latency",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "lodestone-bench")
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()

    def run(name: str) -> float:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    # start the JVM's compiler and the Python workers before anything is measured
    for name in ("d02_bm25_search_children", "c03_recursive_split", "d05_knn_exact"):
        run(name)
    times = {name: run(name) for name in HEADLINES}
    n_questions = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    n_documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf).name.replace("sf", ""),
        "bm25_index_ms_per_item": round(1000 * times["d01_bm25_index"] / n_documents, 4),
        "bm25_ms_per_question": round(1000 * times["d02_bm25_search_children"] / n_questions, 3),
        "hybrid_ms_per_question": round(1000 * times["d28_retrieve_source_boost"] / n_questions, 3),
        "reranked_ms_per_question": round(1000 * times["d28_retrieve_reranker"] / n_questions, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
