"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice in one session, the faster run counts (the first one pays for
code generation). BENCH_QUERIES=all or a comma list picks other queries.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "cited_context", "lexical_topk", "vector_topk", "hybrid_union", "relevance_unified", "score_rerank",
    "semantic_rerank", "variation_merge", "context_full", "confidence", "page_scan", "page_info", "page_links",
    "corpus_chunks", "chunk_windows", "chunk_headers", "chunk_sentences", "chunk_semantic", "embed_documents",
    "text_features", "boilerplate", "context_quality", "high_recall_filter", "token_batches", "collection_append",
    "crawl_breadth_first", "sitemap_scan", "url_validate", "site_type", "cache_statistics", "progress_counters",
    "chat_trim", "answer_all_questions", "stream_ingest", "vector_topk_lsh", "vector_topk_blocks", "lexical_topk_blocks",
    "index_topk", "vector_cells_topk",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("corpusloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from workload import QUERIES

    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "2"))):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
