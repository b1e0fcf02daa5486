"""Headline benchmark: one JSON line with seconds per query.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local cores, BENCH_QUERIES (comma list)
overrides the query set.
"""

from __future__ import annotations

import json
import os
import time

from tidemark.plans.registry import all_queries
from tidemark.session import build_session

HEADLINE = [
    "bm25_topk", "tfidf_topk", "dense_topk", "rrf_fuse", "hybrid_search", "hybrid_rerank", "pii_scrub", "page_extract",
    "student_state", "emotion_turns", "detect_language", "lexicon_merge", "term_tokens", "corpus_chunks",
    "injection_scan", "repetition_flag", "feedback_health", "daily_volume", "session_dropoff", "intent_tfidf",
    "fact_lookup", "pattern_dedupe", "url_frontier", "embed_refresh",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    spark = build_session(f"local[{cpus}]", int(cpus), **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g")})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.range(1).count()
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
