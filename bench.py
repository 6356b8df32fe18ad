"""Runs the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the
local cores. Each query is built and run to the end without keeping rows.
"""

from __future__ import annotations

import json
import os
import time

from veritrace.plans.all_queries import QUERIES
from veritrace.session import local_session

HEADLINE = [
    "doc_dedupe", "paragraph_units", "chunk_pack", "build_chunks", "embed_hash", "vector_topk", "vector_topk_active",
    "evidence_bundle", "extract_facts", "ground_normalized", "coerce_facts", "grounding_metrics", "predicate_lookup",
    "entity_candidates", "entity_resolve", "related_facts_topk", "classify_pairs", "recompute_summary", "fact_view",
    "fact_search", "conflict_detail", "timeline", "comparison_table", "graph_nodes", "graph_edges", "answer_components",
    "plan_validate", "citation_resolve", "job_state", "stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench", memory=os.environ.get("BENCH_MEMORY", "20g"))
    # Starts the workers, so that the first query is not charged for it.
    QUERIES["embed_hash"](spark, sf_dir).limit(10).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
