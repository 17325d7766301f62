"""Time the queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
    BENCH_RUNS     timed runs per query, median is kept (default 1; the first query is run once before to warm up)
    BENCH_QUERIES  comma-separated names (default: all)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from loomcite.plans import catalog
from loomcite.session import local_session

HEADLINE = """
lexical_topk_by_source search_works list_items_query feed_ranking postings_search hybrid_topk_by_type principle_search
work_ids sentences tokens_top_terms html_text json_cleanup query_expansion
work_merge work_merge_urls identity_exact identity_fuzzy version_decision refresh_skip
concept_upsert concept_versions near_duplicate_merge principle_merge evidence_links concept_detail
symbol_codes derivation_violations patch_edges lineage_depth lineage_visible idea_to_work_closure
project_graph_edges principle_relation_hubs membership_counts project_tab_page tab_sort_modes project_delete_deep
retention_keep_n usage_touch feedback_principles budget_guard run_status queue_position cancelled_results
catalogue_matches result_extraction quality_gate_rejects grounding_gate benchmark_view baseline_view families
coverage export_bundle bucket_import stream_run_status stream_run_events
""".split()


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    times = {}
    run(spark, sf_dir, names[0])
    for name in names:
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(repeats)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
