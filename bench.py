"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and threads.
Each query runs once unmeasured, then BENCH_RUNS times (default 1); the best run counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from hearthcheck.demo.suite import QUERIES
from hearthcheck.session import build_session, default_master

HEADLINE = (
    "frequency", "crosstab_margins", "multiway_counts", "correlation_matrix", "missing_rates", "duplicates_rows",
    "duplicates_by_id", "coherence_report", "sample_fixed", "spec_count", "spec_list", "sql_three_way_join",
    "fusion", "difference_both", "overlap", "lookup_default", "audit_row_checks", "audit_full", "agent_quality",
    "agent_volume", "agent_daily", "id_search", "id_search_batch", "clean_text", "passages", "tfidf_terms",
    "tfidf_weights", "tfidf_topk", "mention_tags", "context_carry", "latest_export",
)


def run_once(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        default_master(),
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        run_once(spark, name, folder)
        seconds[name] = round(min(run_once(spark, name, folder) for _ in range(runs)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
