"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default: all)
BENCH_RUNS    timed runs per query, the median counts (default 1)
BENCH_QUERIES comma-separated query names (default: the headline set)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalogue import registry  # noqa: E402
from tracestrata import build_session  # noqa: E402

HEADLINE = (
    "pred_core_workflow",
    "repo_metrics",
    "repo_metrics_one_scan",
    "thresholds",
    "strata_distribution",
    "archetype_members_quartile",
    "event_log",
    "activity_occurrences",
    "case_starts",
    "dfg_performance",
    "dfg_orders",
    "net_edges_relaxed",
    "identikit_cohort",
    "manhattan_tvd",
    "similarity_cohorts",
    "coverage_summary",
    "contiguous_periods",
    "required_fields",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    times = {}
    for name in names:
        run(name)  # warm-up
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
