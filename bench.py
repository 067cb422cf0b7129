"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Every query is timed on its own, from building the plan to the last row written to a sink that discards
it, including the stages it writes for itself. The figure of a query is the median of its runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from runwarden.plans import catalog
from runwarden.session import local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "daily_order_metrics",
    "scd2_apply",
    "dq_results",
    "task_log_explode",
    "current_vs_history",
    "slow_runs",
    "incidents",
    "hash_embed",
    "cosine_topk",
    "runbook_search",
    "rca_report",
    "quarantine_duplicates",
    "mttr_minutes",
)


def main() -> None:
    spark = local_session("bench", cores=CPUS, partitions=CPUS)
    found, times = catalog.queries(), {}
    # start the JVM's code paths before the clock runs
    found[HEADLINE[0]](spark, FOLDER).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        taken = []
        for _ in range(RUNS):
            start = time.perf_counter()
            found[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    scale = re.search(r"sf([0-9.]+)", FOLDER)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
