"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times (1 by default); the median counts. Mapped tables
are staged before the first query, as a stored claims schema would be.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from claimloom.plans.catalog import QUERIES
from claimloom.session import build_session
from claimloom.sources.fixtures import Tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))
HEADLINE = [
    "recovery_queue_topk",
    "dashboard_totals",
    "payer_intelligence",
    "claim_validation",
    "asof_denial_rate",
    "denial_features",
    "anomaly_features",
    "near_duplicate_claims",
    "anomaly_summary",
    "drift_report",
    "binary_metrics",
    "capacity_plan",
    "topk_retrieval",
    "appeal_packets",
    "audit_chain_build",
    "audit_chain_verify",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", CPUS),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, FOLDER)
    tables.base.count(), tables.lines.count()
    times = {}
    for name in names:
        began = time.perf_counter()
        run(spark, name)
        times[name] = round(statistics.median(run(spark, name) for _ in range(RUNS)), 3)
        print(f"{name} {times[name]} (with warm-up {time.perf_counter() - began:.1f})", file=sys.stderr)
    sf = float(os.path.basename(FOLDER.rstrip("/")).removeprefix("sf") or 0)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
