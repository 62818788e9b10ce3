"""Benchmark the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs to completion through the ``noop`` sink (full execution, no
collect), after one untimed warm-up query that starts the JVM and the Python
workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusforge.plans.queries import QUERIES  # noqa: E402
from corpusforge.session import build_session  # noqa: E402

HEADLINE = [
    "dedup_exact", "dedup_near", "curated_tasks", "extract_functions", "task_rows",
    "reward_table", "outcomes", "model_summary", "fidelity_hist", "depth_box",
    "roundtrip_csv", "listing", "chat_rows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(cpus, 8))
    # warm-up: JVM, codegen and the Python worker pool
    QUERIES["answers"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()      # every query starts cold
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
