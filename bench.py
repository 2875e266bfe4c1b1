"""Times the headline queries and prints one JSON line.

Each query runs once to warm up, then BENCH_REPEATS (2) times; the median counts.  Results go to the
no-op sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from vacantry.plans import catalog
from vacantry.session import local_session

HEADLINE = [
    "freshness_summary", "best_observation", "report_gate", "status_dashboard", "apply_queue",
    "posted_pay_by_company", "merge_postings", "digest", "classified_roles", "scored_documents",
    "language_requirements", "parsed_salaries", "normalized_titles", "page_text", "page_fields",
    "breaker_verdicts", "rate_usage", "classified_vectors",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = local_session(cores, memory="16g", partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name, sf_dir)
        print(name, file=sys.stderr, flush=True)
        times[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(repeats)), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
