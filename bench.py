"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then three times in full into a sink that drops the rows; the
median counts. ``BENCH_SF_DIR`` names the tables and ``BENCH_CPUS`` the cores.
"""

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.registered import QUERIES  # noqa: E402

HEADLINE = [
    "op_counts", "error_counts", "latency_histogram", "value_age", "replica_lag", "age_by_follower",
    "regressions", "op_rate", "probe_metrics", "writes_per_second", "follower_reads_per_second",
    "commands_per_second", "nodes_up", "offset_lag", "counter_increase", "resampled", "instance_table",
    "rewire_plan", "promotion_plan", "followers", "current_leader", "follower_changes", "leader_commands",
    "time_to_visible", "failover_outcome", "state_replay", "lifecycle_progress", "scrape_targets",
    "stream_lag", "stream_lifecycle",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "sum of median query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else folder,
    }))


if __name__ == "__main__":
    main()
