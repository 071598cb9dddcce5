"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores. Every query runs once to warm up and once for the clock; results are computed in full
and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidelog.plans import QUERIES  # noqa: E402
from tidelog.session import build_session  # noqa: E402

HEADLINE = [
    "parsed_lines",
    "parsed_documents",
    "redacted_documents",
    "assembled_records",
    "ingested_rows",
    "deduplicated_rows",
    "request_pairs",
    "resolved_requests",
    "service_rollup",
    "endpoint_rollup",
    "hourly_rollup",
    "latency_summary",
    "error_groups",
    "error_group_buckets",
    "merged_error_groups",
    "window_error_counts",
    "alert_error_rate",
    "alert_service_down",
    "alert_memory",
    "alert_endpoint_errors",
    "alert_traffic_drop",
    "alert_events",
    "log_page",
    "body_search",
    "store_stats",
    "raw_latency",
    "latency_explained",
    "file_verdicts",
    "mongo_metrics",
    "vhost_domains",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "tidelog-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - begun, 3)
    spark.stop()
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
