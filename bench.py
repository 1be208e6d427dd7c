"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is pulled to the driver). One untimed warm-up run of the
flagship query absorbs JVM start-up and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "order_tracker", "recent_orders", "tracker_steps", "topic_tag_with_fallback",
    "latency_summary", "throughput", "progress_ticks", "partition_lag", "lag_growth",
    "redeliveries", "correlate_outcomes", "order_race", "uncorrelated_events",
    "next_reading", "colour_mismatch", "lux_cct", "trajectory", "final_position",
    "retry_attempts", "reserve_results", "reserve", "ledger_replay", "fetch",
    "restore_order", "stock_by_colour",
]


# input table of each headline query (for input rows per second)
INPUT = {
    "events": ["order_tracker", "recent_orders", "tracker_steps", "topic_tag_with_fallback", "latency_summary",
               "throughput", "progress_ticks", "partition_lag", "lag_growth", "redeliveries",
               "correlate_outcomes", "order_race", "uncorrelated_events", "next_reading"],
    "lineitem": ["colour_mismatch", "lux_cct", "trajectory", "final_position", "retry_attempts", "ledger_replay"],
    "orders": ["reserve_results", "reserve", "fetch", "restore_order"],
    "part": ["stock_by_colour"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    from blockyard.plans.catalog import REGISTRY
    from blockyard.session import build_session

    spark = build_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")),
                          app="blockyard-bench")
    chosen = names.split(",") if names else [n for n in HEADLINE if n in REGISTRY]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        df = REGISTRY[name][0](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(chosen[0])  # warm-up
    times = {}
    for n in chosen:
        times[n] = round(run(n), 3)
    sizes = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in INPUT}
    events = sizes["events"]
    rate = {q: round(sizes[t] / times[q]) for t, qs in INPUT.items() for q in qs if q in times and times[q] > 0}
    total = round(sum(times.values()), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "events": events,
        "tracker_events_per_sec": round(events / times["order_tracker"], 1) if "order_tracker" in times else None,
        "input_rows_per_sec": rate,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
