"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the local threads, BENCH_QUERIES a comma list of
queries, BENCH_RUNS the warm runs per query (the median counts).
"""

import json
import os
import statistics
import tempfile
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "1"))

HEADLINE = [
    "txn_scores", "txn_rollup", "txn_summary", "cross_channel", "alert_fusion", "event_velocity", "event_chain",
    "snapshot_profile", "class_stats", "audit_severity", "leak_sweep", "leak_infold",
    "rank_metrics", "pr_curve", "threshold_table", "cost_curve", "abstention", "calibration", "folds", "bootstrap_ci",
    "sim_edges", "sim_rings", "flow_components", "ring_recovery",
    "stream_event_velocity", "population_scores", "population_model_scores", "anomaly_scores",
]


def main() -> None:
    from ringwatch.plans import load_queries
    from ringwatch.session import build_session

    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=str(CPUS),
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        # the no-op sink runs the whole plan and keeps every column
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("txn_summary")  # start-up of the JVM and the code generator
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(run(name), 3)
        warm[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3) if RUNS else cold[name]
    rows = {t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count() for t in ("orders", "lineitem", "events")}
    rate = {n: round(rows[t] / warm[n]) for n, t in (("txn_scores", "orders"), ("population_model_scores", "lineitem")) if n in warm}
    print(
        json.dumps(
            {
                "metric": "headline queries, warm, total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "rows_per_sec": rate,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
