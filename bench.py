"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from ledgerframe.plans.queries import QUERIES

HEADLINE = (
    "all_read_after_upto", "catchup_batch_typed", "stream_heads", "append_result", "append_assign_versions", "log_dedup_event_id", "fold_counter", "fold_order_state",
    "running_state", "snapshot_first_fold", "projection_daily", "projection_lag", "drain_schedule", "gap_scan", "dead_letter_skip", "upcast_linear", "upcast_fanout",
    "causation_chain", "idempotency_register", "reservation_lifecycle", "checkpoint_cas", "housekeeping_report",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    took = {}
    for name in HEADLINE:
        run(name)  # compiles and warms the page cache
        took[name] = round(min(run(name) for _ in range(2)), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
