"""Benchmark: the headline plans over whole tables, one JSON line on stdout.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from anchorline.catalog import load  # noqa: E402
from anchorline.session import local_session  # noqa: E402

HEADLINE = (
    "cohort", "features", "labels", "training_rows", "readable_encounters", "activity_trailing", "quarantine",
    "natural_key_dedup", "entity_row_cap", "stream_order", "spliced_stream", "payload_hash", "grouped_split",
    "auroc", "calibration", "subgroup_metrics", "bootstrap_intervals", "reconcile_log", "realized_performance",
    "window_counts", "ks_test", "stability_index",
)
# Whole workloads, run once: reading CSV exports, loading a store, training, the gate, streaming with a skew check.
WORKLOADS = ("raw_text_scan", "preload_history", "trained_model_scores", "gate_report", "stream_features")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, shuffle_partitions=int(cores))
    queries, _ = load()
    names = wanted.split(",") if wanted else HEADLINE + WORKLOADS

    def timed(name: str) -> float:
        started = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.time() - started, 3)

    # Starting the engine is no query's cost.
    queries["exclusion_counts"](spark, folder).collect()
    first: dict[str, float] = {}
    again: dict[str, float] = {}
    for name in names:
        # The first run counts: it compiles the plan and builds whatever tables later queries share.
        first[name] = timed(name)
        if name not in WORKLOADS:
            again[name] = timed(name)
        print(name, first[name], again.get(name, ""), file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(first.values()), 3), "unit": "sec", "queries": first,
        "second_run": again, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
