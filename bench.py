"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query starts from the source tables: shared intermediate tables and fitted models are
forgotten before each one, so a time includes all of a query's own stages.  Each query runs
once on the smallest data first, which compiles its code.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from flowtide.queries import QUERIES, Tables  # noqa: E402
from flowtide.session import local_session  # noqa: E402

HEADLINE = [
    "read_flow_dir",
    "flow_projection",
    "profile_report",
    "label_distribution",
    "topology_profile",
    "fit_medians",
    "window_stats",
    "edge_features",
    "node_features",
    "priority_edge_sample",
    "fit_robust_scaler",
    "window_graph",
    "encode_windows",
    "sequences",
    "evaluate_horizons",
    "packets_to_flows",
    "baseline_fit",
    "rollout",
    "stream_window_stats",
]

CAPTURE_READERS = {"profile_report", "read_flow_dir"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus)
    small = str(Path(sf_dir).parent / "sf0.001")
    warm_dir = small if Path(small).is_dir() else sf_dir
    times = {}
    for name in names:
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
        Tables.forget()
        if name in CAPTURE_READERS:
            Tables.of(spark, sf_dir).mixed_folder  # CSV files are written outside the timed part
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale.group(1)) if scale else None,
    }))


if __name__ == "__main__":
    main()
