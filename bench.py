"""Headline queries on one machine: prints one JSON line with seconds per query.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
Each query is run to completion without collecting its rows.
"""
from __future__ import annotations

import json
import os
import sys
import time

from panelrisk.plans.catalogue import REGISTRY
from panelrisk.session import local_session

# One per block of the reference workload: panel build, event expansion, matrix, smoothing, baselines,
# neighbour pairs and features, exact metrics, bootstrap, climatology, factors, checks.
HEADLINE = (
    "panel_volumes",
    "nested_samples",
    "event_history",
    "feature_matrix",
    "smoothed_rates",
    "baseline_report",
    "neighbour_pairs",
    "neighbour_history",
    "average_precision",
    "budget_curve",
    "rank_ensembles",
    "bootstrap_replicas",
    "reliability_table",
    "climatology",
    "level_factors",
    "rates_by_class",
    "check_rectangular",
    "serving_table",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    # Start-up (class loading, first codegen) is not part of any query.
    REGISTRY["danger_classes"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds, failed = {}, []
    for name in names:
        start = time.perf_counter()
        try:
            REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # one query's failure must not lose the others' figures
            failed.append(name)
            print(f"{name}: {str(error)[:2000]}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": scale}
    print(json.dumps(line | ({"failed": failed} if failed else {})))
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
