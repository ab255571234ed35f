"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full plan is executed with the ``noop`` sink (every row is
produced, nothing is collected to the driver) and timed separately.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from respondo.catalog import QUERIES  # noqa: E402
from respondo.session import local_session  # noqa: E402

HEADLINE = [
    "segment_response_rate",   # flagship: star join + unpivot + one grouped pass
    "conditional_rate",
    "combo_segments",
    "describe_numeric",
    "value_counts",
    "correlation_matrix",
    "box_stats",
    "confusion_matrix",
    "roc_auc",
    "roc_curve",
    "classification_report",
    "f1_threshold",
    "profit_sweep",
    "auto_approval",
    "factor_ranking",
    "one_hot_drop_first",
    "standard_scale",
    "select_k_best",
    "stratified_split",
    "scan_delimited",
    "fit_logistic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2))
    spark.sparkContext.setLogLevel("ERROR")
    # JVM / codegen warm-up, not timed
    spark.read.parquet(os.path.join(sf_dir, "region.parquet")).count()
    times = {}
    for name in only:
        t0 = time.perf_counter()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
