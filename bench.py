"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs twice; the second (warm) wall time is reported.  Results
are executed completely through the ``noop`` sink (no rows collected).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from callrank.plans import catalog  # noqa: E402
from callrank.session import build_session  # noqa: E402

HEADLINE = [
    "a2_conversion_by_segment",
    "a10_segment_lift",
    "a12_conversion_report",
    "q8_quality_report",
    "e6_stratified_split",
    "e11_prepared_set",
    "e8_smote_samples",
    "h1_roc_auc",
    "h6_roc_curve",
    "h7_roc_auc_by_model",
    "h11_chi_square",
    "t4_top_decile",
    "t5_gains_table",
    "k2_domain_violations",
    "m1_decision_tree",
]


def run(spark, name: str, sf_dir: str) -> tuple[float, int]:
    catalog._CACHE.clear()
    spark.catalog.clearCache()  # each run pays for its own persisted frames
    t0 = time.perf_counter()
    df = catalog.QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0, 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="callrank-bench", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    times, first = {}, {}
    for n in names:
        first[n] = round(run(spark, n, sf_dir)[0], 3)
        times[n] = round(run(spark, n, sf_dir)[0], 3)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_warm_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "first_run": first, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
