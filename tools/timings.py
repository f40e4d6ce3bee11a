"""Wall time (first and warm second run) and output rows of every
registered query; prints a markdown table.

usage: python tools/timings.py SF_DIR CPUS [--models|--no-models]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from callrank.plans import catalog  # noqa: E402
from callrank.session import build_session  # noqa: E402

MODEL = {"e3_column_transformer", "e4_feature_names", "e9_resample_in_folds", "e10_pipeline_composition",
         "k1_batch_score", "k3_model_card", "k4_train_job", "s8_s10_model_roundtrip", "s9_metrics_sink",
         "t2_leaderboard", "t3_top_features"} | {n for n in catalog.QUERIES if n.startswith("m")}


def main():
    sf, cpus = sys.argv[1], sys.argv[2]
    models = "--models" in sys.argv
    spark = build_session(f"local[{cpus}]", app="callrank-timings", shuffle_partitions=int(cpus) * 2)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"| query | first s | warm s | rows |  ({os.path.basename(sf)}, local[{cpus}])")
    print("|---|---|---|---|")
    for name, fn in catalog.QUERIES.items():
        if (name in MODEL) != models:
            continue
        t = []
        rows = None
        for _ in range(2):
            catalog._CACHE.clear()
            spark.catalog.clearCache()
            t0 = time.perf_counter()
            df = fn(spark, sf)
            df.write.format("noop").mode("overwrite").save()  # count() would let Spark prune columns
            t.append(time.perf_counter() - t0)
            rows = df.count() if rows is None else rows
        print(f"| {name} | {t[0]:.2f} | {t[1]:.2f} | {rows} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
