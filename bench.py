"""Time the headline queries and print one JSON line.

``$BENCH_SF_DIR`` names the data (default sf0.1), ``$BENCH_CPUS`` the local cores. Each
query is run to the end on every column by the no-op sink; results stay on the executors.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from steadyhum.functions.scale import clear
from steadyhum.plans import QUERIES

HEADLINE = [
    "health_report",
    "profile_statistics",
    "drift_metrics",
    "explained_report",
    "final_evaluation",
    "distance_distribution",
    "outliers",
    "roc_curve",
    "roc_auc",
    "score_distribution",
    "catalog_summary",
    "path_metadata",
    "sample_evenly",
    "hold_out_first_normal",
    "store_load_or_create",
    "positive_pairs",
    "negative_pairs",
    "contrastive_loss",
    "projection",
    "power_spectrum",
    "log_mel",
    "mfcc_features",
    "spectral_features",
    "harmonic_features",
    "feature_rows",
    "preprocess_wav",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["drift_metrics"](spark, sf_dir))  # starts the Python workers
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        seconds[name] = round(time.perf_counter() - start, 3)
        clear(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
