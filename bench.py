"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs once
after one warm-up query has started the session; nothing is kept between queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from assayer.plans.queries import queries
from assayer.session import configure

HEADLINE = (
    "numeric_profile", "value_frequencies", "column_stats", "column_profile", "top_values",
    "duplicate_rows", "dataset_profile", "correlation", "correlation_complete", "histogram",
    "quality_findings", "feature_selection", "train_test_split", "stratified_split",
    "preprocess_numeric", "classification_metrics", "regression_metrics", "confusion_matrix",
    "infer_types", "route_questions", "model_predictions_logistic_regression",
    "model_predictions_linear_regression", "model_predictions_ridge_regression",
    "model_predictions_random_forest_classifier",
)


def plan_counts(df) -> dict[str, int]:
    """File scans and shuffles in the plan of the returned table."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[0]
    return {
        "scans": len(re.findall(r"FileScan|BatchScan", plan)),
        "shuffles": len(re.findall(r"(?<!Reused)Exchange (?:hash|range|single|round)", plan)),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
    ).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    known["numeric_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds, plans = {}, {}
    for name in chosen:
        start = time.perf_counter()
        df = known[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        plans[name] = plan_counts(df)
        spark.catalog.clearCache()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "plans": plans,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
