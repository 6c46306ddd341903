"""Benchmark: run the study's headline queries at $BENCH_SF_DIR on
local[$BENCH_CPUS] and print one JSON line.

Queries run in stage order on one study, the way the reference runs its
scripts: each stage's table is written once to the checkpoint folder and
later stages read it, so each query's time is the work it adds.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["code_flags", "sample_flow", "index_event", "cohort_exclusion", "assigned_dates", "linked_exposed",
            "linked_unexposed", "stratified_sample", "month_panel", "event_series", "outcomes", "combine_cohorts",
            "att_gt", "fe_one_regressor_balanced", "fe_event_study"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession

    from epicohort.session import ensure_checkpoint_dir
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("epicohort-bench")
             .config("spark.sql.shuffle.partitions", str(max(int(cpus), 1) * 2))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="epicohort-bench-"))
    ensure_checkpoint_dir(spark)
    from epicohort.plans.queries import QUERIES
    # start the JVM's code paths and the Python workers once, timed apart
    t_w = time.time()
    spark.range(100000).selectExpr("sum(id)").collect()
    spark.range(1000).mapInPandas(lambda it: it, "id long").count()
    warmup = round(time.time() - t_w, 3)
    times, rows = {}, {}
    t_all = time.time()
    for name in HEADLINE:
        t0 = time.time()
        rows[name] = len(QUERIES[name](spark, sf_dir).collect())
        times[name] = round(time.time() - t0, 3)
    total = round(time.time() - t_all, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "study_pipeline_wall", "value": total, "unit": "sec", "queries": times,
                      "rows": rows, "sf": sf, "warmup_sec": warmup, "spark": spark.version,
                      "master": f"local[{cpus}]"}))
    spark.stop()


if __name__ == "__main__":
    main()
