"""Time the cohort build and the headline queries; prints one JSON line.

``$BENCH_SF_DIR`` names the folder of test tables and ``$BENCH_CPUS`` the number of
local cores.  The shared steps (base tables, profile, screened days, index and
scored tables) are timed once under ``build_*``; every query is then timed from
those tables, executed in full.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from carecohort.plans.catalog import QUERIES, workspace

HEADLINE = (
    "first_statin", "dyslipidemia_onset", "hypertension_definition", "diabetes_definition",
    "cholesterol_pivot", "systolic_bp", "egfr_results", "ascvd_eligible", "total_cvd_eligible",
    "pce_candidates", "active_antihypertensive", "risk_by_stratum", "global_ntile",
    "binned_calibration_pce_10yr", "auc_delong_ascvd", "cindex_10yr", "cox_slope_10yr",
    "calibration_slope_binary", "km_curve", "dca_survival_10yr", "dca_binary_ascvd",
    "table1_continuous", "table1_categorical", "metrics_wide", "misclassification_sensitivity",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("carecohort-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR", f"file://{os.getcwd()}/spark-warehouse/_bench"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, work):
        start = time.perf_counter()
        out = work()
        seconds[name] = round(time.perf_counter() - start, 3)
        return out

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    reports = timed("build_base_tables", lambda: workspace(spark, folder))
    build = reports.build
    for step in ("profile", "screened", "_ascvd_index", "_total_cvd_index", "pce", "prevent_ascvd", "prevent_total_cvd"):
        timed(f"build_{step.strip('_')}", lambda s=step: getattr(build, s))
    timed("build_evaluation_rows", lambda: (reports.survival_rows, reports.binary_rows))
    for name in HEADLINE:
        timed(name, lambda n=name: QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "cohort build and validation, total wall clock",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
