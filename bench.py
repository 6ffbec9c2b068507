"""Headline queries on one machine: prints one JSON line.

The first figure to look at is ``whole_job``: profile, audit, types, cleaning and the audit of the result on lineitem,
which the README compares in cells per second.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES, facts  # noqa: E402
from veritab.operators import audit, profile  # noqa: E402
from veritab.plans.report import Report  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "profile_columns", "issues", "health_score", "semantic_types", "clean_orders", "analytics_numeric", "top_values",
    "correlation_pairs", "histogram", "route_intents", "followups", "repair_responses", "over_limit", "enforced_limit",
)


def whole_job(spark: SparkSession, sf_dir: str, table: str = "lineitem", order_by: str = "l_orderkey") -> int:
    """Everything a user gets for one table; returns the number of cells."""
    report = Report(facts(spark, sf_dir, table).df, order_by)
    profile.profile_columns(report.raw).collect()
    audit.issues(report.raw).collect()
    report.cleaned.log().collect()
    audit.health_score(report.after).collect()
    return report.raw.rows * len(report.raw.names)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("veritab-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    whole_job(spark, SF_DIR, "supplier", "s_suppkey")  # start the session and warm the JVM on a small table, untimed
    seconds = {}
    start = time.perf_counter()
    cells = whole_job(spark, SF_DIR)
    seconds["whole_job"] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "whole_job_cells_per_sec": round(cells / seconds["whole_job"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
