"""Time the headline jobs; prints one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default all), BENCH_RUNS (warm runs per job, median
reported, default 3), BENCH_QUERIES (space separated keys, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from fleetgauge.plans.jobs import JOBS  # noqa: E402

HEADLINE = """
    wn_increase wn_increase_extrapolated wn_rate wn_irate wn_counter_resets ag_avg_response jn_vector_match
    jn_instant_asof wn_alert_nodata wn_alert_for wn_due_thinning wn_maintenance_fold jn_maintenance jn_business_time
    ag_business_uptime jn_alert_inhibit jn_description jn_target_labels ag_first_wins_dedup ag_type_counts
    ag_mail_age_buckets ag_txn_extents flt_prefix_rules prj_metric_name prj_json_fields src_exposition_text
    src_trans_report snk_exposition_text snk_latest_state st_alert_state
""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count())
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    asked = os.environ.get("BENCH_QUERIES", "").split()
    keys = list(JOBS) if asked == ["all"] else asked or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("fleetgauge-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def once(key: str) -> float:
        start = time.perf_counter()
        JOBS[key](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    took = {}
    for key in keys:
        once(key)
        took[key] = round(statistics.median(once(key) for _ in range(runs)), 3)
        print(f"{key:28s} {took[key]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "sum of median warm seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": sf.rsplit("sf", 1)[-1], "cpus": int(cpus), "runs": runs, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
