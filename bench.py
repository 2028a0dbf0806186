"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellcast.plans.queries import QUERIES
from cellcast.session import build_session

HEADLINE = (
    "a2_numeric_summary",
    "a4_iqr_outliers_wide",
    "a8_column_quality",
    "a13_pearson_pairs",
    "a14_spearman",
    "a19_mann_whitney",
    "a20_counts_by_year",
    "a22_duration_stats",
    "a37_rollup_cells",
    "a40_box_stats",
    "e4_auroc",
    "e5_average_precision",
    "f1_local_to_utc_window",
    "f5_cell_id",
    "j2_join_weather",
    "j4_nearest_join",
    "j9_exclude_within",
    "j20_count_within",
    "n1_day_matched_negatives",
    "n9_assemble_dataset",
    "p8_validate",
    "w1_trailing_stats",
    "w5_ignition_label",
    "w7_focal_3x3",
    "w8_risk_rank",
    "w11_dedupe",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["s2_read_table"](spark, folder).collect()
    times = {}
    for name in names:
        taken = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
    result = {
        "metric": "headline_total_median",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
