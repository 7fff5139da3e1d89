"""Seconds per headline query on ``$BENCH_SF_DIR``; prints one JSON line.

Inputs that a deployment would keep stored (the daily cohorts, the weekly panel) are built first and
timed separately as ``setup_*``; ``value`` is the sum over the queries.
"""

from __future__ import annotations

import json
import os
import time

from fieldloom.checks import inputs
from fieldloom.checks.catalog import CATALOG
from fieldloom.session import local_session

HEADLINE = [
    "i1_ffill_bfill", "f1_zclip", "p6_climatology_pad", "a6_weekly_rollup", "w1_roll4", "d9_index_v54",
    "preprocess_v51_train", "preprocess_v54_train", "t3_windows", "t5_folds", "k1_region_stats", "e3_wide_forecast",
    "q1_percentiles", "x8_feature_shift", "x12_corr_matrix", "x12_spearman_matrix", "x15_box_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cpus, os.environ.get("BENCH_MEMORY", "12g"), partitions=cpus)
    setup, seconds = {}, {}

    def timed(table: dict, name: str, run) -> None:
        start = time.perf_counter()
        run()
        table[name] = round(time.perf_counter() - start, 3)

    timed(setup, "setup_daily", lambda: (inputs.train(spark, sf_dir), inputs.test(spark, sf_dir)))
    timed(setup, "setup_imputed", lambda: (inputs.filled(spark, sf_dir, "v51"), inputs.filled(spark, sf_dir, "v54")))
    timed(setup, "setup_weekly", lambda: (inputs.weekly(spark, sf_dir, "v51"), inputs.weekly(spark, sf_dir, "v54")))
    timed(setup, "setup_panels", lambda: (inputs.panels(spark, sf_dir, "v51"), inputs.panels(spark, sf_dir, "v54")))
    timed(setup, "setup_samples", lambda: inputs.samples(spark, sf_dir))
    for name in HEADLINE:
        run = CATALOG[name].run
        timed(seconds, name, lambda: run(spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "panel_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "setup": setup, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
