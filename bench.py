"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from lineweave.plans import queries as plans

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = "select_contains replace_all_count sort_by_style sort_selected_blocks lead_in make_adjacent keyframe_snap merge_identical recombine_coverage collisions join_concat split_karaoke presence_hysteresis run_bounds spike_repair waveform_minmax array_mean_abs_diff match_ranked detect_script strip_html".split()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(2):  # cold, then warm
            t = time.time()
            plans.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.time() - t)
        took[name] = round(min(times), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
