"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the threads."""

import json
import os
import time

from pyspark.sql import SparkSession

from terraloom.plans import registry

HEADLINE = [
    "grid_cloud", "grid_without_outliers", "mosaic_all", "mosaic_index_map", "image_expression", "percentile_stretch", "difference_summary",
    "camera_residuals", "pair_percentiles", "adjustment_outliers", "error_summary", "time_brackets", "footprint_overlaps", "track_pairs",
    "median_filter", "slope_aspect", "match_tracks", "frames_per_hour",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    found["block_boxes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't the first query's
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.time()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
