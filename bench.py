"""Seconds of the headline queries at $BENCH_SF_DIR, as one line of JSON."""

import json
import os
import sys
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = (
    "field_min", "field_statistics", "histogram", "hist_quantile_linear", "binning_avg_1d", "binning_avg_2d", "binning_pdf_1d", "binning_paint", "history_gradient_time",
    "derived_arith", "derived_if", "vector_magnitude", "threshold", "threshold_sphere", "histsampling", "param_expression", "mesh_gradient", "contour_cells", "contour_triangles", "lineout",
)


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    from gridwell.queries import QUERIES

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["field_sum_avg"](spark, SF).collect()  # the first query starts Spark's own machinery
    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        began = time.perf_counter()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
