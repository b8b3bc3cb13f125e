"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from spatialframe.plans.catalog import QUERIES

# one or two of each family, every one over its whole tables
HEADLINE = ["count_matrix", "centroids", "molecule_fate", "join_counts", "grid_domains", "depth_summary", "method_summary", "paired_vs_baseline",
            "radius_pairs", "radius_join", "nearest", "nearest_other", "window_join", "graph_topology", "permutation_null", "bh_adjust", "cliffs_delta",
            "module_rate", "expr_detect", "transfer_labels", "feature_knn", "marker_support", "match_depth", "channel_stats", "toroidal_null", "mask_distance"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the JVM's workers
    took = {}
    for n in names:
        t = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
