"""Times the headline queries once each after a warm-up; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pointlake import catalog  # noqa: E402

HEADLINE = [
    "normalise_unit_sphere", "voxel_downsample", "random_downsample_ratio", "serialised_order", "voxel_pooling",
    "knn_graph", "pca_normals", "patches_grid", "patches_kd", "farthest_points", "components_directed", "patch_relation",
    "normal_metrics", "label_losses", "forest_flips", "merge_smallest", "orientation_report", "oriented_normals",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pointlake-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()[0]
    names = sys.argv[1:] or HEADLINE
    # Warm-up: the engine, and the Python workers that grouped steps run in.
    queries["patch_statistics"](spark, sf_dir).collect()
    queries["hilbert_encode"](spark, sf_dir).collect()
    times, jobs = {}, {}
    for name in names:
        spark.sparkContext.setJobGroup(name, name)
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        print(f"{name} {times[name]} ({jobs[name]} jobs)", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "jobs": jobs,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
