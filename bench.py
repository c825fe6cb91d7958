"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)

Each query runs once to warm up and then until three runs or eight seconds are spent;
the median counts. Results go to a sink that discards them, so every column is computed.
The versioned table is built, with all its commits, in "survey_build".
"""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from cloudmill import jitter, random_sample
from cloudmill.plans import versions
from cloudmill.plans.points import points
from cloudmill.plans.queries import QUERIES

HEADLINE = (
    "knn", "knn_color", "ball", "ball_color",
    "uniform_exact", "uniform_exact_large", "uniform_stored", "random", "random_large",
    "voxel", "fps", "fps_points", "fps_coreset",
    "normalize", "rotate", "jitter", "zorder_key",
    "csv_roundtrip", "scan_xyz", "asof_read", "incremental_read", "delete_where",
    "partitions", "run_asof_voxel",
)

# The registered forms draw from md5, which SQL can repeat; these use the own generator.
DEFAULT_DRAWS = {
    "random_default": lambda spark, sf_dir: random_sample(points(spark, sf_dir), 1000),
    "jitter_default": lambda spark, sf_dir: jitter(points(spark, sf_dir), 0.05, 0.08),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cloudmill-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        query = DEFAULT_DRAWS.get(name) or QUERIES[name]
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    points(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    start = time.perf_counter()
    versions.survey_table(spark, sf_dir)
    times["survey_build"] = time.perf_counter() - start
    for name in (*HEADLINE, *DEFAULT_DRAWS):
        run(name)
        spent: list[float] = []
        while len(spent) < 3 and sum(spent) < 8:
            spent.append(run(name))
        times[name] = statistics.median(spent)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in times.items()},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
