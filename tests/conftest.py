import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("cloudmill-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cloud(spark):
    from cloudmill.plans.points import points

    return points(spark, "/root/testdata/sf0.001").cache()


@pytest.fixture
def xyz(spark):
    """Build a small cloud from (x, y, z) rows."""

    def build(rows, partitions=2):
        rows = [tuple(None if v is None else float(v) for v in r) for r in rows]
        df = spark.createDataFrame(rows, "x double, y double, z double")
        return df.repartition(partitions)

    return build
