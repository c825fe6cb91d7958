"""A versioned table over the points, with a commit history that uses every operation.

    snapshots 1-7   append of one survey year each, 1995-2001, committed a year later
    snapshot 8      1998 overwritten without class 7         2003-01-01
    snapshot 9      z < 1 deleted                            2004-01-01
                    rollback to before 2003-06-01 (8)        2004-06-01
                    rollback to 7                            2005-01-01
    snapshot 10     second copy of 1995 with z >= 9          2006-01-01
                    snapshots before 2000-01-01 expired      2007-01-01
"""

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudmill.plans.points import points
from cloudmill.session import path_exists, scratch_path
from cloudmill.sources.versioned import PointTable

_built: dict[tuple[str, str], str] = {}


def utc(year: int, month: int = 1, day: int = 1) -> datetime:
    return datetime(year, month, day, tzinfo=timezone.utc)


def survey_table(spark: SparkSession, sf_dir: str) -> PointTable:
    """The table for `sf_dir`, built on first use by this application.

    It is built again if the scratch folder has been cleaned since.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _built or not path_exists(spark, f"{_built[key]}/definition"):
        _built[key] = _build(spark, points(spark, sf_dir))
    return PointTable(spark, _built[key])


def _build(spark: SparkSession, cloud: DataFrame) -> str:
    # Each commit scans the source for the year that it needs: scans are cheaper than a copy,
    # and as a commit holds one year, its points need no shuffle.
    path = scratch_path(spark, "surveys")
    table = PointTable.create(spark, path, cloud.schema, partition_by=["survey_year"])
    for year in range(1995, 2002):
        table.append(cloud.filter(F.col("survey_year") == year), gather=False, at=utc(year + 1))
    table.overwrite_partitions(
        cloud.filter("survey_year = 1998 AND classification <> 7"), gather=False, at=utc(2003)
    )
    table.delete_where("z < 1", at=utc(2004))
    table.rollback_to_time(utc(2003, 6), at=utc(2004, 6))
    table.rollback_to(7, at=utc(2005))
    table.append(cloud.filter("survey_year = 1995 AND z >= 9"), gather=False, at=utc(2006))
    table.expire_snapshots(utc(2000), at=utc(2007), delete_files=True)
    return path
