"""From folders of delimited files to named, clustered tables."""

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, SparkSession

from cloudmill.sources.delimited import read_delimited
from cloudmill.sources.versioned import PointTable

# Bits of each axis that the z-order of ingested files goes by.
ZORDER_BITS = 20


def ingest_files(
    spark: SparkSession,
    path: str,
    name: str,
    *,
    mode: str = "append",
    location: str | None = None,
    partition_by=(),
    zorder_bits: int | None = ZORDER_BITS,
    derived: Mapping[str, Column] | None = None,
    at: datetime | None = None,
    **reading,
) -> int:
    """Read every `*.csv` below `path` into the table called `name`; returns the new snapshot.

    A table that the session catalog does not know is created, at `location` or in the
    warehouse, with `partition_by` and written in z-order of `zorder_bits`; one that it knows
    keeps its own layout. `derived` adds columns, such as one to partition by; `reading` goes
    to `read_delimited`.

    "append" adds the points. "overwrite" replaces the partitions that occur in the files
    (all points where the table has no partitions); which ones these are is read from the log
    of the files just written, so the input is parsed once.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is 'append' or 'overwrite'")
    points = read_delimited(spark, path, **reading).withColumns(dict(derived or {}))
    if spark.catalog.tableExists(name):
        table = PointTable.named(spark, name)
    else:
        table = PointTable.create_named(
            spark, name, points.schema, location=location, partition_by=partition_by, zorder_bits=zorder_bits
        )
    if mode == "append":
        return table.append(points, at=at)
    return table.overwrite_partitions(points, at=at)
