"""Read a point table, apply one operator, export the result."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cloudmill.operators.farthest import farthest_point_sample
from cloudmill.operators.neighbors import ball_query, ball_query_color, knn, knn_color
from cloudmill.operators.sampling import random_sample, uniform_sample, voxel_sample
from cloudmill.operators.transform import jitter, normalize, rotate_z
from cloudmill.sources.delimited import write_csv
from cloudmill.sources.versioned import PointTable

OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "none": lambda df: df,
    "uniform_sampling": uniform_sample,
    "voxel_sampling": voxel_sample,
    "random_sampling": random_sample,
    "farthest_point_sampling": farthest_point_sample,
    "knn_search": knn,
    "knn_search_with_color": knn_color,
    "ball_query": ball_query,
    "ball_query_with_color": ball_query_color,
    "normalize": normalize,
    "rotate": rotate_z,
    "jitter": jitter,
}


def run_pipeline(
    spark: SparkSession,
    table: str,
    *,
    snapshot_id: int | None = None,
    as_of=None,
    appended_between: tuple[int, int] | None = None,
    columns=None,
    operator: str = "none",
    options: dict | None = None,
    output: str | None = None,
    single_file: bool = False,
) -> DataFrame:
    """Run one operator over one version of the table at `table`; optionally write CSV.

    At most one of `snapshot_id`, `as_of` and `appended_between` chooses the version;
    without one the current snapshot is read. `columns` narrows the points first.
    `options` are the keyword arguments of the operator.
    """
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}; one of {sorted(OPERATORS)}")
    if sum(v is not None for v in (snapshot_id, as_of, appended_between)) > 1:
        raise ValueError("give only one of snapshot_id, as_of and appended_between")
    points = PointTable(spark, table)
    if appended_between is not None:
        df = points.read_appends(*appended_between)
    else:
        df = points.read(snapshot_id, as_of=as_of)
    if columns is not None:
        df = df.select(*columns)
    result = OPERATORS[operator](df, **(options or {}))
    if output is not None:
        write_csv(result, output, single_file=single_file)
    return result
