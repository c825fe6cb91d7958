"""Point-cloud preprocessing as PySpark DataFrame operators."""

from cloudmill.operators.clustering import cluster_zorder
from cloudmill.operators.farthest import farthest_point_sample
from cloudmill.operators.neighbors import ball_query, ball_query_color, knn, knn_color
from cloudmill.operators.sampling import random_sample, uniform_sample, voxel_sample
from cloudmill.operators.transform import jitter, normalize, rotate_z
from cloudmill.plans.pipeline import run_pipeline
from cloudmill.sources.delimited import read_delimited, read_xyz, write_csv, write_xyz
from cloudmill.sources.ingest import ingest_files
from cloudmill.sources.versioned import PointTable, drop_table, list_tables

__all__ = [
    "PointTable",
    "ball_query",
    "ball_query_color",
    "cluster_zorder",
    "drop_table",
    "farthest_point_sample",
    "ingest_files",
    "jitter",
    "knn",
    "knn_color",
    "list_tables",
    "normalize",
    "random_sample",
    "read_delimited",
    "read_xyz",
    "rotate_z",
    "run_pipeline",
    "uniform_sample",
    "voxel_sample",
    "write_csv",
    "write_xyz",
]
