"""Point clouds derived from the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One row per lineitem row; {days} is the only part that engines spell differently.
_POINT = {
    "point_id": (
        "concat_ws('-', cast(l_orderkey AS varchar(20)), cast(l_linenumber AS varchar(20)), "
        "cast(l_partkey AS varchar(20)), cast(l_suppkey AS varchar(20)))"
    ),
    "x": "l_extendedprice / 1000",
    "y": "l_quantity",
    "z": "abs(l_discount) * 100",  # the source holds -0.0
    "intensity": "cast(l_partkey % 256 AS double)",
    "returnNumber": "cast(l_linenumber AS double)",
    "numberOfReturns": "cast(7 AS double)",
    "scanDirectionFlag": (
        "CASE WHEN l_linestatus = 'F' THEN cast(1 AS double) ELSE cast(0 AS double) END"
    ),
    "edgeOfFlightLine": (
        "CASE WHEN l_returnflag = 'R' THEN cast(1 AS double) ELSE cast(0 AS double) END"
    ),
    "classification": "cast(l_suppkey % 10 AS double)",
    "scanAngleRank": "cast((l_linenumber - 4) * 5 AS double)",
    "userData": "cast(0 AS double)",
    "pointSourceId": "cast(l_orderkey % 100 AS double)",
    "gpsTime": "cast({days} AS double) * 86400",
    "red": "cast((l_partkey * 257) % 65536 AS double)",
    "green": "cast((l_suppkey * 257) % 65536 AS double)",
    "blue": "cast((l_orderkey * 257) % 65536 AS double)",
    "survey_year": "cast(year(l_shipdate) AS int)",
}


def _point_columns(days: str) -> list[str]:
    return [f"{text.format(days=days)} AS {name}" for name, text in _POINT.items()]


COLUMNS = tuple(_POINT)

DUCKDB_POINTS = (
    "SELECT "
    + ", ".join(_point_columns("date_diff('day', date '1995-01-01', l_shipdate)"))
    + " FROM lineitem"
)

# First three embedding components as coordinates.
DUCKDB_EMBEDDED = """
SELECT cast(embedding[1] AS double) AS x, cast(embedding[2] AS double) AS y,
       cast(embedding[3] AS double) AS z, cast(label AS double) AS classification,
       vec_id AS point_id
FROM embeddings
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lineitem.selectExpr(*_point_columns("datediff(l_shipdate, date'1995-01-01')"))


def embedded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    axes = [F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")]
    return table.select(
        *axes, F.col("label").cast("double").alias("classification"), F.col("vec_id").alias("point_id")
    )


def lowest_point(df: DataFrame) -> tuple[float, float, float]:
    """Least (x, y, z) of the cloud: a query point that is certain to exist."""
    return tuple(df.agg(F.min(F.struct("x", "y", "z")).alias("p")).first()["p"])
